"""Registered queries of the core, and their SQL."""

from __future__ import annotations

from kerfline.plans import extraction, pipeline, questions, reference, stripping

FLAGSHIP = "answer_confidence"

QUERIES: dict = {**reference.QUERIES, **stripping.QUERIES, **pipeline.QUERIES, **extraction.QUERIES, **questions.QUERIES}
SQL: dict[str, str] = {**reference.SQL, **stripping.SQL, **pipeline.SQL, **extraction.SQL, **questions.SQL}
