"""Pieces of the SQL that queries are compared with: the fixed word lists as text."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_hits(low: str, words: list[str], weight: int = 1) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({low}, {q(w)}) THEN {weight} ELSE 0 END)" for w in words) + ")"


def sql_any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def sql_best(scores: list[tuple[str, str]], default: str) -> str:
    """Over columns named in ``scores`` as (label, column)."""
    top = "greatest(" + ", ".join(c for _, c in scores) + ")"
    return f"CASE WHEN {top} <= 0 THEN {q(default)} " + " ".join(f"WHEN {c} = {top} THEN {q(n)}" for n, c in scores) + " END"


def sql_first(low: str, labels: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(low, w)} THEN {q(n)}" for n, w in labels.items()) + f" ELSE {q(default)} END"


LATEST_DOCS = "(SELECT * FROM parsed_docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"
STRIPS = "(SELECT DISTINCT ON (strip_id) * FROM knowledge_strips)"
