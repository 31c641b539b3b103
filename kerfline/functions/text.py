"""Column expressions for lexicon tests, classification and text clean-up. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hits(lowered: Column, words: list[str], weight: int = 1) -> Column:
    """How many of ``words`` occur in the text, times ``weight`` (substring semantics)."""
    return reduce(lambda a, b: a + b, [lowered.contains(w).cast("int") for w in words]) * weight


def any_of(lowered: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def first_of(lowered: Column, table: dict[str, list[str]], default: str) -> Column:
    """The first label one of whose words occurs."""
    labels = list(table)
    out = F.when(any_of(lowered, table[labels[0]]), labels[0])
    for label in labels[1:]:
        out = out.when(any_of(lowered, table[label]), label)
    return out.otherwise(default)


def best_of(scores: list[tuple[str, Column]], default: str) -> Column:
    """The first label that has the greatest score; ``default`` where no score is positive."""
    ranked = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("place"), F.lit(label).alias("label")) for k, (label, s) in enumerate(scores)]))
    return let(ranked, lambda best: F.when(F.coalesce(best["score"], F.lit(0)) <= 0, F.lit(default)).otherwise(best["label"]))


def present(lowered: Column, words: list[str]) -> Column:
    """The ``words`` that occur, in alphabetical order."""
    return F.array_sort(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: lowered.contains(F.lower(w))))


def clean(text: Column) -> Column:
    """Control characters out, runs of blanks and of empty lines shortened, words cut by a hyphen at a line end joined."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    t = F.regexp_replace(t, " +", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    return F.regexp_replace(t, r"^[ \n\t\r]+|[ \n\t\r]+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def table_text(table: Column) -> Column:
    """A table as text: its header line, then its rows with ``-`` for empty cells."""
    data = table["data"]
    cell = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    head = F.concat(F.lit("Tableau avec colonnes : "), F.array_join(F.transform(F.get(data, F.lit(0)), lambda c: F.coalesce(c, F.lit(""))), " | "))
    body = F.transform(F.slice(data, 2, F.greatest(F.size(data), F.lit(1))), lambda r: F.array_join(F.transform(r, cell), " | "))
    return F.when(F.coalesce(F.size(data), F.lit(0)) > 0, F.array_join(F.concat(F.array(head), body), "\n")).otherwise("")
