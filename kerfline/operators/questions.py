"""Question lists in documents: their way of writing, questions with answers and categories, sections of them.

Each document's lines are one array in its row, so nothing is shuffled until sections are counted.

Defined results: null and blank texts have no entries; a question without an answer of three words is left
out; entries before the first category have none; repeated questions are entries each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Way of writing -> (how a question looks, what must follow on the next line to count more).
FORMATS = {
    "numbered": (r"^[0-9]+[.)]\s*(.+\?)$", r"^[^0-9\s]"),
    "prefixed": (r"^(?:Q|Question)\s*[:.]\s*(.+)$", r"^(?:R|A|Réponse|Answer)\s*[:.]"),
    "markdown": (r"^###\s+(.+)$", r"^[^#\s]"),
    "definition": (r"^(.+)::$", r"^[^:\s]"),
}
GENERIC = r"^(?:[-*•]\s*)?(.+\?)$"
CATEGORY = r"^##\s+(.+)$"
LABEL = r"^(?:R|A|Réponse|Answer)\s*[:.]\s*"


def _matches(line: Column, kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(False))
    for name, (pattern, _) in FORMATS.items():
        out = out.when(kind == name, line.rlike(pattern))
    return out.otherwise(line.rlike(GENERIC))


def _question(line: Column, kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, (pattern, _) in FORMATS.items():
        out = out.when(kind == name, F.regexp_extract(line, pattern, 1))
    return out.otherwise(F.regexp_extract(line, GENERIC, 1))


def _looks(pattern: str, ahead: int = 0):
    """Whether the line at a place (or ``ahead`` of it) has the pattern."""
    return lambda i: F.coalesce(F.get("_lines", i + ahead).rlike(pattern), F.lit(False))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, _lines, _at, format): the way of writing with the most points (two a question, three more for what follows), generic below five."""
    trim = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    x = df.where(F.col(text).isNotNull()).select(key, F.transform(F.split(F.col(text), "\n"), trim).alias("_lines"))
    x = x.withColumn("_at", F.sequence(F.lit(0), F.size("_lines") - 1))
    for name, (question, after) in FORMATS.items():
        asked = F.filter("_at", _looks(question))
        x = x.withColumn(f"_{name}", F.size(asked) * 2 + F.size(F.filter(asked, _looks(after, 1))) * 3)
    best = F.greatest(*[f"_{n}" for n in FORMATS])
    kind = reduce(lambda w, n: w.when(F.col(f"_{n}") == best, n), FORMATS, F.when(best < 5, "generic"))
    return x.select(key, "_lines", "_at", kind.alias("format"))


def entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, format, line_no, question, answer, category): the answer ends before the next question, a heading, or a blank line after its first line."""
    x = lines_of(df, key, text)
    kind, line = F.col("format"), lambda i: F.get("_lines", i)
    x = x.withColumn("_q", F.filter("_at", lambda i: _matches(line(i), kind)))
    x = x.withColumn("_stop", F.filter("_at", lambda i: F.when(kind == "markdown", line(i).startswith("##")).otherwise(line(i) == "")))
    x = x.withColumn("_cat", F.filter("_at", lambda i: line(i).rlike(CATEGORY)))
    x = x.select(key, "format", "_lines", "_stop", "_cat", F.posexplode_outer("_q").alias("_k", "line_no"), "_q").where("_k IS NOT NULL")  # outer: no filter on the array is pushed below
    least = F.when(kind == "markdown", 0).otherwise(1)
    stop = F.get(F.filter("_stop", lambda i: i > F.col("line_no") + least), F.lit(0))
    end = F.least(F.coalesce(F.get("_q", F.col("_k") + 1), F.size("_lines")), F.coalesce(stop, F.size("_lines")))
    body = F.filter(F.slice("_lines", F.col("line_no") + 2, F.greatest(end - F.col("line_no") - 1, F.lit(0))), lambda v: v != "")
    answer = F.regexp_replace(F.regexp_replace(F.array_join(body, " "), LABEL, ""), r"\s+", " ")
    before = F.filter("_cat", lambda i: i < F.col("line_no"))
    category = F.regexp_extract(F.get("_lines", F.element_at(before, -1)), CATEGORY, 1)
    out = x.select(key, "format", "line_no", _question(line(F.col("line_no")), kind).alias("question"), answer.alias("answer"), F.when(F.size(before) > 0, category).alias("category"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return out.where((words(F.col("question")) >= 2) & (words(F.col("answer")) >= 3))


def sections(found: DataFrame, key: str) -> DataFrame:
    """(key, category, entries, answer_words): entries by category, those without one under ``Questions Générales``."""
    n = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    return found.groupBy(key, F.coalesce("category", F.lit("Questions Générales")).alias("category")).agg(F.count(F.lit(1)).alias("entries"), F.avg(n).alias("answer_words"))
