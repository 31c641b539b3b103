"""Lines, sections, headings, repeated lines, paragraphs and sentences of documents.

All operators take (key, text) rows; lines are exploded and windows run per document, so
a document's lines meet in one task and nothing larger does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a section title looks.
TITLE = r"^(?:#+\s+.+|[0-9]+\.(?:[0-9]+\.)*\s+.+|[A-Z][A-Z\s]+|(?:Article|Section|Chapitre)\s+[0-9]+\s*:\s*.+)$"
EDGES = r"^\s+|\s+$"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", EDGES, ""))


def section_level(title: Column) -> Column:
    upper = (F.upper(title) == title) & (F.lower(title) != title)
    return (
        F.when(title.startswith("#"), F.length(title) - F.length(F.regexp_replace(title, "^#+", "")))
        .when(title.rlike(r"^[0-9]+\."), F.length(title) - F.length(F.replace(title, F.lit("."), F.lit(""))) + 1)
        .when(title.startswith("Article") | title.startswith("Chapitre"), 1)
        .when(title.startswith("Section"), 2)
        .when(upper & (F.length(title) > 3), 1)
        .otherwise(3)
    )


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_line, title, level, content): text before the first title belongs to no section. Arrays within the row, no shuffle."""
    numbered = F.transform(F.split(F.col(text), "\n"), lambda v, i: F.struct(F.regexp_replace(v, EDGES, "").alias("line"), i.alias("no")))
    x = df.where(F.col(text).isNotNull()).select(key, F.filter(numbered, lambda v: v["line"] != "").alias("_lines")).where(F.size("_lines") > 0)
    x = x.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_lines", i)["line"].rlike(TITLE)))
    ends = F.transform("_starts", lambda s, i: F.struct(s.alias("from"), F.coalesce(F.get("_starts", i + 1), F.size("_lines")).alias("to")))
    x = x.select(key, "_lines", F.explode_outer(ends).alias("_s")).where("_s IS NOT NULL")  # outer: no filter on the array is pushed below
    title = F.get("_lines", F.col("_s.from"))
    body = F.array_join(F.slice("_lines.line", F.col("_s.from") + 2, F.col("_s.to") - F.col("_s.from") - 1), "\n")
    x = x.select(key, title["no"].alias("start_line"), title["line"].alias("title"), body.alias("content"))
    return x.select(key, "start_line", "title", section_level(F.col("title")).cast("int").alias("level"), "content")


def without_repeated_lines(df: DataFrame, key: str, text: str, share: float = 0.3) -> DataFrame:
    """(key, text) without short lines found on more than two pages and more than ``share`` of them."""
    pages = (F.length(text) - F.length(F.replace(F.col(text), F.lit("[Page "), F.lit("")))) / 6
    x = df.where(F.col(text).isNotNull()).select(key, pages.alias("pages"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", EDGES, ""))
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "line"))
    kept = x.withColumn("n", n).where((F.col("line") == "") | (F.length("line") >= 100) | (F.col("n") <= F.greatest(F.lit(2.0), F.col("pages") * share)))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda s: s["raw"]), "\n").alias("text"))


def headings(df: DataFrame, key: str, text: str, deepest: int = 6) -> DataFrame:
    """(key, line_no, level, title, parent_line): the parent is the nearest earlier heading of a lower level."""
    x = lines(df, key, text).where(F.col("line").rlike(f"^#{{1,{deepest}}}\\s+\\S"))
    x = x.select(key, "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_replace("line", r"^#+\s+", "").alias("title"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w)) for k in range(1, deepest)]
    return x.select(key, "line_no", "level", "title", F.greatest(*last).alias("parent_line"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, content) of the non-blank paragraphs."""
    p = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(p).alias("position", "content"))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, content): cut after . ! ? followed by a blank."""
    s = F.split(F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.filter(F.transform(s, lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")).alias("position", "content"))
