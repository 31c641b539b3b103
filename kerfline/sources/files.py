"""Files as rows of parsed documents: directory scan, format dispatch, text, Markdown, HTML and question-answer lists.

A file is one row from ``binaryFile``; size limits, patterns, types and probes are filters on
the listing, so unread files are never opened. An empty file has no row. What parsing could not do becomes an entry
of ``parsing_errors`` instead of a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.functions.text import clean

#: Extensions and the parser that reads them.
PARSERS = {"md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "html": "html", "htm": "html", "json": "faq_json", "txt": "text"}
LIMIT = 100 * 1024 * 1024
QA_MARKS = [r"(?im)^\s*q(?:uestion)?\s*[0-9]*\s*[:.)]", r"(?i)faq", r"(?i)questions fréquentes"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, folder: str, recursive: bool = True, patterns: list[str] | None = None, excluded: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """(path, length, modified, content, parser) of the files below ``folder``; file-name patterns use * and ?."""

    def as_regex(p: str) -> str:
        return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c) for c in p) + "$"

    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = extension(F.col("path"))
    parser = F.lit(None).cast("string")
    for e, kind in PARSERS.items():
        parser = F.when(ext == e, kind).otherwise(parser)
    df = df.select("path", "length", F.col("modificationTime").alias("modified"), "content", name.alias("file_name"), parser.alias("parser"))
    df = df.where((F.col("length") <= limit) & F.col("parser").isNotNull())
    if patterns:
        df = df.where("(" + " OR ".join(f"file_name RLIKE r'{as_regex(p)}'" for p in patterns) + ")")
    for p in excluded or []:
        df = df.where(~F.col("file_name").rlike(as_regex(p)))
    return df


def unseen(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest of parsed files (path, length, modified) doesn't have."""
    return listing.join(manifest.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that are none are read as Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def html_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|h[1-6]|li|tr|ul|ol|table|section|article)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n\s*", "\n\n")


def front_matter(text: Column) -> Column:
    """The flat keys of a document head between two lines of three dashes."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[^:\s][^:]*:")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.array_distinct(F.array_sort(pairs)))


def code_blocks(text: Column) -> Column:
    """array<struct<language, code>> of the fenced code of a Markdown text."""
    fence = F.lit(r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```")
    return F.zip_with(F.regexp_extract_all(text, fence, F.lit(1)), F.regexp_extract_all(text, fence, F.lit(2)), lambda a, b: F.struct(F.when(a == "", "text").otherwise(a).alias("language"), b.alias("code")))


def pipe_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_line, data) of the pipe tables: runs of two or more lines between pipes, rulers left out."""
    from pyspark.sql.window import Window

    x = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw")).where(F.col("line").rlike(r"^\|.*\|$"))
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    g = x.withColumn("run", run).groupBy(key, "run").agg(F.min("line_no").alias("start_line"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines")).where(F.size("lines") >= 2)
    rows = F.filter(F.transform("lines", lambda s: s["line"]), lambda r: ~r.rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return g.select(key, "start_line", cells.alias("data"))


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, url): inline links, and reference links joined to their definitions (the last one holds)."""
    inline = F.lit(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)")
    a = df.select(key, F.explode(F.zip_with(F.regexp_extract_all(text, inline, F.lit(1)), F.regexp_extract_all(text, inline, F.lit(2)), lambda t, u: F.struct(t.alias("label"), u.alias("url")))).alias("l")).select(key, "l.label", "l.url")
    named, given = F.lit(r"\[([^\]]+)\]\[([^\]]+)\]"), F.lit(r"(?m)^\[([^\]]+)\]:\s*(\S+)")
    used = df.select(key, F.explode(F.zip_with(F.regexp_extract_all(text, named, F.lit(1)), F.regexp_extract_all(text, named, F.lit(2)), lambda t, r: F.struct(t.alias("label"), F.lower(r).alias("ref")))).alias("l")).select(key, "l.label", "l.ref")
    where = df.select(key, F.posexplode(F.zip_with(F.regexp_extract_all(text, given, F.lit(1)), F.regexp_extract_all(text, given, F.lit(2)), lambda r, u: F.struct(F.lower(r).alias("ref"), u.alias("url")))).alias("n", "d"))
    where = where.groupBy(key, F.col("d.ref").alias("ref")).agg(F.max_by("d.url", "n").alias("url"))
    return a.unionByName(used.join(where, [key, "ref"]).select(key, "label", "url"))


PAIR = "array<struct<id: string, question: string, q: string, answer: string, a: string, response: string, category: string>>"


def faq_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pair_no, id, question, answer, category) of JSON lists of pairs: a list, ``faq`` or ``questions`` with a list, or categories of lists."""
    t = F.col(text)

    def listed(j: Column) -> Column:
        return F.when(j.rlike(r"^\s*\["), F.from_json(j, PAIR))

    flat = F.coalesce(listed(t), listed(F.get_json_object(t, "$.faq")), listed(F.get_json_object(t, "$.questions")))
    a = df.select(key, F.posexplode(flat).alias("n", "p"), F.lit(None).cast("string").alias("group"))
    grouped = F.coalesce(F.from_json(F.get_json_object(t, "$.faq"), f"map<string, {PAIR}>"), F.from_json(F.get_json_object(t, "$.questions"), f"map<string, {PAIR}>"))
    b = df.select(key, F.explode(grouped).alias("group", "ps")).select(key, F.posexplode("ps").alias("n", "p"), "group")
    both = a.unionByName(b)
    question, answer = F.coalesce("p.question", "p.q"), F.coalesce("p.answer", "p.a", "p.response")
    number = F.concat(F.when(F.col("group").isNotNull(), F.concat("group", F.lit("-"))).otherwise(""), F.lit("Q"), (F.col("n") + 1).cast("string"))
    out = both.select(key, F.col("n").alias("pair_no"), F.coalesce("p.id", number).alias("id"), question.alias("question"), answer.alias("answer"), F.coalesce("p.category", "group").alias("category"))
    return out.where("question IS NOT NULL AND answer IS NOT NULL")


def faq_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pair_no, question, answer) of lines ``Q: ... R: ...`` with their continuation up to the next question."""
    pattern = F.lit(r"(?ims)^\s*q(?:uestion)?\s*[0-9]*\s*:\s*(.+?)\n\s*(?:r|a|réponse|reponse|answer)\s*[0-9]*\s*:\s*(.+?)(?=\n\s*q(?:uestion)?\s*[0-9]*\s*:|\z)")
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda q, a: F.struct(F.trim(q).alias("question"), F.trim(F.regexp_replace(a, r"\s+$", "")).alias("answer")))
    return df.select(key, F.posexplode(pairs).alias("pair_no", "p")).select(key, "pair_no", "p.question", "p.answer")


def parse(listing: DataFrame) -> DataFrame:
    """Parsed documents: path, parser, content, metadata, hash and errors of every scanned file."""
    raw = decoded(F.col("content"))
    df = listing.select("path", "length", "modified", "file_name", "parser", raw.alias("raw"))
    body = F.when(F.col("parser") == "html", html_text(F.col("raw"))).when(F.col("parser") == "markdown", F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n", "")).otherwise(F.col("raw"))
    df = df.withColumn("text", clean(body))
    system = F.create_map(F.lit("file_name"), F.col("file_name"), F.lit("file_size"), F.col("length").cast("string"), F.lit("extension"), extension(F.col("path")))
    own = F.when(F.col("parser") == "markdown", front_matter(F.col("raw"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    errors = F.array_compact(F.array(F.when(F.length("text") == 0, F.lit("no text")), F.when((F.col("parser") == "faq_json") & F.try_parse_json("raw").isNull(), F.lit("no JSON"))))
    both = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(system, k)), system)
    return df.select("path", "length", "modified", "parser", F.col("text").alias("content"), both.alias("metadata"), F.sha2("text", 256).alias("document_hash"), errors.alias("parsing_errors"))
