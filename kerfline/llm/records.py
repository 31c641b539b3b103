"""Queries of names, splitting and near-duplicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.session import table


def _linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.names import link_names

    return link_names(table(spark, sf_dir, "document_metadata"), ["author", "owner", "approver"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.names import linked_pairs

    return linked_pairs(_linked_names(spark, sf_dir))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked_names(spark, sf_dir)


#: As TESTDATA states the problem: runs of three words, a similarity of 0.6, at least 20 words.
NEAR = {"threshold": 0.6, "width": 3, "min_words": 20}
RECORDS = (("strip", "knowledge_strips", "strip_id"), ("document", "parsed_docs", "doc_id"))


def _both_tables(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    parts = [operator(table(spark, sf_dir, name), key, "content", **NEAR).withColumn("item_kind", F.lit(kind)) for kind, name, key in RECORDS]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.neardup import near_duplicate_records

    return _both_tables(spark, sf_dir, near_duplicate_records).select("item_kind", "id_a", "id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.neardup import near_duplicate_groups

    return _both_tables(spark, sf_dir, near_duplicate_groups).select("item_kind", "id", "class_id", "links")


def _oversized(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    from kerfline.llm.splitting import piece_table

    docs, strips = table(spark, sf_dir, "parsed_docs"), table(spark, sf_dir, "knowledge_strips")
    sections = docs.select("doc_id", F.posexplode("sections").alias("n", "s"))
    one = [("item_kind", "string"), ("item_id", "bigint"), ("section_no", "int"), ("content", "string")]
    rows = [
        docs.select(F.lit("document"), "doc_id", F.lit(-1), "content"),
        sections.select(F.lit("section"), "doc_id", "n", "s.content"),
        strips.select(F.lit("strip"), "strip_id", F.lit(-1), "content"),
    ]
    items = rows[0].toDF(*[n for n, _ in one])
    for r in rows[1:]:
        items = items.unionByName(r.toDF(*[n for n, _ in one]))
    # a fixed table of one row per kind
    limits = F.broadcast(table(spark, sf_dir, "size_limits"))
    return piece_table(items.join(limits, "item_kind"), ["item_kind", "item_id", "section_no"], "content", "max_chars", "overlap_chars", with_text)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, False).where("piece_no = 0").select("item_kind", "item_id", "section_no")


def p3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's length put together again from its pieces, which must leave no gap, and whether all keep the limit."""
    from kerfline.llm.splitting import own_lengths

    keys = ["item_kind", "item_id", "section_no"]
    limits = F.broadcast(table(spark, sf_dir, "size_limits").select("item_kind", "max_chars"))  # one row per kind
    got = own_lengths(_oversized(spark, sf_dir, False), keys).join(limits, "item_kind")
    return got.select(*keys, "n_chars", (F.col("longest") <= F.col("max_chars")).alias("within_limit"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of parsed_docs written as text files, and these cut by byte ranges: totals over all files."""
    import uuid

    from kerfline.llm.splitting import split_files
    from kerfline.session import shared_folder

    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, sf_dir, "parsed_docs").where("content IS NOT NULL").select("content").write.text(folder)
    limit, overlap = 4000, 200
    got = split_files(spark, folder, limit, overlap, 1 << 20)
    own = F.col("n_chars") - F.when(F.col("piece_no") > 0, overlap).otherwise(0)
    return got.agg(F.sum(own).cast("bigint").alias("n_chars"), F.count_if(F.col("n_chars") > limit).alias("over_limit"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_lengths": p3_lengths, "p3_files": p3_files, "p4_found": p4_found, "p4_groups": p4_groups}
_PAIRS = r"""SELECT '{kind}' AS item_kind, id_a, id_b FROM (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM {kind}_sets a JOIN {kind}_sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
WHERE common / (n + m - common) >= 0.6 - 1e-12"""
_SETS = r"""{kind}_sets AS (SELECT id, unnest(s) AS s, len(s) AS n FROM (
  SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (
    SELECT DISTINCT {key} AS id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE content IS NOT NULL) WHERE len(w) >= 20))"""

_CLASSES = r"""{kind}_texts AS (SELECT DISTINCT {key} AS id, content FROM {table} WHERE len(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) >= 20),
{kind}_classes AS (SELECT content, min(id) AS class_id FROM {kind}_texts GROUP BY content),
{kind}_sets AS (SELECT id, unnest(s) AS s, len(s) AS n FROM (
  SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (
    SELECT class_id AS id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM {kind}_classes)))"""
_GROUPS = r"""SELECT '{kind}' AS item_kind, id, class_id, coalesce(links, 0) AS links FROM {kind}_texts JOIN {kind}_classes USING (content)
LEFT JOIN (SELECT unnest([id_a, id_b]) AS class_id, count(*) AS links FROM ({pairs}) GROUP BY 1) USING (class_id)"""

SQL: dict[str, str] = {
    "p4_found": "WITH "
    + _SETS.format(kind="strip", key="strip_id", table="knowledge_strips")
    + ", "
    + _SETS.format(kind="document", key="doc_id", table="parsed_docs")
    + " "
    + _PAIRS.format(kind="strip")
    + " UNION ALL "
    + _PAIRS.format(kind="document"),
    "p4_groups": "WITH "
    + ", ".join(_CLASSES.format(kind=kind, key=key, table=name) for kind, name, key in RECORDS)
    + " "
    + " UNION ALL ".join(_GROUPS.format(kind=kind, pairs=_PAIRS.format(kind=kind)) for kind, _, _ in RECORDS),
    "p3_files": "SELECT CAST(sum(length(content) + 1) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS over_limit FROM parsed_docs WHERE content IS NOT NULL",
    "p3_lengths": """
SELECT item_kind, item_id, section_no, CAST(n AS BIGINT) AS n_chars, true AS within_limit FROM (
  SELECT DISTINCT 'document' AS item_kind, doc_id AS item_id, CAST(-1 AS INTEGER) AS section_no, length(content) AS n FROM parsed_docs
  UNION ALL SELECT DISTINCT 'strip', strip_id, -1, length(content) FROM knowledge_strips
  UNION ALL SELECT DISTINCT 'section', doc_id, CAST(i - 1 AS INTEGER), length(s.content) FROM (SELECT doc_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM parsed_docs))
JOIN size_limits USING (item_kind) WHERE n > max_chars
""",
    "p3_found": """
SELECT DISTINCT 'document' AS item_kind, doc_id AS item_id, CAST(-1 AS INTEGER) AS section_no FROM parsed_docs
WHERE length(content) > (SELECT max_chars FROM size_limits WHERE item_kind = 'document')
UNION ALL
SELECT DISTINCT 'strip', strip_id, -1 FROM knowledge_strips
WHERE length(content) > (SELECT max_chars FROM size_limits WHERE item_kind = 'strip')
UNION ALL
SELECT DISTINCT 'section', doc_id, CAST(n - 1 AS INTEGER) FROM (
  SELECT doc_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS n FROM parsed_docs)
WHERE length(s.content) > (SELECT max_chars FROM size_limits WHERE item_kind = 'section')
""",
}
