"""Queries of metadata in texts and of table roll-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.operators import extraction as X
from kerfline.operators import sheets as T
from kerfline.plans.sql import LATEST_DOCS, q
from kerfline.session import latest_per_key, latest_rows, table


def doc_identification(spark, d):
    c = F.col("content")
    key = F.concat(F.lit("DOC-"), F.substring(F.coalesce("document_hash", F.sha2(F.concat(F.coalesce("source_path", F.lit("")), F.coalesce(c, F.lit(""))), 256)), 1, 12))
    rows = table(spark, d, "parsed_docs").select(
        "doc_id", "loaded_at", key.alias("document_key"), X.first(c, X.CODES).alias("code"), F.coalesce(X.first(c, X.VERSIONS), F.lit("1.0")).alias("version"),
        *[X.day(X.first(c, p)).alias(k) for k, p in X.DATES.items()], *[X.person(c, r).alias(r) for r in X.PEOPLE], X.classification(c).alias("classification"), X.department(c).alias("department"),
        F.array_join(X.sensitivity(c), ",").alias("sensitivity"), F.array_join(X.systems(c), ",").alias("systems"),
    )
    return latest_per_key(rows, "doc_id", "loaded_at").drop("loaded_at")


def _latest_exploded(spark, d, array):
    rows = latest_per_key(table(spark, d, "parsed_docs").select("doc_id", "loaded_at", array.alias("_a")), "doc_id", "loaded_at")
    return rows.select("doc_id", F.explode("_a").alias("r"))


def doc_relations(spark, d):
    return _latest_exploded(spark, d, X.relations(F.col("content"))).select("doc_id", F.col("r.kind").alias("kind"), F.col("r.ref").alias("ref"))


def doc_cross_references(spark, d):
    refs = _latest_exploded(spark, d, X.every(F.col("content"), X.REFERENCES)).groupBy("doc_id", F.col("r").alias("ref")).agg(F.count(F.lit(1)).alias("mentions"))
    return refs.withColumn("type", X.reference_type(F.col("ref")))


def doc_time_terms(spark, d):
    return _latest_exploded(spark, d, X.time_terms(F.col("content"))).groupBy("doc_id", F.col("r.kind").alias("kind"), F.col("r.term").alias("term")).agg(F.count(F.lit(1)).alias("mentions"))


def _records(spark, d):
    return T.records(latest_rows(table(spark, d, "parsed_docs").select("doc_id", "loaded_at", "tables"), "doc_id", "loaded_at"), "doc_id", "tables")


def table_records(spark, d):
    return _records(spark, d).drop("cells", "title")


def table_rollups(spark, d):
    return T.rollup(_records(spark, d), "doc_id")


def table_samples(spark, d):
    return T.as_text(_records(spark, d), "doc_id")


QUERIES = {f.__name__: f for f in (doc_identification, doc_relations, doc_cross_references, doc_time_terms, table_records, table_rollups, table_samples)}


def _first(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(content, {q(p)}, 1), '')" for p in patterns) + ")"


def _day(patterns: list[str]) -> str:
    x = f"string_split(replace({_first(patterns)}, '-', '/'), '/')"
    year = f"CASE WHEN length({x}[3]) = 2 THEN CAST({x}[3] AS INT) + CASE WHEN CAST({x}[3] AS INT) > 50 THEN 1900 ELSE 2000 END ELSE CAST({x}[3] AS INT) END"
    return f"CAST(try_strptime(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || {x}[2] || '-' || {x}[1], '%Y-%m-%d') AS DATE)"


def _person(role: str) -> str:
    name = lambda p: f"regexp_replace(regexp_replace(regexp_extract(content, {q(p)}, 1), '\\s+', ' ', 'g'), '^[\\s.,;:]+|[\\s.,;:]+$', '', 'g')"
    return "coalesce(" + ", ".join(f"CASE WHEN length({name(p)}) BETWEEN 4 AND 49 THEN {name(p)} END" for p in X.PEOPLE[role]) + ")"


def _every(patterns: list[str]) -> str:
    return "list_concat(" + ", ".join([*(f"regexp_extract_all(content, {q(p)}, 1)" for p in patterns), "[]"]) + ")"


def _case(value: str, table_: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({value}, {q(w)})" for w in words) + f" THEN {q(k)}" for k, words in table_.items()) + f" ELSE {q(default)} END"


_HEAD = "list_transform(rows[1], lambda h: lower(coalesce(h, '')))"
_AT = lambda words: f"list_position(list_transform({_HEAD}, lambda h: {' OR '.join(f'contains(h, {q(w)})' for w in words)}), true)"
_PLACE = lambda part: "CASE kind " + " ".join(f"WHEN {q(k)} THEN {_AT(c[part])}" for k, c in T.COLUMNS.items()) + " END"
_HITS = ", ".join(f"len(list_filter(head, lambda c: regexp_matches(c, {q(p)}))) AS h{i}" for i, p in enumerate(L.SHEET_HEADERS.values()))
_BEST = f"greatest({', '.join(f'CASE WHEN h{i} >= 2 THEN h{i} ELSE 0 END' for i in range(len(L.SHEET_HEADERS)))})"
_KIND = f"CASE WHEN {_BEST} <= 0 THEN 'generic' " + " ".join(f"WHEN h{i} >= 2 AND h{i} = {_BEST} THEN {q(k)}" for i, k in enumerate(L.SHEET_HEADERS)) + " END"
_STATUS = "CASE " + " ".join(f"WHEN regexp_matches(label, {q(p)}) THEN {q(k)}" for k, p in L.STATUS.items()) + " ELSE 'non_défini' END"
_RECORDS = f"""rows0 AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS table_no, list_filter(t.data, lambda r: len(list_filter(r, lambda c: trim(coalesce(c, '')) <> '')) > 0) AS rows,
    list_transform(list_filter(t.data, lambda r: len(list_filter(r, lambda c: coalesce(c, '') <> '')) > 0)[1], lambda c: lower(coalesce(c, ''))) AS head
  FROM (SELECT doc_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS i FROM {LATEST_DOCS})),
kinds AS (SELECT *, {_KIND} AS kind FROM (SELECT *, {_HITS} FROM rows0 WHERE len(rows) > 0)),
placed AS (SELECT *, {_PLACE('name')} AS pn, {_PLACE('label')} AS pl, {_PLACE('group')} AS pg FROM kinds),
cells AS (SELECT doc_id, table_no, kind, pn, pl, pg, unnest(rows[2:]) AS c, unnest(range(0, len(rows) - 1)) AS row_no FROM placed),
labelled AS (SELECT *, lower(coalesce(c[nullif(pl, 0)], '')) AS label FROM cells),
records AS (SELECT doc_id, table_no, kind, CAST(row_no AS INTEGER) AS row_no, c[nullif(pn, 0)] AS name, CASE kind WHEN 'control_matrix' THEN {_STATUS} WHEN 'risk_register' THEN {_case('label', T.RISKS, 'moyen')} WHEN 'inventory' THEN {_case('label', T.ASSETS, 'faible')} ELSE 'row' END AS class,
  coalesce(c[nullif(pg, 0)], '') AS grouping, c FROM labelled)"""

SQL: dict[str, str] = {
    "doc_identification": f"""SELECT doc_id, 'DOC-' || left(coalesce(document_hash, sha256(coalesce(source_path, '') || coalesce(content, ''))), 12) AS document_key, {_first(X.CODES)} AS code, coalesce({_first(X.VERSIONS)}, '1.0') AS version,
{', '.join(f'{_day(p)} AS {k}' for k, p in X.DATES.items())}, {', '.join(f'{_person(r)} AS {r}' for r in X.PEOPLE)},
CASE lower({_first(X.CLASSES)}) {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.CLASS_NAMES.items())} END AS classification,
CASE {' '.join(f"WHEN regexp_matches(content, {q(f'(?i){X.A}{x}{X.Z}')}) THEN {q(x)}" for x in X.DEPARTMENTS)} END AS department,
CASE WHEN content IS NULL THEN '' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(content, {q(f'(?i){X.A}(?:{p}){X.Z}')}) THEN {q(k)} END" for k, p in X.SENSITIVE.items())}], lambda x: x IS NOT NULL), ',') END AS sensitivity,
array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, {q(X.SYSTEM)}, 1), lambda s: length(s) > 2))), ',') AS systems FROM {LATEST_DOCS}""",
    "doc_relations": " UNION ".join(f"SELECT doc_id, {q(k)} AS kind, ref FROM (SELECT doc_id, unnest({_every(p)}) AS ref FROM {LATEST_DOCS}) WHERE length(ref) < 30 AND regexp_matches(ref, '^[A-Z0-9.-]+$') AND regexp_matches(ref, '[0-9]')" for k, p in X.RELATIONS.items()),
    "doc_cross_references": f"SELECT doc_id, ref, count(*) AS mentions, {_case('lower(ref)', X.REFERENCE_TYPES, 'unknown')} AS type FROM (SELECT doc_id, unnest({_every(X.REFERENCES)}) AS ref FROM {LATEST_DOCS}) GROUP BY doc_id, ref",
    "doc_time_terms": "SELECT doc_id, kind, term, count(*) AS mentions FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {q(k)} AS kind, lower(unnest(regexp_extract_all(content, {q(p)}, 1))) AS term FROM {LATEST_DOCS}" for k, p in [("delay", X.DELAY), ("urgent", X.URGENT), *((k, f"(?i){X.A}({p}){X.Z}") for k, p in X.PERIODS.items())])
    + ") GROUP BY 1, 2, 3",
    "table_records": f"WITH {_RECORDS} SELECT doc_id, table_no, kind, row_no, name, class, grouping FROM records",
    "table_rollups": f"WITH {_RECORDS} SELECT doc_id, table_no, kind, class, grouping, count(*) AS n FROM records GROUP BY ALL",
    "table_samples": f"WITH {_RECORDS} SELECT doc_id, table_no, row_no, array_to_string(list_transform(c, lambda x: coalesce(x, '')), ' | ') AS text FROM records WHERE row_no < 5",
}
