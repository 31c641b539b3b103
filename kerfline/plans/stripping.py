"""Queries that cut documents into strips, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.operators import stripping as S
from kerfline.plans.sql import LATEST_DOCS, q, sql_any, sql_best, sql_first, sql_hits
from kerfline.session import latest_rows, table


def texts(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(table(spark, d, "parsed_docs").select("doc_id", "loaded_at", "content"), "doc_id", "loaded_at").select("doc_id", "content")


def doc_strip_sections(spark, d):
    return S.sections(texts(spark, d), "doc_id", "content")


def doc_policy_strips(spark, d):
    return S.policy_strips(texts(spark, d), "doc_id", "content")


def doc_procedure_strips(spark, d):
    return S.procedure_strips(texts(spark, d), "doc_id", "content").withColumn("actors", F.array_join("actors", ","))


def doc_procedure_parts(spark, d):
    """Every part of every document before steps are cut, with its length."""
    return S.procedure_strips(texts(spark, d), "doc_id", "content").where("strip_type <> 'procedure_step'").select("doc_id", "position", "strip_type", "content")


def doc_faq_strips(spark, d):
    return S.faq_strips(texts(spark, d), "doc_id", "content").withColumn("topics", F.array_join("topics", ","))


def doc_adaptive_strips(spark, d):
    return S.adaptive_strips(texts(spark, d), "doc_id", "content")


def doc_strips(spark, d):
    return S.strip_documents(texts(spark, d), "doc_id", "content").withColumn("refs", F.array_join("refs", ","))


QUERIES = {f.__name__: f for f in (doc_strip_sections, doc_policy_strips, doc_procedure_strips, doc_procedure_parts, doc_faq_strips, doc_adaptive_strips, doc_strips)}

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LINES = f"SELECT doc_id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {LATEST_DOCS} WHERE content IS NOT NULL"
_MARK = q(S.SECTION_MARK)
_SECTIONS = rf"""SELECT doc_id, CAST(g - min(g) OVER (PARTITION BY doc_id) AS INTEGER) AS position, header, level, content FROM (
  SELECT doc_id, g, CASE WHEN any_value(f) THEN arg_min(line, i) ELSE '' END AS header, CAST(CASE WHEN NOT any_value(f) THEN 0
    WHEN regexp_matches(arg_min(line, i), '^[0-9]') THEN length(arg_min(line, i)) - length(replace(arg_min(line, i), '.', '')) + 1
    WHEN starts_with(arg_min(line, i), '#') THEN length(arg_min(line, i)) - length(ltrim(arg_min(line, i), '#'))
    WHEN starts_with(arg_min(line, i), 'Article') THEN 1 WHEN starts_with(arg_min(line, i), 'Section') THEN 2 ELSE 0 END AS INTEGER) AS level,
    {_TRIM.format("string_agg(raw, chr(10) ORDER BY i)")} AS content
  FROM (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, first_value(m) OVER (PARTITION BY doc_id, sm ORDER BY i) AS f FROM (
    SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sm FROM (
      SELECT doc_id, i, raw, {_TRIM.format('raw')} AS line, regexp_matches({_TRIM.format('raw')}, {_MARK}) AS m FROM ({_LINES})) WHERE line <> ''))
  GROUP BY doc_id, g)"""
_FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(content, {q('(?sm)' + p)})" for p in S.STATEMENTS) + ")"
_POLICY = rf"""SELECT doc_id, CAST(CASE WHEN len(k) > 1 THEN position * 100 + n - 1 ELSE position END AS INTEGER) AS position, CASE WHEN len(k) > 1 THEN 'policy_statement' ELSE 'policy_section' END AS strip_type,
  CASE WHEN len(k) > 1 THEN k[n] ELSE content END AS content, 'policy' AS category FROM (
  SELECT *, unnest(range(1, greatest(len(k), 1) + 1)) AS n FROM (
    SELECT *, list_filter(list_transform({_FOUND}, lambda x: {_TRIM.format('x')}), lambda x: len(string_split_regex(x, '\s+')) >= 5) AS k FROM ({_SECTIONS})))"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw), {q(p)}) THEN {q(k)}" for k, p in S.PARTS.items()) + " END"
_PARTS = f"""SELECT doc_id, CAST(part AS INTEGER) AS position, 'procedure_' || of AS strip_type, content FROM (
  SELECT doc_id, part, CASE WHEN part = 0 THEN 'general' ELSE arg_min(kind, i) END AS of, string_agg(raw, chr(10) ORDER BY i) AS content FROM (
    SELECT *, sum(CASE WHEN i > 1 AND kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (
      SELECT doc_id, i, raw, {_KIND} AS kind FROM ({_LINES}) SEMI JOIN (SELECT doc_id FROM {LATEST_DOCS} WHERE {_TRIM.format('content')} <> '') USING (doc_id))) GROUP BY doc_id, part)
  WHERE of <> 'steps'"""


def _follow(c: str) -> str:
    _, _, words, bullet, _ = S.FOLLOWERS[c]
    return f"({sql_any('low', words)}" + (f" OR regexp_matches(s, {q(bullet)}))" if bullet else ")")


_NAMES = list(S.FOLLOWERS)
_MOST = {c: S.FOLLOWERS[c][1] for c in _NAMES} | {"definition": 2}
_AHEAD = " ".join(f"WHEN kind = '{c}' THEN CASE " + " ".join(f"WHEN NOT coalesce(lead(f_{c}, {k}) OVER w, false) THEN {k}" for k in range(1, most + 1)) + f" ELSE {most + 1} END" for c, most in _MOST.items())
_ADAPTIVE = rf"""WITH RECURSIVE s AS (
  SELECT doc_id, i, s, lower(s) AS low FROM (
    SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS p FROM {LATEST_DOCS} WHERE content IS NOT NULL))),
hit AS (SELECT *, {', '.join(f'{sql_hits("low", words, weight)} AS c_{name}' for name, weight, words in L.CATEGORIES)} FROM s),
cat AS (SELECT *, {sql_best([(name, f'c_{name}') for name, _, _ in L.CATEGORIES], 'general')} AS cat, regexp_matches(s, {q(S.ENUMERATION)}) AS item FROM hit),
f AS (SELECT doc_id, i, s, low, cat, item, CASE WHEN cat <> 'general' THEN cat WHEN regexp_matches(low, {q(S.DEFINITION)}) THEN 'definition' WHEN regexp_matches(low, {q(S.EXAMPLE)}) THEN 'example' WHEN item THEN 'enumeration' ELSE 'statement' END AS kind,
  {', '.join(f'{_follow(c)} AS f_{c}' for c in _NAMES)}, regexp_matches(low, {q(S.GOES_ON)}) AS f_definition FROM cat),
n AS (SELECT *, CASE {_AHEAD} WHEN kind = 'enumeration' THEN coalesce(min(CASE WHEN NOT item THEN i END) OVER r, max(i) OVER (PARTITION BY doc_id) + 1) - i ELSE 1 END AS n
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i), r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
walk AS (SELECT doc_id, 0 AS i FROM n WHERE i = 0 UNION ALL SELECT n.doc_id, CAST(n.i + n.n AS INTEGER) FROM walk JOIN n ON walk.doc_id = n.doc_id AND walk.i = n.i)
SELECT a.doc_id, CAST(a.i AS INTEGER) AS position, CASE any_value(a.kind) WHEN 'risk' THEN 'risk_statement' {' '.join(f"WHEN '{c}' THEN '{S.FOLLOWERS[c][0]}'" for c in _NAMES)} ELSE any_value(a.kind) END AS strip_type,
  string_agg(CASE WHEN b.i = a.i THEN '' WHEN a.kind IN ('procedure', 'enumeration') THEN chr(10) WHEN a.kind = 'control' AND regexp_matches(b.s, '^\s*[-•]') AND NOT {sql_any('b.low', S.FOLLOWERS['control'][2])} THEN chr(10) ELSE ' ' END || b.s, '' ORDER BY b.i) AS content,
  any_value(a.cat) AS category, CAST(any_value(a.n) AS INTEGER) AS merged
FROM walk JOIN n a ON walk.doc_id = a.doc_id AND walk.i = a.i JOIN n b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.i < a.i + a.n GROUP BY a.doc_id, a.i"""

SQL: dict[str, str] = {"doc_strip_sections": _SECTIONS, "doc_policy_strips": _POLICY, "doc_procedure_parts": _PARTS, "doc_adaptive_strips": _ADAPTIVE}
