"""Queries of the document-analytics operators, and their SQL for comparison.

Features are computed on the rows first; redelivered rows then collapse by an aggregation
over the small feature columns, so no document text is shuffled to find the latest row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, best_of, clean, first_of, let, table_text
from kerfline.operators import answers, grading, metadata, retrieval, security, strips, structure
from kerfline.plans.sql import LATEST_DOCS, STRIPS, q, sql_any, sql_best, sql_first, sql_hits
from kerfline.session import latest_per_key, latest_rows, table

AS_OF = "2026-01-01"


META = "(SELECT DISTINCT ON (document_id) * FROM document_metadata)"
RESULTS = "(SELECT * FROM crag_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY logged_at DESC) = 1)"
RESPONSES = "(SELECT DISTINCT ON (response_id) * FROM generated_responses)"
SPACE = r"'^\s+|\s+$'"


def latest_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_rows(table(spark, sf_dir, "parsed_docs").select("doc_id", "loaded_at", *columns), "doc_id", "loaded_at")


# -- documents -------------------------------------------------------------------
def doc_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def doc_types(spark, d):
    low = F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 2000))
    name = F.lower(F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1))

    def score(v, words):
        n = F.lit(0)
        for w in words:
            n = n + v["_low"].contains(w).cast("int") + F.when(v["_name"].contains(w.replace(" ", "_")) | v["_name"].contains(w.replace(" ", "-")), 2).otherwise(0)
        return n

    v = {"_low": F.col("_low"), "_name": F.col("_name")}
    kind = best_of([(k, score(v, words)) for k, words in L.DOCUMENT_TYPES.items()], "general")
    rows = table(spark, d, "parsed_docs").select("doc_id", "loaded_at", low.alias("_low"), name.alias("_name")).select("doc_id", "loaded_at", kind.alias("kind"))
    return latest_per_key(rows, "doc_id", "loaded_at").select("doc_id", "kind")


def doc_strip_types(spark, d):
    low = F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 1000))
    rows = table(spark, d, "parsed_docs").select("doc_id", "loaded_at", let(low, lambda x: first_of(x, L.STRIP_DOCUMENT_TYPES, "general")).alias("kind"))
    return latest_per_key(rows, "doc_id", "loaded_at").select("doc_id", "kind")


def doc_sections(spark, d):
    return structure.sections(latest_docs(spark, d, "content"), "doc_id", "content")


def doc_headings(spark, d):
    return structure.headings(latest_docs(spark, d, "content"), "doc_id", "content")


def doc_without_repeats(spark, d):
    return structure.without_repeated_lines(latest_docs(spark, d, "content"), "doc_id", "content").select("doc_id", F.md5("text").alias("text_md5"))


def doc_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("cleaned"))


def doc_tables(spark, d):
    rows = latest_docs(spark, d, "tables").select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    return rows.select("doc_id", "table_no", table_text(F.col("t")).alias("content"))


def doc_paragraphs(spark, d):
    return structure.paragraphs(table(spark, d, "documents"), "doc_id", "text")


def doc_sentences(spark, d):
    return structure.sentences(table(spark, d, "documents"), "doc_id", "text")


def doc_confidence(spark, d):
    rows = table(spark, d, "parsed_docs").select("doc_id", "loaded_at", F.round(metadata.confidence(F.col("content"), F.col("parsing_errors"), F.col("tables")), 4).alias("confidence"))
    return latest_per_key(rows, "doc_id", "loaded_at").select("doc_id", "confidence")


def doc_warnings(spark, d):
    c, n = F.coalesce(F.col("content"), F.lit("")), F.coalesce(F.size("sections"), F.lit(0))
    astral = F.length(F.regexp_replace(c, r"[\x{0}-\x{FFFF}]+", ""))
    tests = [
        ("short", F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) < 100),
        ("encoding", astral > F.length(c) * 0.01),
        ("no_sections", F.coalesce(F.col("doc_type").isin("policy", "procedure", "standard"), F.lit(False)) & (n <= 0)),
        ("low_confidence", F.coalesce(F.col("confidence_score"), F.lit(0.0)) < 0.7),
    ]
    rows = table(spark, d, "parsed_docs").select("doc_id", "loaded_at", F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests])).alias("w"))
    return latest_per_key(rows, "doc_id", "loaded_at").select("doc_id", F.explode("w").alias("warning"))


def parsing_report(spark, d):
    return metadata.parsing_report(latest_docs(spark, d, "doc_type", "parsing_errors", "confidence_score"))


def faq_pairs(spark, d):
    pattern = F.lit("Q : ([^\n]+)\nR : ([^\n]+)")
    pair = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("question"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("answer"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(pair).alias("pair_no", "p")).select("doc_id", "pair_no", F.col("p.question"), F.col("p.answer"))


def doc_dates(spark, d):
    found = F.regexp_extract_all("text", F.lit("[0-9]{2}/[0-9]{2}/[0-9]{4}"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("mention_no", "s"))
    return rows.select("doc_id", "mention_no", F.try_to_date("s", "dd/MM/yyyy").alias("day")).where("day IS NOT NULL")


# -- strips and questions ------------------------------------------------------------
def strip_domain(spark, d):
    # lowered once, in a projection of its own
    s = table(spark, d, "knowledge_strips").select("strip_id", "content", "domain_category", "compliance_refs", "context", F.lower(F.coalesce("content", F.lit(""))).alias("_low"))
    text, low = F.coalesce(F.col("content"), F.lit("")), F.col("_low")
    refs = F.when(F.coalesce(F.size("compliance_refs"), F.lit(0)) > 0, F.array_sort("compliance_refs")).otherwise(strips.compliance_references(text))
    return s.select(
        "strip_id",
        F.when(F.coalesce("domain_category", F.lit("")) != "", F.col("domain_category")).otherwise(strips.category_of(low)).alias("category"),
        F.array_join(refs, ",").alias("refs"),
        F.array_join(strips.control_types_of(low), ",").alias("controls"),
        first_of(low, L.OBLIGATIONS, "informational").alias("obligation"),
        any_of(low, L.REQUIREMENT_WORDS).alias("is_requirement"),
        any_of(low, L.CRITICAL_WORDS).alias("is_critical"),
        strips.authority(F.coalesce(F.col("context.doc_type"), F.lit("general"))).alias("authority"),
    ).distinct()


def strip_signatures(spark, d):
    return table(spark, d, "knowledge_strips").where("content IS NOT NULL").select("strip_id", strips.signature(F.col("content")).alias("signature")).distinct()


def strip_mapped_controls(spark, d):
    return table(spark, d, "knowledge_strips").where("content IS NOT NULL").select("strip_id", F.round(strips.mapped_controls(F.col("content")), 4).alias("bonus")).distinct()


def question_contexts(spark, d):
    rows = table(spark, d, "crag_results").select("result_id", "logged_at", strips.audit_context(F.coalesce("query", F.lit(""))).alias("context"))
    return latest_per_key(rows, "result_id", "logged_at").select("result_id", "context")


def question_concepts(spark, d):
    rows = latest_per_key(table(spark, d, "crag_results").select("result_id", "query", "logged_at"), "result_id", "logged_at")
    return rows.select("result_id", F.explode(grading.concepts(F.col("query"))).alias("c")).select("result_id", F.col("c.word"), F.col("c.weight"))


def _graded(spark, d):
    results = latest_per_key(table(spark, d, "crag_results").select("result_id", "query", "logged_at"), "result_id", "logged_at").select("result_id", "query", grading.concepts(F.col("query")).alias("concepts"))
    used = table(spark, d, "generated_responses").select("response_id", "result_id", F.explode("sources_used").alias("s")).select("response_id", "result_id", F.expr("try_cast(s AS bigint)").alias("strip_id")).distinct()
    texts = table(spark, d, "knowledge_strips").select("strip_id", "content", "strip_type").dropDuplicates(["strip_id"])
    return grading.grade(used.join(results, "result_id").join(texts, "strip_id").select("response_id", "strip_id", "query", "concepts", "content", "strip_type"))


def graded_sources(spark, d):
    return _graded(spark, d).select("response_id", "strip_id", "keyword", "content_type", "score", "confidence", "relevance")


def refined_sources(spark, d):
    return grading.refine(_graded(spark, d), "response_id", "strip_id").select("response_id", "strip_id", "phase", "place")


def _refined(spark, d):
    return grading.refine(_graded(spark, d), "response_id", "strip_id")


def _covered(spark, d):
    return answers.coverage(_refined(spark, d), "response_id", security.intent(F.coalesce("query", F.lit(""))))


def answer_coverage(spark, d):
    return _covered(spark, d).drop("summary")


def answer_elements(spark, d):
    return answers.elements(_refined(spark, d), "response_id")


def answer_texts(spark, d):
    return answers.answer(answers.elements(_refined(spark, d), "response_id"), "response_id")


def answer_confidence(spark, d):
    kept = _refined(spark, d).groupBy("response_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("quality"))
    rows = table(spark, d, "generated_responses").select("response_id", "answer").dropDuplicates(["response_id"])
    rows = rows.join(kept, "response_id", "left").join(_covered(spark, d).select("response_id", "coverage"), "response_id", "left")
    c = grading.answer_confidence(F.coalesce("coverage", F.lit(0.0)), F.coalesce("n", F.lit(0)), F.coalesce("answer", F.lit("")), F.coalesce("quality", F.lit(0.0)))
    return rows.select("response_id", F.round(c, 5).alias("confidence"))


def shortened_answers(spark, d):
    return table(spark, d, "generated_responses").where("answer IS NOT NULL").select("response_id", grading.shorten(F.col("answer"), 200).alias("answer")).distinct()


# -- metadata and vectors -------------------------------------------------------------
def metadata_completeness(spark, d):
    return metadata.completeness(table(spark, d, "document_metadata")).select("document_id", "score", "status").distinct()


def metadata_lifecycle(spark, d):
    m = table(spark, d, "document_metadata").select("doc_id", "superseded_by", "version", "review_date").dropDuplicates(["doc_id"])
    texts = table(spark, d, "parsed_docs").select("doc_id", "loaded_at", metadata.lifecycle(F.col("content"), F.lit(None), F.lit(None), F.lit(None), F.lit(None)).alias("stage"))
    j = latest_per_key(texts, "doc_id", "loaded_at").join(m, "doc_id")
    rest = metadata.lifecycle(F.lit(None), F.col("superseded_by"), F.col("version"), F.col("review_date"), F.lit(AS_OF).cast("date"))
    return j.select("doc_id", F.when(F.col("stage") != "unknown", F.col("stage")).otherwise(rest).alias("stage"))


def reference_edges(spark, d):
    m = table(spark, d, "document_metadata")
    return metadata.known_references(metadata.references(m), m)


def compliance_counts(spark, d):
    return metadata.compliance_edges(table(spark, d, "document_metadata")).groupBy("framework").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("requirement").alias("requirements"), F.count(F.lit(1)).alias("edges"))


def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    near = retrieval.top_k(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)
    return near.select("query_id", "neighbour_id", "rank", F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


# -- security context, pairs, tables ------------------------------------------------------
def security_context(spark, d):
    x = security.context(table(spark, d, "parsed_docs").select("doc_id", "content", "loaded_at"), "doc_id", "content")
    x = x.withColumns({c: F.array_join(c, ",") for c in ("frameworks", "domains", "risks", "roles")})
    return latest_per_key(x, "doc_id", "loaded_at").drop("loaded_at", "requires")


def security_domain_hits(spark, d):
    return security.domain_hits(table(spark, d, "documents"), "doc_id", "text")


def pair_quality(spark, d):
    rows = table(spark, d, "crag_results").select("result_id", "logged_at", F.round(security.pair_confidence(F.col("query"), F.col("answer")), 4).alias("confidence"), let(F.lower(F.coalesce("answer", F.lit(""))), lambda x: any_of(x, L.SECURITY_KEYWORDS)).alias("has_keywords"), F.array_join(security.topics(F.concat_ws(" ", "query", "answer")), ",").alias("topics"))
    return latest_per_key(rows, "result_id", "logged_at").drop("logged_at")


def table_kinds(spark, d):
    rows = latest_docs(spark, d, "tables").select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    return rows.select("doc_id", "table_no", security.table_kind(F.col("t.data")).alias("kind"))


def table_statuses(spark, d):
    cells = latest_docs(spark, d, "tables").select("doc_id", F.explode("tables").alias("t")).select("doc_id", F.explode(F.flatten(F.slice("t.data", 2, F.size("t.data")))).alias("cell")).where("coalesce(cell, '') <> ''")
    return cells.groupBy("doc_id", security.status(F.col("cell")).alias("status")).agg(F.count(F.lit(1)).alias("cells"))


def question_intents(spark, d):
    rows = table(spark, d, "crag_results").select("result_id", "logged_at", security.intent(F.coalesce("query", F.lit(""))).alias("intent"))
    return latest_per_key(rows, "result_id", "logged_at").select("result_id", "intent")


def audited_sources(spark, d):
    results = latest_per_key(table(spark, d, "crag_results").select("result_id", strips.audit_context(F.coalesce("query", F.lit(""))).alias("context"), "logged_at"), "result_id", "logged_at").select("result_id", F.col("context").alias("audit"))
    used = table(spark, d, "generated_responses").select("response_id", "result_id", F.explode("sources_used").alias("s")).select("response_id", "result_id", F.expr("try_cast(s AS bigint)").alias("strip_id")).distinct()
    kinds = table(spark, d, "knowledge_strips").groupBy("strip_id").agg(F.first("context.doc_type").alias("doc_type"), F.first("context.is_official").alias("official"))
    j = _graded(spark, d).join(used.select("response_id", "result_id").distinct(), "response_id").join(results, "result_id").join(kinds, "strip_id")
    bonus = strips.audit_bonus(F.col("audit"), F.col("doc_type"), F.col("official"), F.coalesce("content", F.lit("")), F.col("score"))
    return j.select("response_id", "strip_id", "audit", F.round(bonus, 6).alias("score"))


def documents_per_day(spark, d):
    from kerfline.streaming.ingest import daily_documents

    return daily_documents(spark, f"{d}/parsed_docs.parquet")


QUERIES = {f.__name__: f for f in (doc_hashes, doc_types, doc_strip_types, doc_sections, doc_headings, doc_without_repeats, doc_clean, doc_tables, doc_paragraphs, doc_sentences, doc_confidence, doc_warnings, parsing_report, faq_pairs, doc_dates, strip_domain, strip_signatures, strip_mapped_controls, question_contexts, question_concepts, graded_sources, refined_sources, answer_coverage, answer_elements, answer_texts, answer_confidence, shortened_answers, metadata_completeness, metadata_lifecycle, reference_edges, compliance_counts, nearest_vectors, documents_per_day, security_context, security_domain_hits, pair_quality, table_kinds, table_statuses, question_intents, audited_sources)}

# -- SQL --------------------------------------------------------------------------------
_KINDS = list(L.DOCUMENT_TYPES)
_name_hits = lambda w: "(" + " + ".join(f"(CASE WHEN contains(f, {q(x.replace(' ', '_'))}) OR contains(f, {q(x.replace(' ', '-'))}) THEN 2 ELSE 0 END)" for x in w) + ")"
_LINES = f"""SELECT doc_id, i - 1 AS line_no, raw, regexp_replace(raw, {SPACE}, '', 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {LATEST_DOCS} WHERE content IS NOT NULL)"""
_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\r]+'), lambda x: x <> '')"
_CONCEPTS = f"""SELECT DISTINCT result_id, w AS word, CASE WHEN w IN ({', '.join(map(q, L.QUESTION_WORDS))}) THEN 0.3 WHEN ends_with(w, 'ent') THEN 0.8 ELSE 1.0 END::DOUBLE AS weight
  FROM (SELECT result_id, unnest({_WORDS.format('lower(query)')}) AS w FROM {RESULTS}) WHERE w NOT IN ({', '.join(map(q, L.STOP_WORDS))})"""
_GRADED = f"""WITH used AS (SELECT DISTINCT response_id, result_id, TRY_CAST(s AS BIGINT) AS strip_id FROM (SELECT response_id, result_id, unnest(sources_used) AS s FROM generated_responses)),
concepts AS ({_CONCEPTS}),
pairs AS (SELECT response_id, strip_id, result_id, lower(r.query) AS q, coalesce(content, '') AS content, lower(coalesce(content, '')) AS low, strip_type
  FROM used JOIN {RESULTS} r USING (result_id) JOIN {STRIPS} USING (strip_id)),
words AS (SELECT response_id, strip_id, round(coalesce(sum(CASE WHEN contains(low, word) THEN weight
    WHEN contains(low, word || 's') OR (ends_with(word, 's') AND contains(low, rtrim(word, 's'))) THEN 0.8 * weight
    WHEN length(word) > 4 AND contains(low, substr(word, 1, 4)) THEN 0.5 * weight ELSE 0 END) / sum(weight), 0), 9) AS keyword
  FROM pairs LEFT JOIN concepts USING (result_id) GROUP BY ALL),
scored AS (SELECT p.*, keyword, len({_WORDS.format('content')}) AS n, (CASE
    WHEN contains(q, 'comment') AND (contains(q, 'fonctionne') OR contains(q, 'marche')) AND strip_type = 'definition' THEN 0.8
    WHEN NOT (contains(q, 'comment') AND (contains(q, 'fonctionne') OR contains(q, 'marche'))) AND {sql_any('q', ["qu'est-ce", "quoi", "définition"])} AND strip_type = 'definition' THEN 0.9
    WHEN NOT (contains(q, 'comment') AND (contains(q, 'fonctionne') OR contains(q, 'marche'))) AND NOT {sql_any('q', ["qu'est-ce", "quoi", "définition"])} AND contains(q, 'exemple') AND NOT contains(q, 'pourquoi') AND strip_type = 'example' THEN 0.9
    WHEN strip_type = 'definition' THEN 0.6 WHEN strip_type = 'example' THEN 0.4 ELSE 0.5 END)::DOUBLE AS content_type
  FROM pairs p JOIN words USING (response_id, strip_id)),
means AS (SELECT *, (keyword * 0.30 + content_type * 0.20) / 0.5 AS mean, (keyword + content_type) / 2 AS centre FROM scored),
step1 AS (SELECT *, CASE WHEN n < 5 THEN mean * 0.7 ELSE mean END AS s1 FROM means),
step2 AS (SELECT *, CASE WHEN contains(q, 'comment') AND contains(q, 'fonctionne') AND {sql_any('low', ['utilise', 'permet', 'mécanisme', 'processus'])} THEN least(1.0::DOUBLE, s1 * 1.2) ELSE s1 END AS s2 FROM step1),
graded AS (SELECT response_id, strip_id, q, content, low, strip_type, keyword, content_type,
  round(CASE WHEN (contains(q, 'comment') OR contains(q, 'fonctionnement')) AND n < 20 AND regexp_matches(low, '(^|[^0-9A-Za-z_])(19|20)[0-9]{{2}}([^0-9A-Za-z_]|$)') THEN s2 * 0.5 ELSE s2 END, 9) AS score,
  round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1 - 2 * ((keyword - centre) ** 2 + (content_type - centre) ** 2) / 2)), 9) AS confidence FROM step2)"""
_SIGNATURE = "array_to_string(list_sort(list_transform(list_slice(list_sort(list_transform(w, lambda x, i: {{'n': -length(x), 'i': i, 'w': x}})), 1, 5), lambda s: s.w)), ' ')".replace("{{", "{").replace("}}", "}")
_REFINED = (
    _GRADED
    + f""", kept AS (SELECT *, max(CASE WHEN strip_type = 'example' AND score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY response_id ORDER BY score DESC, strip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ex FROM graded),
sig AS (SELECT *, {_SIGNATURE} AS signature FROM (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]{{4,}}') AS w FROM kept WHERE score >= 0.5 OR (score >= 0.4 AND (strip_type IN ('definition', 'enumeration') OR (strip_type = 'example' AND coalesce(ex, 0) = 0))))),
one AS (SELECT *, CASE WHEN strip_type = 'definition' THEN 1 WHEN {sql_any('low', L.MECHANISM_WORDS)} THEN 2 WHEN strip_type = 'enumeration' THEN 3 WHEN {sql_any('low', ['exemple', 'bert', 'gpt'])} THEN 4 ELSE 5 END AS phase
  FROM sig QUALIFY row_number() OVER (PARTITION BY response_id, signature ORDER BY score DESC, strip_id) = 1),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY response_id ORDER BY phase, score DESC, strip_id) AS INTEGER) AS place FROM one QUALIFY place <= 10)"""
)
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(q, {q('|'.join(p))}) THEN {q(k)}" for k, p in reversed(L.QUESTION_INTENTS.items())) + " ELSE 'general' END"


def _need_sql(need: str) -> str:
    words, pattern, types = answers.NEEDS[need]
    return "(" + " OR ".join([sql_any("low", words), *([f"regexp_matches(low, {q(pattern)})"] if pattern else []), *([f"coalesce(strip_type, '') IN ({', '.join(map(q, types))})"] if types else [])]) + ")"


def _list_sql(names: list[str]) -> str:
    return "[" + ", ".join(map(q, names)) + "]"


_COVERED = (
    _REFINED
    + rf""", told AS (SELECT *, {_INTENT} AS intent, list_filter(string_split_regex(q, '\s+'), lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(q, answers.NO_CONCEPTS))})) AS words FROM placed),
grouped AS (SELECT response_id, any_value(intent) AS intent, any_value(words) AS words, count(*) AS n, count(*) FILTER (score >= 0.7) AS good, max(score) AS top, string_agg(low, chr(1)) AS every,
  list_filter([{', '.join(f"CASE WHEN bool_or{_need_sql(need)} THEN {q(need)} END" for need in answers.NEEDS)}], lambda x: x IS NOT NULL) AS met,
  CASE any_value(intent) {' '.join(f"WHEN {q(k)} THEN {_list_sql(v)}" for k, v in answers.ESSENTIAL.items())} ELSE [] END AS need,
  CASE any_value(intent) {' '.join(f"WHEN {q(k)} THEN {_list_sql(v)}" for k, v in answers.OPTIONAL.items())} ELSE [] END AS may FROM told GROUP BY response_id),
found AS (SELECT response_id, count(DISTINCT CASE WHEN contains(low, w) THEN i END) AS found FROM (SELECT response_id, low, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM told) GROUP BY 1),
rated AS (SELECT *, list_filter(list_concat(need, may), lambda x: list_contains(met, x)) AS covered, list_filter(need, lambda x: NOT list_contains(met, x)) AS missing FROM grouped),
based AS (SELECT *, CASE WHEN len(need) > 0 THEN (len(need) - len(missing)) / len(need) WHEN n >= 3 AND top > 0.7 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS plain FROM rated),
blended AS (SELECT based.*, CASE WHEN good >= 3 THEN least(1.0::DOUBLE, plain * 1.2::DOUBLE) ELSE plain END AS base, coalesce(found, 0) AS found FROM based LEFT JOIN found USING (response_id)),
scored2 AS (SELECT *, CASE WHEN len(words) > 0 THEN base * 0.7::DOUBLE + found / len(words) * 0.3::DOUBLE ELSE base END AS coverage FROM blended),
decided AS (SELECT *, NOT (coverage >= 0.8 OR good >= 4 OR (len(need) > 0 AND len(missing) <= len(need) / 2)) AND (n < 3 OR coverage < 0.6) AS needs_more FROM scored2)"""
)
_ELEMENTS = (
    _REFINED
    + rf""", named AS (SELECT *, CASE WHEN coalesce(strip_type, '') = 'definition' THEN 'definition' WHEN {sql_any('low', ['mécanisme', 'utilise'])} THEN 'mechanism' WHEN coalesce(strip_type, '') = 'enumeration' OR contains(content, '- ') THEN 'components'
  WHEN {sql_any('low', ['bert', 'gpt', 'exemple'])} THEN 'example' WHEN {sql_any('low', answers.DETAIL_WORDS)} THEN 'details' WHEN {sql_any('low', answers.REASON_WORDS)} THEN 'reason' WHEN {sql_any('low', answers.GAIN_WORDS)} THEN 'gains' END AS part,
  CASE WHEN place <= 5 AND {sql_any('low', answers.KEY_WORDS)} THEN regexp_replace(list_filter(string_split(content, '.'), lambda s: {sql_any('lower(s)', answers.KEY_WORDS[:2])})[1], {SPACE}, '', 'g') || '.' END AS point FROM placed),
parts0 AS (SELECT response_id, {', '.join(f"arg_min(content, place) FILTER (part = '{p}') AS {p}" for p in ('definition', 'mechanism', 'example', 'reason', 'gains'))}, arg_max(content, place) FILTER (part = 'components') AS components,
  coalesce(string_agg(content, chr(10) || chr(10) ORDER BY place) FILTER (part = 'details'), '') AS details, coalesce(array_to_string(list(point ORDER BY place) FILTER (point IS NOT NULL)[1:3], chr(10)), '') AS key_points FROM named GROUP BY response_id),
parts AS (SELECT *, split_part(definition, '.', 1) || '.' AS short_definition, split_part(example, '.', 1) || '.' AS short_example,
  CASE WHEN len(list_filter(string_split_regex(mechanism, '\s+'), lambda x: x <> '')) <= 50 THEN mechanism ELSE array_to_string(list_filter(string_split_regex(mechanism, '\s+'), lambda x: x <> '')[1:50], ' ') || '...' END AS short_mechanism,
  CASE WHEN definition IS NULL THEN NULL WHEN regexp_extract(definition, '([\p{{L}}\p{{N}}_\s]+)\s+(?:est|sont)', 1) <> '' THEN regexp_replace(regexp_extract(definition, '([\p{{L}}\p{{N}}_\s]+)\s+(?:est|sont)', 1), {SPACE}, '', 'g')
    ELSE array_to_string(list_filter(string_split_regex(definition, '\s+'), lambda x: x <> '')[1:3], ' ') END AS subject,
  regexp_replace(CASE {' '.join(f"WHEN regexp_extract(lower(mechanism), '{p}', 1) <> '' THEN regexp_extract(lower(mechanism), '{p}', 1)" for p in answers.MECHANISMS)} ELSE 'leur mécanisme spécifique' END, {SPACE}, '', 'g') AS key_mechanism FROM parts0)"""
)
_ELEMENT_COLUMNS = "response_id, definition, mechanism, example, reason, gains, components, details, key_points, short_definition, short_mechanism, short_example, subject, key_mechanism"
_named = lambda t: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {sql_any('low', [x.lower() for x in w])} THEN {q(k)} END" for k, w in t.items()) + "], lambda x: x IS NOT NULL)), ',')"
_count_named = lambda t: "(" + " + ".join(f"(CASE WHEN {sql_any('low', [x.lower() for x in w])} THEN 1 ELSE 0 END)" for w in t.values()) + ")"
_MAPPED = " + ".join(f"len(list_filter(iso, lambda c: c = {q(c)})) * len(list_filter(other, lambda c: c IN ({', '.join(map(q, p))})))" for c, p in L.CONTROL_MAPPING.items())


def _audit_case(rule) -> str:
    name, required, preferred, weights, formal = rule
    weight = "CASE " + " ".join(f"WHEN kind = {q(k)} THEN {v}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"
    score = f"base * {weight} + least(0.2::DOUBLE, 0.05::DOUBLE * {sql_hits('low', required)}) + least(0.1::DOUBLE, 0.02::DOUBLE * {sql_hits('low', preferred)})"
    score += " + CASE WHEN official THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END" * formal + " + mapped" * (name in ("iso_27001", "rgpd_gdpr"))
    return f"WHEN audit = {q(name)} THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score}))"


SQL = {
    "doc_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "doc_types": f"""SELECT doc_id, {sql_best([(k, f's{i}') for i, k in enumerate(_KINDS)], 'general')} AS kind FROM (
SELECT doc_id, {', '.join(f"{sql_hits('low', L.DOCUMENT_TYPES[k])} + {_name_hits(L.DOCUMENT_TYPES[k])} AS s{i}" for i, k in enumerate(_KINDS))}
FROM (SELECT doc_id, lower(substr(coalesce(content, ''), 1, 2000)) AS low, lower(string_split(coalesce(source_path, ''), '/')[-1]) AS f FROM {LATEST_DOCS}))""",
    "doc_strip_types": f"SELECT doc_id, {sql_first('low', L.STRIP_DOCUMENT_TYPES, 'general')} AS kind FROM (SELECT doc_id, lower(substr(coalesce(content, ''), 1, 1000)) AS low FROM {LATEST_DOCS})",
    "doc_sections": rf"""WITH l AS ({_LINES}),
t AS (SELECT *, regexp_full_match(line, '#+\s+.+|[0-9]+\.(?:[0-9]+\.)*\s+.+|[A-Z][A-Z\s]+|(?:Article|Section|Chapitre)\s+[0-9]+\s*:\s*.+') AS is_title FROM l WHERE line <> ''),
s AS (SELECT *, sum(is_title::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM t),
g AS (SELECT doc_id, section, CAST(min(line_no) AS INTEGER) AS start_line, arg_min(line, line_no) AS title, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_title), '') AS content FROM s WHERE section > 0 GROUP BY ALL)
SELECT doc_id, start_line, title, CAST(CASE WHEN starts_with(title, '#') THEN length(title) - length(ltrim(title, '#')) WHEN regexp_matches(title, '^[0-9]+\.') THEN length(title) - length(replace(title, '.', '')) + 1
  WHEN starts_with(title, 'Article') OR starts_with(title, 'Chapitre') THEN 1 WHEN starts_with(title, 'Section') THEN 2 WHEN upper(title) = title AND lower(title) <> title AND length(title) > 3 THEN 1 ELSE 3 END AS INTEGER) AS level, content FROM g""",
    "doc_headings": rf"""WITH h AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) - length(ltrim(line, '#')) AS INTEGER) AS level, regexp_replace(line, '^#+\s+', '') AS title FROM ({_LINES}) WHERE regexp_matches(line, '^#{{1,6}}\s+\S'))
SELECT h.doc_id, h.line_no, h.level, h.title, (SELECT max(p.line_no) FROM h p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.level < h.level) AS parent_line FROM h""",
    "doc_without_repeats": f"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM ({_LINES}) JOIN (SELECT doc_id, (length(content) - length(replace(content, '[Page ', ''))) / 6 AS pages FROM {LATEST_DOCS}) USING (doc_id))
SELECT doc_id, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS text_md5 FROM x WHERE line = '' OR length(line) >= 100 OR n <= greatest(2.0, pages * 0.3) GROUP BY doc_id""",
    "doc_clean": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
'([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g'), '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g') AS cleaned FROM documents""",
    "doc_tables": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS table_no, CASE WHEN len(data) > 0 THEN array_to_string(list_concat(['Tableau avec colonnes : ' || array_to_string(list_transform(data[1], lambda c: coalesce(c, '')), ' | ')],
list_transform(data[2:], lambda r: array_to_string(list_transform(r, lambda c: CASE WHEN coalesce(c, '') = '' THEN '-' ELSE c END), ' | '))), chr(10)) ELSE '' END AS content
FROM (SELECT doc_id, i, t.data AS data FROM (SELECT doc_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS i FROM {LATEST_DOCS}))""",
    "doc_paragraphs": rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, p AS content FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, {SPACE}, '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL))""",
    "doc_sentences": rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, p AS content FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {SPACE}, '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL))""",
    "doc_confidence": f"""SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * coalesce(len(parsing_errors), 0) - CASE WHEN length(t) < 100 THEN 0.3::DOUBLE WHEN length(t) < 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
+ CASE WHEN coalesce(len(tables), 0) > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN length(t) > 0 AND length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) / length(t) < 0.5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
- CASE WHEN {sql_hits('lower(t)', L.SANITY_WORDS)} < 3 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS confidence FROM (SELECT *, coalesce(content, '') AS t FROM {LATEST_DOCS})""".replace("\\\\", "\\"),
    "doc_warnings": rf"""SELECT doc_id, unnest(list_filter([CASE WHEN length(regexp_replace(t, {SPACE}, '', 'g')) < 100 THEN 'short' END, CASE WHEN length(regexp_replace(t, '[\x{{0}}-\x{{FFFF}}]+', '', 'g')) > length(t) * 0.01 THEN 'encoding' END,
CASE WHEN doc_type IN ('policy', 'procedure', 'standard') AND coalesce(len(sections), 0) <= 0 THEN 'no_sections' END, CASE WHEN coalesce(confidence_score, 0) < 0.7 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS warning
FROM (SELECT *, coalesce(content, '') AS t FROM {LATEST_DOCS})""",
    "parsing_report": f"""SELECT coalesce(lower(trim(doc_type)), 'unknown') AS doc_type, count(*) AS documents, count(*) FILTER (coalesce(len(parsing_errors), 0) = 0) AS without_errors, CAST(sum(coalesce(len(parsing_errors), 0)) AS BIGINT) AS messages,
round(avg(confidence_score), 4) AS mean_confidence FROM {LATEST_DOCS} GROUP BY 1""",
    "faq_pairs": r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pair_no, question, answer FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'Q : ([^\n]+)\nR : ([^\n]+)', 1)) AS question, unnest(regexp_extract_all(text, 'Q : ([^\n]+)\nR : ([^\n]+)', 2)) AS answer,
generate_subscripts(regexp_extract_all(text, 'Q : ([^\n]+)\nR : ([^\n]+)', 1), 1) AS i FROM documents WHERE text IS NOT NULL)""",
    "doc_dates": """SELECT doc_id, CAST(i - 1 AS INTEGER) AS mention_no, CAST(try_strptime(s, '%d/%m/%Y') AS DATE) AS day FROM (SELECT doc_id, unnest(m) AS s, generate_subscripts(m, 1) AS i FROM (
SELECT doc_id, regexp_extract_all(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}') AS m FROM documents WHERE text IS NOT NULL)) WHERE try_strptime(s, '%d/%m/%Y') IS NOT NULL""",
    "strip_domain": f"""SELECT DISTINCT strip_id, CASE WHEN coalesce(domain_category, '') <> '' THEN domain_category ELSE {sql_best([(n, f'c{i}') for i, (n, _, _) in enumerate(L.CATEGORIES)], 'general')} END AS category,
array_to_string(list_sort(CASE WHEN coalesce(len(compliance_refs), 0) > 0 THEN compliance_refs ELSE list_filter([{', '.join(map(q, L.FRAMEWORKS))}], lambda f: contains(upper(t), upper(f))) END), ',') AS refs,
array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {sql_any('low', w)} THEN {q(n)} END" for n, w in L.CONTROL_TYPES.items())}], lambda x: x IS NOT NULL)), ',') AS controls,
{sql_first('low', L.OBLIGATIONS, 'informational')} AS obligation, {sql_any('low', L.REQUIREMENT_WORDS)} AS is_requirement, {sql_any('low', L.CRITICAL_WORDS)} AS is_critical,
(CASE {' '.join(f"WHEN doc_kind = {q(n)} THEN {v}" for n, v in L.AUTHORITY.items())} ELSE 0.3 END)::DOUBLE AS authority
FROM (SELECT *, {', '.join(f"{sql_hits('low', w, k)} AS c{i}" for i, (_, k, w) in enumerate(L.CATEGORIES))} FROM (SELECT *, coalesce(content, '') AS t, lower(coalesce(content, '')) AS low, coalesce(context.doc_type, 'general') AS doc_kind FROM knowledge_strips))""",
    "strip_signatures": f"SELECT DISTINCT strip_id, {_SIGNATURE} AS signature FROM (SELECT strip_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS w FROM knowledge_strips WHERE content IS NOT NULL)",
    "strip_mapped_controls": r"""SELECT DISTINCT strip_id, round(least(0.15::DOUBLE, 0.05::DOUBLE * (%s)), 4) AS bonus FROM (SELECT strip_id, regexp_extract_all(content, 'A\.[0-9]+(?:\.[0-9]+)?') AS iso,
list_concat(regexp_extract_all(content, '[A-Z]{2}-[0-9]+'), regexp_extract_all(content, 'CIS\s+[0-9]+')) AS other FROM knowledge_strips WHERE content IS NOT NULL)"""
    % " + ".join(f"len(list_filter(iso, lambda c: c = {q(c)})) * len(list_filter(other, lambda c: c IN ({', '.join(map(q, p))})))" for c, p in L.CONTROL_MAPPING.items()),
    "question_contexts": f"""SELECT result_id, {sql_best([(n, f'c{i}') for i, n in enumerate(L.CONTEXT_PATTERNS)], 'compliance_general')} AS context FROM (SELECT result_id, {', '.join(' + '.join(f"regexp_matches(low, {q(p)})::INT" for p in ps) + f' AS c{i}' for i, ps in enumerate(L.CONTEXT_PATTERNS.values()))}
FROM (SELECT result_id, lower(coalesce(query, '')) AS low FROM {RESULTS}))""",
    "question_concepts": _CONCEPTS,
    "graded_sources": _GRADED
    + " SELECT response_id, strip_id, keyword, content_type, score, confidence, CASE "
    + " ".join(f"WHEN score >= {v} THEN {q(n)}" for n, v in L.RELEVANCE)
    + " ELSE 'not_relevant' END AS relevance FROM graded",
    "refined_sources": _REFINED + " SELECT response_id, strip_id, phase, place FROM placed",
    "answer_coverage": _COVERED + " SELECT response_id, intent, n, array_to_string(covered, ',') AS covered, array_to_string(missing, ',') AS missing, round(coverage, 6) AS coverage, needs_more FROM decided",
    "answer_elements": _ELEMENTS + f" SELECT {_ELEMENT_COLUMNS} FROM parts",
    "answer_texts": _ELEMENTS
    + """ SELECT response_id, concat_ws(chr(10) || chr(10), nullif(definition, ''), 'Fonctionnement : ' || nullif(mechanism, ''), nullif(details, ''), nullif(components, ''), 'Exemple : ' || nullif(example, ''), nullif(reason, ''), nullif(gains, '')) AS answer FROM parts""",
    "answer_confidence": _COVERED
    + f""", per AS (SELECT response_id, count(*) AS n, avg(score) AS quality, any_value(coverage) AS coverage FROM placed JOIN (SELECT response_id, round(coverage, 6) AS coverage FROM decided) USING (response_id) GROUP BY 1),
f AS (SELECT response_id, coalesce(coverage, 0) AS c, coalesce(n, 0) AS n, coalesce(quality, 0) AS g, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs(length(coalesce(answer, '')) - 300) / 300)) AS l FROM {RESPONSES} LEFT JOIN per USING (response_id))
SELECT response_id, round(CASE WHEN n > 0 THEN (c + least(n / 5, 1.0::DOUBLE) + l + g) / 4 ELSE (c + least(n / 5, 1.0::DOUBLE) + l) / 3 END, 5) AS confidence FROM f""",
    "shortened_answers": rf"""WITH t AS (SELECT DISTINCT response_id, CASE WHEN t <> '' AND right(t, 1) NOT IN ('.', '!', '?') THEN t || '.' ELSE t END AS t FROM (SELECT response_id, regexp_replace(regexp_replace(answer, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g') AS t FROM generated_responses WHERE answer IS NOT NULL)),
p AS (SELECT response_id, x, i, sum(length(x) + 1) OVER (PARTITION BY response_id ORDER BY i) AS total FROM (SELECT response_id, unnest(string_split(t, '.')) AS x, generate_subscripts(string_split(t, '.'), 1) AS i FROM t)),
c AS (SELECT response_id, string_agg(x || '.', '' ORDER BY i) AS cut FROM p WHERE total <= 200 GROUP BY 1)
SELECT response_id, CASE WHEN length(t) > 200 THEN regexp_replace(coalesce(cut, ''), {SPACE}, '', 'g') ELSE t END AS answer FROM t LEFT JOIN c USING (response_id)""",
    "metadata_completeness": f"""SELECT DISTINCT document_id, score, CASE WHEN score >= 0.8 THEN 'validated' WHEN score >= 0.5 THEN 'partial' ELSE 'incomplete' END AS status FROM (SELECT document_id, round(0.0::DOUBLE
{' '.join(f"+ CASE WHEN {t} THEN {L.QUALITY_WEIGHTS[n]}::DOUBLE ELSE 0.0::DOUBLE END" for n, t in {"has_version": "coalesce(version, '') <> ''", "has_date": "(creation_date IS NOT NULL OR last_modified IS NOT NULL)", "has_author": "coalesce(author, '') <> ''", "has_approver": "coalesce(approver, '') <> ''", "has_classification": "coalesce(classification_level, '') <> 'Internal'", "has_references": "(coalesce(len(related_documents), 0) > 0 OR coalesce(len(supersedes), 0) > 0)", "has_doc_code": "coalesce(document_code, '') <> ''", "has_owner": "coalesce(owner, '') <> ''"}.items())}, 4) AS score FROM document_metadata)""",
    "metadata_lifecycle": f"""SELECT doc_id, CASE {' '.join(f"WHEN {sql_any('low', w)} THEN {q(s)}" for s, w in L.LIFECYCLE.items())} WHEN coalesce(superseded_by, '') <> '' THEN 'obsolete' WHEN contains(lower(coalesce(version, '')), 'draft') THEN 'draft'
WHEN review_date > DATE '{AS_OF}' THEN 'active' ELSE 'unknown' END AS stage FROM (SELECT doc_id, lower(coalesce(content, '')) AS low FROM {LATEST_DOCS}) JOIN (SELECT DISTINCT ON (doc_id) doc_id, superseded_by, version, review_date FROM document_metadata) USING (doc_id)""",
    "reference_edges": """SELECT DISTINCT document_code, relation, reference FROM (SELECT document_code, 'supersedes' AS relation, unnest(supersedes) AS reference FROM document_metadata UNION ALL SELECT document_code, 'related', unnest(related_documents) FROM document_metadata
UNION ALL SELECT document_code, 'superseded_by', superseded_by FROM document_metadata) WHERE document_code IS NOT NULL AND reference IS NOT NULL AND reference <> '' AND reference IN (SELECT document_code FROM document_metadata)""",
    "compliance_counts": """SELECT framework, count(DISTINCT document_id) AS documents, count(DISTINCT requirement) AS requirements, count(*) AS edges FROM (SELECT DISTINCT document_id, e.key AS framework, unnest(e.value) AS requirement FROM (SELECT document_id, unnest(map_entries(compliance_mappings)) AS e FROM document_metadata)) GROUP BY 1""",
    "nearest_vectors": """SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5""",
    "documents_per_day": f"""SELECT CAST(date_trunc('day', parsing_timestamp) AS DATE) AS day, coalesce(lower(trim(doc_type)), 'unknown') AS doc_type, count(DISTINCT doc_id) AS documents FROM parsed_docs WHERE parsing_timestamp IS NOT NULL GROUP BY 1, 2""",
    "security_context": f"""SELECT doc_id, frameworks, domains, risks, roles, vulnerabilities, security_kind, least(10, i) AS importance, (i >= 7 OR contains(risks, 'Critique') OR vulnerabilities > 0) AS is_critical FROM (
SELECT *, 2 * nf + CASE WHEN requires THEN 3 ELSE 0 END + CASE WHEN contains(risks, 'Critique') THEN 5 WHEN contains(risks, 'Élevé') THEN 3 ELSE 0 END + CASE WHEN contains(roles, 'RSSI') OR contains(roles, 'DPO') THEN 2 ELSE 0 END AS i FROM (
SELECT doc_id, {_named(L.FRAMEWORK_VARIANTS)} AS frameworks, {_count_named(L.FRAMEWORK_VARIANTS)} AS nf, {_named(L.SECURITY_DOMAINS)} AS domains, {_named(L.RISK_LEVELS)} AS risks, {_named(L.SECURITY_ROLES)} AS roles,
CAST(len(regexp_extract_all(t, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}')) AS INTEGER) AS vulnerabilities, {sql_any('low', L.REQUIREMENT_WORDS)} AS requires, {sql_first('low', L.SECURITY_DOCUMENT_TYPES, 'other')} AS security_kind
FROM (SELECT doc_id, coalesce(content, '') AS t, lower(coalesce(content, '')) AS low FROM {LATEST_DOCS})))""",
    "security_domain_hits": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, {q(k)} AS domain, {sql_hits('lower(text)', [x.lower() for x in w])} AS hits FROM documents WHERE text IS NOT NULL" for k, w in L.SECURITY_DOMAINS.items()) + ") WHERE hits > 0",
    "pair_quality": f"""SELECT result_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - CASE WHEN NOT ends_with(q, '?') AND NOT {sql_any('lower(q)', ['comment', 'pourquoi', 'what', 'how'])} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN n < 5 THEN 0.3::DOUBLE WHEN n > 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
- CASE WHEN shared < 2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS confidence, {sql_any('lower(a)', L.SECURITY_KEYWORDS)} AS has_keywords, array_to_string(list_slice(list_filter([{', '.join(f"CASE WHEN {sql_any('both_low', w)} THEN {q(k)} END" for k, w in L.TOPICS.items())}], lambda x: x IS NOT NULL), 1, 5), ',') AS topics
FROM (SELECT result_id, coalesce(query, '') AS q, coalesce(answer, '') AS a, lower(concat_ws(' ', query, answer)) AS both_low, len({_WORDS.format("coalesce(answer, '')")}) AS n,
len(list_distinct(list_intersect({_WORDS.format("lower(coalesce(query, ''))")}, {_WORDS.format("lower(coalesce(answer, ''))")}))) AS shared FROM {RESULTS})""",
    "table_kinds": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS table_no, CASE WHEN greatest(c, r, v) < 2 THEN 'generic' WHEN c = greatest(c, r, v) THEN 'control_matrix' WHEN r = greatest(c, r, v) THEN 'risk_register' ELSE 'inventory' END AS kind FROM (
SELECT doc_id, i, {', '.join(f"coalesce(len(list_filter(head, lambda c: regexp_matches(lower(coalesce(c, '')), {q(p)}))), 0) AS {n}" for n, p in zip('crv', L.SHEET_HEADERS.values(), strict=True))}
FROM (SELECT doc_id, i, list_filter(t.data, lambda r: len(list_filter(r, lambda c: coalesce(c, '') <> '')) > 0)[1] AS head FROM (SELECT doc_id, unnest(tables) AS t, generate_subscripts(tables, 1) AS i FROM {LATEST_DOCS})))""",
    "table_statuses": f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(lower(cell), {q(p)}) THEN {q(k)}" for k, p in L.STATUS.items())} ELSE 'non_défini' END AS status, count(*) AS cells FROM (
SELECT doc_id, unnest(flatten(t.data[2:])) AS cell FROM (SELECT doc_id, unnest(tables) AS t FROM {LATEST_DOCS})) WHERE coalesce(cell, '') <> '' GROUP BY 1, 2""",
    "question_intents": f"""SELECT result_id, CASE {' '.join(f"WHEN regexp_matches(lower(coalesce(query, '')), {q('|'.join(p))}) THEN {q(k)}" for k, p in reversed(L.QUESTION_INTENTS.items()))} ELSE 'general' END AS intent FROM {RESULTS}""",
    "audited_sources": _GRADED
    + rf""",
ctx AS (SELECT result_id, {sql_best([(n, f'c{i}') for i, n in enumerate(L.CONTEXT_PATTERNS)], 'compliance_general')} AS audit FROM (SELECT result_id, {', '.join(' + '.join(f"regexp_matches(low, {q(p)})::INT" for p in ps) + f' AS c{i}' for i, ps in enumerate(L.CONTEXT_PATTERNS.values()))}
  FROM (SELECT result_id, lower(coalesce(query, '')) AS low FROM {RESULTS}))),
j AS (SELECT response_id, strip_id, audit, context.doc_type AS kind, coalesce(context.is_official, false) AS official, coalesce(content, '') AS t, lower(coalesce(content, '')) AS low, g.score AS base FROM used JOIN ctx USING (result_id) JOIN {STRIPS} USING (strip_id) JOIN (SELECT response_id, strip_id, score FROM graded) g USING (response_id, strip_id)),
m AS (SELECT *, least(0.15::DOUBLE, 0.05::DOUBLE * ({_MAPPED})) AS mapped FROM (SELECT *, regexp_extract_all(t, 'A\.[0-9]+(?:\.[0-9]+)?') AS iso, list_concat(regexp_extract_all(t, '[A-Z]{{2}}-[0-9]+'), regexp_extract_all(t, 'CIS\s+[0-9]+')) AS other FROM j))
SELECT response_id, strip_id, audit, round(CASE {' '.join(_audit_case(r) for r in L.AUDIT_RULES)} ELSE base END, 6) AS score FROM m""",
}
