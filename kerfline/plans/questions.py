"""Queries of question lists and of what an answer's sources leave out, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerfline.functions import lexicon as L
from kerfline.operators import questions as Q
from kerfline.operators import strips
from kerfline.plans import reference
from kerfline.plans.sql import q
from kerfline.session import latest_per_key, table


def faq_entries(spark, d):
    return Q.entries(table(spark, d, "documents"), "doc_id", "text")


def faq_formats(spark, d):
    return Q.lines_of(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "format")


def faq_sections(spark, d):
    return Q.sections(faq_entries(spark, d), "doc_id").withColumn("answer_words", F.round("answer_words", 6))


def missing_elements(spark, d):
    """Required and preferred elements of a question's audit context that none of an answer's sources names, three of each."""
    contexts = latest_per_key(table(spark, d, "crag_results").select("result_id", strips.audit_context(F.coalesce("query", F.lit(""))).alias("context"), "logged_at"), "result_id", "logged_at").select("result_id", "context")
    asked = table(spark, d, "generated_responses").select("response_id", "result_id").distinct().join(contexts, "result_id").select("response_id", "context")
    # at most the sources of one answer
    told = reference._graded(spark, d).groupBy("response_id").agg(F.array_join(F.collect_list(F.lower(F.coalesce("content", F.lit("")))), "\n").alias("told"))
    j = told.join(asked, "response_id")
    required, preferred = F.when(F.lit(False), F.array().cast("array<string>")), F.when(F.lit(False), F.array().cast("array<string>"))
    for name, must, may, _, _ in L.AUDIT_RULES:
        required, preferred = required.when(F.col("context") == name, F.array(*[F.lit(w) for w in must])), preferred.when(F.col("context") == name, F.array(*[F.lit(w) for w in may]))
    left = lambda c: F.array_join(F.slice(F.filter(c, lambda w: ~F.contains(F.col("told"), w)), 1, 3), ",")
    none = F.array().cast("array<string>")
    return j.select("response_id", "context", left(required.otherwise(none)).alias("required"), left(preferred.otherwise(none)).alias("preferred"))


QUERIES = {f.__name__: f for f in (faq_entries, faq_formats, faq_sections, missing_elements)}

_LINES = r"""lines AS (SELECT doc_id, i - 1 AS i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
ahead AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM lines)"""
_POINTS = ", ".join(f"sum(CASE WHEN regexp_matches(line, {q(a)}) THEN 2 + CASE WHEN coalesce(regexp_matches(nxt, {q(b)}), false) THEN 3 ELSE 0 END ELSE 0 END) AS p_{n}" for n, (a, b) in Q.FORMATS.items())
_BEST = f"greatest({', '.join(f'p_{n}' for n in Q.FORMATS)})"
_FORMATS = f"""{_LINES}, formats AS (SELECT doc_id, CASE WHEN {_BEST} < 5 THEN 'generic' {' '.join(f"WHEN p_{n} = {_BEST} THEN '{n}'" for n in Q.FORMATS)} END AS format FROM (SELECT doc_id, {_POINTS} FROM ahead GROUP BY doc_id))"""
_ASKED = "CASE format " + " ".join(f"WHEN '{n}' THEN regexp_matches(line, {q(a)})" for n, (a, _) in Q.FORMATS.items()) + f" ELSE regexp_matches(line, {q(Q.GENERIC)}) END"
_TEXT = "CASE format " + " ".join(f"WHEN '{n}' THEN regexp_extract(line, {q(a)}, 1)" for n, (a, _) in Q.FORMATS.items()) + f" ELSE regexp_extract(line, {q(Q.GENERIC)}, 1) END"
_WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
_ENTRIES = rf"""{_FORMATS},
marked AS (SELECT *, {_ASKED} AS asked, CASE WHEN regexp_matches(line, {q(Q.CATEGORY)}) THEN regexp_extract(line, {q(Q.CATEGORY)}, 1) END AS cat FROM lines JOIN formats USING (doc_id)),
run AS (SELECT *, sum(asked::INT) OVER w AS g, last_value(cat IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS category FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
place AS (SELECT *, i - min(i) OVER (PARTITION BY doc_id, g) AS k FROM run WHERE g > 0),
ended AS (SELECT *, max(CASE WHEN format = 'markdown' AND k > 0 AND starts_with(line, '##') OR format <> 'markdown' AND k > 1 AND line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g ORDER BY i) AS over FROM place),
entries AS (SELECT doc_id, any_value(format) AS format, CAST(min(i) AS INTEGER) AS line_no, arg_min({_TEXT}, i) AS question,
  regexp_replace(regexp_replace(coalesce(string_agg(line, ' ' ORDER BY i) FILTER (k > 0 AND over = 0 AND line <> ''), ''), {q(Q.LABEL)}, ''), '\s+', ' ', 'g') AS answer, arg_min(coalesce(category, chr(1)), i) AS c FROM ended GROUP BY doc_id, g),
kept AS (SELECT doc_id, format, line_no, question, answer, nullif(c, chr(1)) AS category FROM entries WHERE {_WORDS('question')} >= 2 AND {_WORDS('answer')} >= 3)"""
_RULE = lambda k: "CASE context " + " ".join(f"WHEN {q(r[0])} THEN [{', '.join(map(q, r[k]))}]" for r in L.AUDIT_RULES) + " ELSE [] END"

SQL: dict[str, str] = {
    "faq_formats": f"WITH {_FORMATS} SELECT doc_id, format FROM formats",
    "faq_entries": f"WITH {_ENTRIES} SELECT * FROM kept",
    "faq_sections": f"WITH {_ENTRIES} SELECT doc_id, coalesce(category, 'Questions Générales') AS category, count(*) AS entries, round(avg({_WORDS('answer')}), 6) AS answer_words FROM kept GROUP BY 1, 2",
    "missing_elements": reference._GRADED
    + f""", contexts AS ({reference.SQL['question_contexts']}), told AS (SELECT response_id, string_agg(low, chr(10)) AS told FROM graded GROUP BY 1),
j AS (SELECT DISTINCT response_id, context, told FROM told JOIN (SELECT DISTINCT response_id, result_id FROM generated_responses) USING (response_id) JOIN contexts USING (result_id))
SELECT response_id, context, array_to_string(list_filter({_RULE(1)}, lambda w: NOT contains(told, w))[1:3], ',') AS required, array_to_string(list_filter({_RULE(2)}, lambda w: NOT contains(told, w))[1:3], ',') AS preferred FROM j""",
}
