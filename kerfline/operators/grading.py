"""Scoring strips against questions, filtering, de-duplicating, ordering and answer confidence.

Input rows are (question key, query, strip key, content, strip_type); every operator is a
projection or one window per question, so work is spread over the questions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerfline.functions import lexicon as L
from kerfline.functions.text import any_of, let, words
from kerfline.operators.strips import signature


def concepts(query: Column) -> Column:
    """array<struct<word, weight>> of the words of a question, each once."""
    w = F.array_distinct(F.filter(words(F.lower(query)), lambda x: ~x.isin(L.STOP_WORDS)))
    weight = lambda x: F.when(x.isin(L.QUESTION_WORDS), 0.3).when(x.endswith("ent"), 0.8).otherwise(1.0)
    return F.transform(w, lambda x: F.struct(x.alias("word"), weight(x).alias("weight")))


def keyword_score(query: Column, content: Column) -> Column:
    """Weighted share of the concepts found: whole, as singular or plural (0.8), by their first four letters (0.5)."""
    return let(F.struct(F.lower(content).alias("low"), concepts(query).alias("concepts")), lambda v: _keyword_score(v["low"], v["concepts"]))


def _keyword_score(low: Column, c: Column) -> Column:
    found = lambda x: (
        F.when(F.contains(low, x["word"]), x["weight"])
        .when(F.contains(low, F.concat(x["word"], F.lit("s"))) | (x["word"].endswith("s") & F.contains(low, F.rtrim(x["word"], F.lit("s")))), 0.8 * x["weight"])
        .when((F.length(x["word"]) > 4) & F.contains(low, F.substring(x["word"], 1, 4)), 0.5 * x["weight"])
        .otherwise(0.0)
    )
    total = F.aggregate(c, F.lit(0.0), lambda s, x: s + x["weight"])
    return F.coalesce(F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + found(x)), total), F.lit(0.0))


def content_type_score(query: Column, strip_type: Column) -> Column:
    q, out = F.lower(query), F.when(F.lit(False), F.lit(0.0))
    how = q.contains("comment") & any_of(q, ["fonctionne", "marche"])
    what = any_of(q, ["qu'est-ce", "quoi", "définition"])
    out = out.when(how & (strip_type == "definition"), 0.8).when(~how & what & (strip_type == "definition"), 0.9)
    out = out.when(~how & ~what & q.contains("exemple") & ~q.contains("pourquoi") & (strip_type == "example"), 0.9)
    for name, value in L.TYPE_SCORES.items():
        out = out.when(strip_type == name, value)
    return out.otherwise(0.5)


def combine(scores: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """(weighted mean, confidence): confidence is one less twice the population variance, within [0.1, 1]."""
    total = sum(w for _, w in scores)
    mean = reduce(lambda a, b: a + b, [s * w for s, w in scores]) / total
    n = len(scores)
    centre = reduce(lambda a, b: a + b, [s for s, _ in scores]) / n
    variance = reduce(lambda a, b: a + b, [(s - centre) * (s - centre) for s, _ in scores]) / n
    return mean, F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - 2 * variance))


def post_process(score: Column, query: Column, content: Column) -> Column:
    q, c, n = F.lower(query), F.lower(content), F.size(words(content))
    s = F.when(n < 5, score * 0.7).otherwise(score)
    s = F.when(q.contains("comment") & q.contains("fonctionne") & any_of(c, ["utilise", "permet", "mécanisme", "processus"]), F.least(F.lit(1.0), s * 1.2)).otherwise(s)
    dated = any_of(q, ["comment", "fonctionnement"]) & c.rlike(r"(^|[^0-9A-Za-z_])(19|20)[0-9]{2}([^0-9A-Za-z_]|$)") & (n < 20)
    return F.when(dated, s * 0.5).otherwise(s)


def relevance(score: Column) -> Column:
    out = F.when(score >= L.RELEVANCE[0][1], L.RELEVANCE[0][0])
    for name, least in L.RELEVANCE[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("not_relevant")


def grade(pairs: DataFrame) -> DataFrame:
    """pairs with keyword, content_type, score, confidence and relevance; ``concepts`` of the query are used where they are given."""
    q, c = F.col("query"), F.coalesce(F.col("content"), F.lit(""))
    given = F.col("concepts") if "concepts" in pairs.columns else concepts(q)
    s = pairs.select(*[x for x in pairs.columns if x != "concepts"], F.lower(c).alias("_low"), given.alias("_concepts"))
    s = s.withColumn("keyword", F.round(_keyword_score(F.col("_low"), F.col("_concepts")), 9)).drop("_low", "_concepts")
    s = s.withColumn("content_type", content_type_score(q, F.col("strip_type")))
    mean, sure = combine([(F.col("keyword"), 0.30), (F.col("content_type"), 0.20)])  # the scores that there are
    s = s.withColumn("score", F.round(post_process(mean, q, c), 9)).withColumn("confidence", F.round(sure, 9))
    return s.withColumn("relevance", relevance(F.col("score")))


def refine(graded: DataFrame, question: str, strip: str, threshold: float = 0.5, most: int = 10) -> DataFrame:
    """Kept strips of each question with their ``place``: filter, one strip per signature, narrative order, limit."""
    ranked = Window.partitionBy(question).orderBy(F.desc("score"), strip)
    example = F.max(((F.col("strip_type") == "example") & (F.col("score") >= threshold)).cast("int")).over(ranked.rowsBetween(Window.unboundedPreceding, -1))
    keep = (F.col("score") >= threshold) | ((F.col("score") >= 0.4) & (F.col("strip_type").isin("definition", "enumeration") | ((F.col("strip_type") == "example") & (F.coalesce(example, F.lit(0)) == 0))))
    kept = graded.withColumn("_keep", keep).where("_keep").withColumn("_sig", signature(F.coalesce("content", F.lit(""))))
    first = F.row_number().over(Window.partitionBy(question, "_sig").orderBy(F.desc("score"), strip))
    one = kept.withColumn("_n", first).where("_n = 1")
    low = F.lower(F.coalesce("content", F.lit("")))
    phase = F.when(F.col("strip_type") == "definition", 1).when(any_of(low, L.MECHANISM_WORDS), 2).when(F.col("strip_type") == "enumeration", 3).when(any_of(low, ["exemple", "bert", "gpt"]), 4).otherwise(5)
    place = F.row_number().over(Window.partitionBy(question).orderBy("phase", F.desc("score"), strip))
    return one.withColumn("phase", phase).withColumn("place", place).where(F.col("place") <= most).drop("_keep", "_sig", "_n")


def shorten(answer: Column, most: int = 500) -> Column:
    """Runs of blanks and line ends shortened, a final mark added, cut after the last whole sentence within ``most``."""
    t = F.regexp_replace(F.regexp_replace(answer, r"\n{3,}", "\n\n"), " {2,}", " ")
    t = F.when((t != "") & ~F.substring(t, -1, 1).isin(".", "!", "?"), F.concat(t, F.lit("."))).otherwise(t)
    step = F.aggregate(
        F.split(t, r"\."),
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda s, x: F.when(s["open"] & (F.length(s["text"]) + F.length(x) + 1 <= most), F.struct(F.concat(s["text"], x, F.lit(".")).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(s["text"].alias("text"), F.lit(False).alias("open"))),
    )["text"]
    return F.when(F.length(t) > most, F.regexp_replace(step, r"^\s+|\s+$", "")).otherwise(t)


def answer_confidence(coverage: Column, strips: Column, answer: Column, quality: Column) -> Column:
    """Mean of coverage, number of strips (five are enough), nearness of the length to 300, and mean strip score if any."""
    length = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.length(answer) - 300) / 300))
    some = F.least(strips / 5, F.lit(1.0))
    return F.when(strips > 0, (coverage + some + length + quality) / 4).otherwise((coverage + some + length) / 3)
