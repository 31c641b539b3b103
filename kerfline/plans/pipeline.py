"""The whole way from questions to answers as one plan: retrieve, grade, refine, judge coverage, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.operators import answers, grading, retrieval, security
from kerfline.session import latest_per_key, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: results whose id is divisible by 100."""
    rows = table(spark, d, "crag_results").where("result_id % 100 = 0").select("result_id", "query", "logged_at")
    return latest_per_key(rows, "result_id", "logged_at").select("result_id", F.coalesce("query", F.lit("")).alias("query"))


def retrieved(asked: DataFrame, strips: DataFrame, k: int = 5) -> DataFrame:
    """(result_id, strip_id, rank, distance, score): the strips nearest to each question by its text, against all strips."""
    q = asked.select(F.col("result_id").alias("vec_id"), retrieval.hashed_embedding(F.col("query")).alias("embedding"))
    r = strips.where("content IS NOT NULL").select(F.col("strip_id").alias("vec_id"), retrieval.hashed_embedding(F.col("content")).alias("embedding"))
    near = retrieval.top_k(q, r, "vec_id", "embedding", k)
    return near.select(F.col("query_id").alias("result_id"), F.col("neighbour_id").alias("strip_id"), "rank", "distance", "score")


def answered(asked: DataFrame, strips: DataFrame, k: int = 5) -> DataFrame:
    """(result_id, n, coverage, needs_more, answer, confidence) of every question; without fitting strips an empty answer that needs more."""
    near = retrieved(asked, strips, k).select("result_id", "strip_id")
    pairs = near.join(asked, "result_id").join(strips.select("strip_id", "content", "strip_type"), "strip_id")
    kept = grading.refine(grading.grade(pairs), "result_id", "strip_id")
    covered = answers.coverage(kept, "result_id", security.intent(F.col("query")))
    text = answers.answer(answers.elements(kept, "result_id"), "result_id").select("result_id", grading.shorten(F.col("answer"), 500).alias("answer"))
    quality = kept.groupBy("result_id").agg(F.avg("score").alias("quality"))
    j = asked.select("result_id").join(covered, "result_id", "left").join(text, "result_id", "left").join(quality, "result_id", "left")
    n, c, a = F.coalesce("n", F.lit(0)), F.coalesce("coverage", F.lit(0.0)), F.coalesce("answer", F.lit(""))
    sure = grading.answer_confidence(c, n, a, F.coalesce("quality", F.lit(0.0)))
    return j.select("result_id", n.alias("n"), c.alias("coverage"), F.coalesce("needs_more", F.lit(True)).alias("needs_more"), a.alias("answer"), F.round(sure, 5).alias("confidence"))


def _strips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "knowledge_strips").select("strip_id", "content", "strip_type").dropDuplicates(["strip_id"])


def question_retrieval(spark, d):
    return retrieved(questions(spark, d), _strips(spark, d)).withColumns({c: F.round(c, 5) for c in ("distance", "score")})


def question_answers(spark, d):
    return answered(questions(spark, d), _strips(spark, d))


QUERIES = {f.__name__: f for f in (question_retrieval, question_answers)}
SQL: dict[str, str] = {}
