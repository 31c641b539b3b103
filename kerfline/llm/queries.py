"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.llm import records
from kerfline.session import latest_per_key, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.pairs import judged

    # common_words is a fixed table of a few hundred words
    common = [(r.lang, r.word) for r in table(spark, sf_dir, "common_words").collect()]
    logged = table(spark, sf_dir, "crag_results").select("result_id", "query", "answer", "logged_at")
    # every delivery is judged, then the latest verdict counts: no answer is shuffled to find it
    results = latest_per_key(judged(logged, common, ["result_id", "logged_at"]), "result_id", "logged_at")
    asked = latest_per_key(logged.select("result_id", "query", "logged_at"), "result_id", "logged_at").select("result_id", "query")
    given = table(spark, sf_dir, "generated_responses").select("response_id", "result_id", "answer")
    responses = judged(given.join(asked, "result_id", "left"), common, ["response_id"]).dropDuplicates(["response_id"])
    both = results.select(F.lit("result").alias("rec_kind"), F.col("result_id").alias("rec_id"), "defect").unionByName(responses.select(F.lit("response").alias("rec_kind"), F.col("response_id").alias("rec_id"), "defect"))
    return both.where("defect IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.scanned import find_noise

    return find_noise(table(spark, sf_dir, "parsed_docs")).select("doc_id", "field", "pos", "noise").distinct()


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.scanned import repair

    return repair(table(spark, sf_dir, "parsed_docs"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.encoding import encode

    return encode(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.mixing import mixture_of

    return mixture_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.mixing import mixture_of

    return mixture_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerfline.llm.quality import kinds

    # common_words is a fixed table of a few hundred words
    words = [r.word for r in table(spark, sf_dir, "common_words").select("word").collect()]
    return kinds(table(spark, sf_dir, "documents"), words)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = records.QUERIES | {"p2_found": p2_found, "p5_found": p5_found, "p5_text": p5_text, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_report": p7_report, "p8_found": p8_found, "p8_statistics": p8_statistics}

SQL: dict[str, str] = {**records.SQL}
