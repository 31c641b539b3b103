import datetime as dt

from pyspark.sql import functions as F

from kerfline.operators.retrieval import hashed_embedding, load_index
from kerfline.streaming import ingest

T = dt.datetime(2025, 3, 1, 10)
SCHEMA = "doc_id bigint, content string, doc_type string, parsing_timestamp timestamp, loaded_at timestamp"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_daily_counts_take_redeliveries_once(spark, tmp_path):
    path = str(tmp_path / "parsed_docs.parquet")
    write(spark, path, [(1, "a", "Policy ", T, T), (2, "b", "policy", T, T), (3, "c", None, T + dt.timedelta(days=1), T), (4, "d", "faq", None, T)])
    write(spark, path, [(1, "a", "Policy ", T, T + dt.timedelta(days=2))])
    got = {(str(r.day), r.doc_type): r.documents for r in ingest.daily_documents(spark, path).collect()}
    assert got == {("2025-03-01", "policy"): 2, ("2025-03-02", "unknown"): 1}


def test_index_grows_and_restarts(spark, tmp_path):
    path, index, state = (str(tmp_path / x) for x in ("docs", "index", "state"))
    run = lambda: ingest.append_to_index(ingest.arriving(spark, path), index, state, hashed_embedding).trigger(availableNow=True).start().awaitTermination()
    write(spark, path, [(1, "un texte", None, T, T), (2, None, None, T, T)])
    run()
    write(spark, path, [(3, "un autre texte", None, T, T)])
    run()
    run()
    rows = load_index(spark, index).select("vec_id", F.size("embedding").alias("n")).collect()
    assert sorted((r.vec_id, r.n) for r in rows) == [(1, 64), (3, 64)]
