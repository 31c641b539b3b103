"""Incremental work over arriving documents, with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfline.session import shared_folder


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents as a stream of the files at ``path`` (a folder of files, or one file)."""
    schema = spark.read.parquet(path).schema
    if path.rstrip("/").endswith(".parquet"):
        folder, _, name = path.rstrip("/").rpartition("/")
        # a table is one file or a folder of files, either below the same parent
        return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}[{name[-1]}]")
    return spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Documents per day of parsing and type; redeliveries within the watermark count once."""
    s = stream.where("parsing_timestamp IS NOT NULL").withWatermark("parsing_timestamp", late)
    s = s.dropDuplicatesWithinWatermark(["doc_id"])
    day = F.window("parsing_timestamp", "1 day")
    return s.groupBy(day.alias("w"), F.coalesce(F.lower(F.trim("doc_type")), F.lit("unknown")).alias("doc_type")).agg(F.count(F.lit(1)).alias("documents"))


def daily_documents(spark: SparkSession, path: str) -> DataFrame:
    """Everything that lies at ``path`` now, counted as a stream; the last state of each window.

    Each batch is written to a folder of its own in the shared folder, so a batch that is run again replaces itself;
    the progress of the stream lies there too.
    """
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("date").alias("day"), "doc_type", "documents").write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    s = daily_counts(arriving(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    s.awaitTermination()
    schema = "day date, doc_type string, documents bigint, batch bigint"
    states = spark.read.schema(schema).parquet(f"{folder}/states") if _is_there(spark, f"{folder}/states") else spark.createDataFrame([], schema)
    return states.groupBy("day", "doc_type").agg(F.max_by("documents", "batch").alias("documents"))


def _is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_to_index(stream: DataFrame, index: str, checkpoint: str, embed):
    """Embed arriving texts and append them to the vector index; restarts go on where they stopped."""
    rows = stream.where("content IS NOT NULL").select(F.col("doc_id").alias("vec_id"), embed(F.col("content")).alias("embedding"))
    return rows.writeStream.format("parquet").option("path", index).option("checkpointLocation", checkpoint).outputMode("append")
