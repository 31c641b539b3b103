"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is set
    only where none is named on one machine (``local[*]``), it is an error that none is
    named on a cluster.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; partial aggregation runs before the shuffle."""
    from pyspark.sql import functions as F

    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``df`` without redeliveries: of each key those with the greatest ``order``.

    Only (key, order) is shuffled to find the keys that came more than once; their small table is joined
    to the rows, so that texts stay where they are as long as it can be broadcast by its size.
    """
    from pyspark.sql import functions as F

    again = df.groupBy(key).agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
    return df.join(again, key, "left").where(F.col("_last").isNull() | (F.col(order) == F.col("_last"))).drop("_last")
