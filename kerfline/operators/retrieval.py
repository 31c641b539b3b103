"""Embedding, index and exact top-k search.

Search meets queries and rows in blocks: vectors are packed into matrices of BLOCK rows,
each pair of a query block and a row block is one task-sized product, and only the best k
of each query per row block leave it. No vector set goes through the driver.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


WORDS = re.compile(r"[^\W_]+").findall


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic bag-of-words vector (feature hashing with signs, unit length), in Arrow batches; stands in where no model is given.

    A null or wordless text has the zero vector.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in WORDS((t or "").lower()):
                if w not in known:
                    h = zlib.crc32(w.encode())
                    known[w] = (h >> 1) % size, 1.0 if h & 1 else -1.0
                k, s = known[w]
                v[k] += s
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return pd.Series(out, dtype=object)

    return embed(text)


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Rows packed into blocks of about BLOCK vectors."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_vectors"])

    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector).mapInArrow(run, f"{name}_ids array<bigint>, {name}_vectors binary")


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, score: bool = True) -> DataFrame:
    """(query_id, neighbour_id, rank, distance, score): the k nearest by squared Euclidean distance, ties by id; score = 1 / (1 + distance)."""

    def run(batches):
        for b in batches:
            for qi, qv, ri, rv in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                q = np.frombuffer(qv).reshape(len(qi), -1)
                r = np.frombuffer(rv).reshape(len(ri), -1)
                ids = np.array(ri)
                d = np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * q @ r.T, 0)
                best = min(k, len(ids))
                edge = np.partition(d, best - 1, axis=1)[:, best - 1]
                for j in range(len(qi)):
                    at = np.flatnonzero(d[j] <= edge[j] + 1e-9)
                    exact = ((r[at] - q[j]) ** 2).sum(1)
                    at, exact = (x[np.lexsort((ids[at], exact))[:best]] for x in (at, exact))
                    yield pa.RecordBatch.from_arrays([pa.array([qi[j]] * len(at), pa.int64()), pa.array(ids[at]), pa.array(exact)], names=["query_id", "neighbour_id", "distance"])

    # a query block against a row block; the query set is stated, and much smaller than the rows
    pairs = _blocks(queries, key, vector, "q").crossJoin(_blocks(rows, key, vector, "r"))
    near = pairs.select("q_ids", "q_vectors", "r_ids", "r_vectors").mapInArrow(run, "query_id bigint, neighbour_id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("score", 1 / (1 + F.col("distance"))) if score else best


def save_index(df: DataFrame, path: str, size: int, key: str = "vec_id", vector: str = "embedding") -> None:
    """Append vectors of ``size`` to the index at ``path``; a vector of another size fails the job."""
    checked = F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector that hasn't {size} values")))
    df.select(key, checked.alias(vector)).write.mode("append").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
