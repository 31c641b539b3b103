"""Near-duplicate records: exact pairs and groups above a word-shingle Jaccard threshold.

Plan
1. Every text becomes its set of hashed shingles (runs of ``width`` words), MinHash
   values and a 128-bit fingerprint of one bit of each of 128 MinHash values. The expected
   Hamming distance of two fingerprints is 64 * (1 - similarity), less in a shard, whose
   texts have the bits of its tuple in common.
2. Overlapping shards: every text is a member of ``bands`` shards, one per tuple of
   ``rows`` MinHash values. Two texts that a shard boundary parts meet in another shard.
   Shards of texts that have only usual phrases in common grow with the table, and their
   pairs with its square; a tuple of four keeps them small, and 36 of them find no less
   than 20 of three did.
3. In each shard of two texts or more the fingerprints are searched by a vantage-point
   tree: a vantage point is compared with all others, these are split at their median
   distance from it, and of the pairs across the split only those are compared that the
   triangle bound leaves (their distances from the vantage point within the radius of each
   other). The trees of all shards of a batch grow together, one level at a time. Every
   candidate pair comes out of a tree.
4. A shard of more than SHARD_ROWS texts isn't held by one task. Its rows go to a second
   round: rings around a vantage point, each as wide as the radius, overlapping by one
   ring (triangle bound again), and rings that are still too large to a grid of blocks.
5. Candidates are verified exactly on their whole shingle sets.

Equal texts form one class (key: 64-bit hash of the text), searched once; classes are
expanded by a join at the end. A vantage-point tree over all fingerprints without the
shards of step 2 would not prune: distances between unrelated texts concentrate around
their mean, within the search radius of every median (see README).

Defined results: null, empty and short texts (fewer than ``min_words`` words) are in no
pair; a repeated key counts once, with any of its delivered texts; very long texts are
used whole; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.session import cut

WORDS = re.compile(r"[^\W_]+").findall
#: Rows of one shard that a task holds at once; beyond it the shard goes to the second round.
SHARD_ROWS = 4096
#: Pairs of fingerprints that are compared at once (memory bound only).
AT_ONCE = 1 << 20
#: Words whose hash a Python worker remembers before it starts afresh (memory bound only).
REMEMBERED_WORDS = 1_000_000


class Hasher:
    """Shingle sets, band keys and fingerprints of batches of texts."""

    def __init__(self, width: int, bands: int, rows: int):
        self.width, self.bands, self.rows = width, bands, rows
        rng = np.random.default_rng(20240607)
        n = max(bands * rows, 128)
        self.mul = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.known: dict[str, int] = {}

    def sets(self, texts: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle hashes, sorted and distinct within a text; offsets; which texts have enough words)."""
        import xxhash

        flat: list[str] = []
        n = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                w = WORDS(t.lower())
                if len(w) >= max(min_words, self.width):
                    n[k] = len(w)
                    flat += w
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        for w in set(flat).difference(self.known):
            self.known[w] = xxhash.xxh32_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))
        kept = n > 0
        which = np.repeat(np.arange(len(texts)), n)
        if len(h) < self.width:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), kept
        m = len(h) - self.width + 1
        s = np.zeros(m, np.uint64)
        for j in range(self.width):
            s = (s ^ h[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        inside = which[:m] == which[self.width - 1 :]
        key = np.sort((which[:m][inside].astype(np.uint64) << np.uint64(32)) | (s[inside] >> np.uint64(32)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        at = np.searchsorted(key >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
        return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), at, kept

    def sign(self, shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys [texts, bands] as int64, fingerprints [texts, 2] as uint64)."""
        n = len(starts)
        keys = np.zeros((n, self.bands), np.uint64)
        bits = np.zeros((n, 128), np.uint8)
        for f in range(len(self.mul)):
            # multiply-shift with a final mix, so that the order of the values is no plain rotation
            v = shingles * self.mul[f] + self.add[f]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            low = np.minimum.reduceat(v, starts)
            if f < self.bands * self.rows:
                band = f // self.rows
                keys[:, band] = (keys[:, band] ^ low) * np.uint64(0xD6E8FEB86659FD93)
                keys[:, band] ^= keys[:, band] >> np.uint64(32)
            if f < 128:
                bits[:, f] = (low * np.uint32(0x85EBCA6B)) >> np.uint32(31)
        keys ^= np.arange(self.bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        return keys.view(np.int64), np.packbits(bits, axis=1).view(np.uint64)


@lru_cache(maxsize=4)
def hasher(width: int, bands: int, rows: int) -> Hasher:
    return Hasher(width, bands, rows)


# -- search within a shard -------------------------------------------------
def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def _expand(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for low <= j < high of each i, AT_ONCE or so at a time."""
    n = np.maximum(high - low, 0)
    keep = n > 0
    i, low, n = i[keep], low[keep], n[keep]
    ends = np.cumsum(n)
    at = 0
    while at < len(i):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)), at + 1)
        m = n[at:to]
        yield np.repeat(i[at:to], m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:to], m)
        at = to


def vantage_forest(shard: np.ndarray, f: np.ndarray, radius: int, counts: dict[str, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one shard within ``radius``, by a vantage-point tree for each shard.

    ``shard`` is sorted. ``counts`` receives how many pairs were ``compared`` and how many the triangle bound ``pruned``.
    """
    row = np.arange(len(shard))
    _, node = np.unique(shard, return_inverse=True)  # the node that a row is in
    while len(row):
        first = np.concatenate([[True], node[1:] != node[:-1]])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(row)))
        vantage = np.repeat(row[start], size)
        live = ~first  # a vantage point leaves its node
        row, vantage, node = row[live], vantage[live], np.repeat(np.arange(len(start)), size)[live]
        if not len(row):
            return
        d = distance(f[row], f[vantage])
        near = d <= radius
        yield vantage[near], row[near]
        order = np.lexsort((d, node))
        row, node, d = row[order], node[order], d[order]
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(start, len(row)))
        mu = np.repeat(d[start + (size - 1) // 2], size)
        inner = d <= mu
        split = np.repeat(start + np.add.reduceat(inner.astype(np.int64), start), size)  # where the outer rows begin
        end = np.repeat(start + size, size)
        place = np.arange(len(row))
        flat = split == end  # all within the median: no split prunes, all pairs of the node are compared
        reach = np.searchsorted(node * 1024 + d, node * 1024 + d + radius, side="right")
        low, high = np.where(flat, place + 1, split), np.where(flat, end, np.minimum(reach, end))
        high = np.where(inner, high, low)
        for i, j in _expand(place, low, high):
            near = distance(f[row[i]], f[row[j]]) <= radius
            yield row[i[near]], row[j[near]]
        if counts is not None:
            counts["compared"] = counts.get("compared", 0) + len(row) + int(np.maximum(high - low, 0).sum())
            counts["pruned"] = counts.get("pruned", 0) + int(np.where(inner & ~flat, end - np.maximum(high, low), 0).sum())
        keep = ~flat
        row, node = row[keep], (node * 2 + ~inner)[keep]


def search_sorted(key: np.ndarray, t: np.ndarray, f: np.ndarray, radius: int, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (smaller t, greater t) within each run of equal keys; rows are sorted by (key, t) and distinct."""
    a, b = [t[:0]], [t[:0]]
    for i, j in vantage_forest(key, f, radius, counts):
        x, y = t[i], t[j]
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
    p = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return p[:, 0], p[:, 1]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    n = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
    return n[0], n[1], np.stack([n[2], n[3]], 1).view(np.uint64)


def _search(radius: int, spill: bool):
    """Stream shards sorted by (key, t): near pairs, and the rows of shards that are too large."""

    def out(key, a, b, f):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], names=["key", "a", "b", "f0", "f1"])

    def pairs(key, t, f):
        a, b = search_sorted(key, t, f, radius)
        return out(np.zeros(len(a), np.int64), a, b, np.zeros((len(a), 2), np.uint64))

    def run(batches):
        held, over = None, None  # the last, perhaps unfinished shard; the key of a shard that is too large
        for batch in batches:
            key, t, f = _columns(batch)
            if held is not None:
                key, t, f = (np.concatenate(x) for x in zip(held, (key, t, f), strict=True))
                held = None
            if not len(key):
                continue
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (t[1:] != t[:-1])])
            key, t, f = key[fresh], t[fresh], f[fresh]
            if over is not None:
                n = int(np.searchsorted(key != over, True)) if (key != over).any() else len(key)
                if n:
                    yield out(key[:n], t[:n], t[:n], f[:n])
                key, t, f = key[n:], t[n:], f[n:]
                if not len(key):
                    continue
                over = None
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if spill:
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(starts, len(key)))
                big = np.repeat(size > SHARD_ROWS, size)
                if big.any():
                    yield out(key[big], t[big], t[big], f[big])
                    if big[-1]:
                        over, last = key[-1], len(key)
                    rest = ~big[:last]
                    yield pairs(key[:last][rest], t[:last][rest], f[:last][rest])
                else:
                    yield pairs(key[:last], t[:last], f[:last])
            else:
                yield pairs(key[:last], t[:last], f[:last])
            held = (key[last:], t[last:], f[last:]) if last < len(key) else None
        if held is not None:
            yield pairs(*held)

    return run


PAIRS = "key bigint, a bigint, b bigint, f0 bigint, f1 bigint"


def _large_shards(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs of the shards that are too large for a task: rings around a vantage point, then a grid of blocks."""
    rows = rows.select("key", F.col("a").alias("t"), "f0", "f1")
    v = rows.groupBy("key").agg(F.min_by(F.struct("f0", "f1"), F.xxhash64("t")).alias("v"))  # one row per large shard
    d = F.bit_count(F.col("f0").bitwiseXOR(F.col("v.f0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("v.f1")))
    ring = F.floor(d / radius)
    rings = rows.join(v, "key").select("key", "t", "f0", "f1", F.explode(F.array(ring, ring + 1)).alias("ring"))
    n = rings.groupBy("key", "ring").agg(F.ceil(F.count(F.lit(1)) / (SHARD_ROWS // 2)).alias("blocks"))
    own = F.pmod(F.xxhash64("t", F.lit(5)), F.col("blocks"))
    grid = rings.join(n, ["key", "ring"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", "ring", F.least("own", "other"), F.greatest("own", "other"))
    return grid.select(cell.alias("key"), "t", "f0", "f1").repartition("key").sortWithinPartitions("key", "t").mapInArrow(_search(radius, False), PAIRS)


def near_pairs(df: DataFrame, text: str, threshold: float = 0.8, width: int = 5, min_words: int = 1, bands: int = 36, rows: int = 4) -> DataFrame:
    """(t_a, t_b, similarity): exact pairs of different texts (64-bit text keys, t_a < t_b) of at least ``threshold``."""
    radius = int(64 * (1 - threshold) + 3.6 * (128 * (1 - threshold) / 2 * (1 + threshold) / 2) ** 0.5)
    src = df.select(F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x")).where("x IS NOT NULL")

    def sign(batches):
        h = hasher(width, bands, rows)
        for b in batches:
            s, at, kept = h.sets(b.column(1).to_pylist(), min_words)
            k = np.flatnonzero(kept)
            if not len(k):
                continue
            keys, f = h.sign(s, at[:-1][k])
            t = b.column(0).to_numpy()[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(t, bands)), *(pa.array(np.repeat(f[:, j].view(np.int64), bands)) for j in (0, 1))], names=["key", "t", "f0", "f1"]
            )

    shards = src.mapInArrow(sign, "key bigint, t bigint, f0 bigint, f1 bigint").repartition("key").sortWithinPartitions("key", "t")
    got = cut(shards.mapInArrow(_search(radius, True), PAIRS).distinct())
    pairs = got.where("a < b").select("a", "b")
    large = got.where("a = b")
    if not large.isEmpty():
        pairs = pairs.unionByName(_large_shards(large, radius).select("a", "b"))
    pairs = pairs.distinct()

    def sets(batches):
        h = hasher(width, bands, rows)
        for b in batches:
            s, at, _ = h.sets(b.column(1).to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int32)))], names=["t", "s"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    held = src.join(named, "t", "left_semi").dropDuplicates(["t"]).mapInArrow(sets, "t bigint, s array<int>")

    def verify(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            xs, ys = (np.diff(c.offsets.to_numpy()) for c in (x, y))
            n = b.num_rows
            k = np.concatenate([np.repeat(np.arange(n, dtype=np.uint64), xs), np.repeat(np.arange(n, dtype=np.uint64), ys)])
            v = np.concatenate([c.flatten().to_numpy().view(np.uint32) for c in (x, y)])
            key = np.sort((k << np.uint64(32)) | v)
            both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
            sim = both / np.maximum(xs + ys - both, 1)
            ok = np.flatnonzero(sim >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(sim[ok])], names=["t_a", "t_b", "similarity"])

    joined = pairs.join(held.select(F.col("t").alias("a"), F.col("s").alias("x")), "a").join(held.select(F.col("t").alias("b"), F.col("s").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(verify, "t_a bigint, t_b bigint, similarity double")


def members(df: DataFrame, key: str, text: str, min_words: int = 1) -> DataFrame:
    """(id, t): the class of equal texts of every record with enough words."""
    words = F.size(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), 0))
    return df.where(F.col(text).isNotNull()).where(words >= min_words).select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("t")).distinct()


#: Records of one class of equal texts that meet in one group of a join.
CLASS_ROWS = 2000


def _parted(who: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes in parts of about CLASS_ROWS records: (id, t, part) of records; (t, part) of classes; (t, n)."""
    n = who.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    parts = n.select("t", "n", F.ceil(F.col("n") / CLASS_ROWS).cast("int").alias("parts"))
    large = parts.where("parts > 1").select("t", "parts")
    rows = who.join(large, "t", "left").select("id", "t", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    return rows, parts.select("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), n


def near_duplicate_records(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, min_words: int = 1, **tuning) -> DataFrame:
    """(id_a, id_b): every pair of records, copies included, of at least ``threshold``; id_a < id_b.

    A class of equal texts is dealt out in parts, so that the many pairs of a large one are made by many tasks.
    """
    who = cut(members(df, key, text, min_words))
    rows, parts, n = _parted(who)
    pairs = near_pairs(df, text, threshold, width, min_words, **tuning).select("t_a", "t_b")
    same = n.where("n > 1").select(F.col("t").alias("t_a"), F.col("t").alias("t_b"))
    pairs = pairs.unionByName(same)
    a, b = (rows.select(F.col("id").alias(f"id_{s}"), F.col("t").alias(f"t_{s}"), F.col("part").alias(f"part_{s}")) for s in "ab")
    pa_, pb = (parts.select(F.col("t").alias(f"t_{s}"), F.col("part").alias(f"part_{s}")) for s in "ab")
    both = pairs.join(pa_, "t_a").join(pb, "t_b")  # pairs of parts
    both = both.join(a, ["t_a", "part_a"]).join(b, ["t_b", "part_b"]).where("id_a <> id_b AND (t_a <> t_b OR id_a < id_b)")
    out = both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return out.distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, min_words: int = 1, **tuning) -> DataFrame:
    """(id, class_id, links) of every record with enough words: the smallest id with the same text, and how many other texts are near."""
    who = cut(members(df, key, text, min_words))
    pairs = near_pairs(df, text, threshold, width, min_words, **tuning)
    links = pairs.select(F.explode(F.array("t_a", "t_b")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("links"))
    classes = who.groupBy("t").agg(F.min("id").alias("class_id")).join(links, "t", "left").select("t", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return who.join(classes, "t").select("id", "class_id", "links")
