import inspect
import random
import re

import numpy as np
from pyspark.sql import functions as F

from kerfline.llm import neardup as N

WORDS = [f"mot{k}" for k in range(400)]


def brute(rows, threshold, width, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(least, width):
            sets.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(len(x & y) / len(x | y) >= threshold for x in sets[a] for y in sets[b])}


def corpus(n=120, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = r.choice(rows)[1].split()
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
        else:
            w = [r.choice(WORDS) for _ in range(r.randrange(25, 90))]
        rows.append((i, " ".join(w)))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += [(500, None), (501, ""), (502, "trop court"), (503, "  "), rows[0], (504, rows[1][1]), (505, "long " * 30_000 + "fin")]
    df = spark.createDataFrame(rows, "id bigint, x string").withColumn("t", F.lit(1)).withColumn("key", F.lit("a"))
    for threshold, width, least in ((0.6, 3, 20), (0.8, 5, 1)):
        got = {tuple(r) for r in N.near_duplicate_records(df, "id", "x", threshold, width, least).collect()}
        want = brute(rows, threshold, width, least)
        assert got <= want and len(got) >= 0.98 * len(want) and want


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, x string")
    assert N.near_duplicate_records(df, "id", "x").count() == 0


def test_vantage_forest_finds_all_pairs_within_radius(monkeypatch):
    monkeypatch.setattr(N, "AT_ONCE", 50)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (60, 2), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (600, 2), dtype=np.uint64)
    f = np.concatenate([base, np.repeat(base, 10, 0) ^ flips, np.repeat(base[:1], 40, 0)])
    for shard in (np.zeros(len(f), int), np.sort(rng.integers(0, 9, len(f))), np.arange(len(f))):
        counts = {}
        found = [(min(a, b), max(a, b)) for x, y in N.vantage_forest(shard, f, 20, counts) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        d = np.bitwise_count(f[:, None] ^ f[None]).sum(-1)
        assert sorted(found) == sorted((i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if d[i, j] <= 20 and shard[i] == shard[j])
        n = np.bincount(shard)
        assert counts.get("compared", 0) + counts.get("pruned", 0) == (n * (n - 1) // 2).sum()


def test_groups(spark):
    rows = [(1, "un deux trois quatre cinq six"), (2, "un deux trois quatre cinq six"), (3, "un deux trois quatre cinq six sept"), (4, "rien de tout cela ici même"), (5, None), (6, "court")]
    got = {tuple(r) for r in N.near_duplicate_groups(spark.createDataFrame(rows, "id bigint, x string"), "id", "x", 0.6, 3, 5).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0)}


def test_large_class_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "CLASS_ROWS", 7)
    rows = [(k, "un deux trois quatre cinq six" + (" sept" if k % 5 == 0 else "")) for k in range(60)]
    got = [tuple(r) for r in N.near_duplicate_records(spark.createDataFrame(rows, "id bigint, x string"), "id", "x", 0.6, 3, 5).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]

def test_large_shards_go_to_the_second_round(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 8)
    rows = corpus(60, 3)
    base = rows[0][1]
    rows += [(1000 + k, base + f" fin{k}") for k in range(40)]  # a hot shard of different texts
    df = spark.createDataFrame(rows, "id bigint, x string")
    got = {tuple(r) for r in N.near_duplicate_records(df, "id", "x", 0.6, 3, 20).collect()}
    want = brute(rows, 0.6, 3, 20)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_usual_phrases_make_few_pairs():
    """Texts that have a tenth in common hardly meet, however many they are; texts at the threshold do."""
    use = {k: p.default for k, p in inspect.signature(N.near_pairs).parameters.items() if k in ("bands", "rows")}
    h, rng = N.Hasher(3, **use), np.random.default_rng(3)

    def met(similarity, n=3000, size=80):
        both = round(size * 2 * similarity / (1 + similarity))
        sets = [np.unique(np.concatenate([c, rng.integers(0, 2**32, size - both, dtype=np.uint32)])) for c in rng.integers(0, 2**32, (n, both), dtype=np.uint32) for _ in "ab"]
        keys, f = h.sign(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]))
        near = N.distance(f[::2], f[1::2]) <= 41
        shard = (keys[::2] == keys[1::2]).any(1)
        return shard.mean(), (shard & near).mean()

    assert met(0.1)[0] < 0.008
    assert met(0.6)[1] > 0.985 and met(0.7)[1] > 0.998
