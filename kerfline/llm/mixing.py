"""Mixing sources to target weights, sizes in tokens of a public tokenizer.

Source weights come from temperature mixing: natural token shares q are tilted towards
the targets t by an exponent, w = q * (t / q) ** a, normalised. a = 1 gives the target, a = 0
the natural share. The mixture has a stated budget, by default the tokens of all sources
that have a target (one corpus). A source that would need more than ``max_repeats`` uses of
a record at that budget is tempered: its exponent is bisected to the greatest value at
which its repetition limit holds, and the share it gives up goes to the others in
proportion to their targets. So one tiny source bounds its own share, not the mixture,
and all others keep their targets in proportion. With ``target_entropy`` one exponent for
all sources is bisected until the entropy of the weights meets it.

The weights are realised per source as whole passes over all records and one pass that
is cut: records lie in blocks by a seeded hash, blocks are permuted by a seeded hash,
whole blocks are taken while the budget lasts, and only the block in which it ends is
ordered record by record. So a source that holds a third of all rows is summed and
permuted in many tasks.

Defined results: source names match after trimming, lower-casing and reading blanks and
hyphens as underscores; records of sources without a target, of a null source or
without tokens are not mixed (the report counts them); a target whose source has no
record gets share 0 and its share is spread over the others in proportion; a repeated
record id is kept once; empty tables give an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerfline.llm.encoding import DEFAULT_VOCABULARY, count_tokens
from kerfline.session import cut

#: Blocks per source; each holds about a 4096th of the source's records.
BLOCKS = 4096


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, source, n_tokens), one row per key."""
    t = count_tokens(df.select(F.col(key), source_name(F.col(source)).alias("source"), F.col(text).alias("_text")), "_text", vocabulary)
    return t.groupBy(key).agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))


def weights_at(a: float, natural: dict[str, float], target: dict[str, float]) -> dict[str, float]:
    raw = {s: tilted(a, natural[s], target[s]) for s in target}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def bisect(ok, low: float, high: float) -> float:
    """The greatest value in [low, high] at which ``ok`` holds, which it does below it."""
    if ok(high):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


#: The lowest exponent tried; there a source of half its target share has 1 / 2**20 of it.
COLDEST = -20.0


def solve_weights(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], float, dict[str, float]]:
    """(weights, budget in tokens, exponents) by source. ``tokens`` and ``targets`` have one entry per target source (a fixed, small table).

    The budget is lowered where the limits can't hold at it with any exponents.
    """
    live = {s: t for s, (t, r) in targets.items() if t > 0 and r > 0 and tokens.get(s, 0) > 0}
    if not live:
        return {}, 0.0, {}
    whole, mass = sum(tokens[s] for s in live), sum(live.values())
    target = {s: t / mass for s, t in live.items()}
    natural = {s: tokens[s] / whole for s in live}
    room = {s: tokens[s] * targets[s][1] for s in live}
    total = float(whole if budget is None else budget)
    if target_entropy is not None:
        rising = entropy(target) >= entropy(natural)
        a = bisect(lambda x: (entropy(weights_at(x, natural, target)) <= target_entropy) == rising, 0.0, 1.0)
        power = dict.fromkeys(live, a)
        w = weights_at(a, natural, target)
    else:
        total = min(total, float(sum(room.values())))
        power = dict.fromkeys(live, 1.0)
        w = dict(target)
        for _ in range(20 * len(live)):
            over = [s for s in live if w[s] * total > room[s] * (1 + 1e-9) and power[s] > COLDEST]
            if not over:
                break
            for s in over:
                rest = sum(tilted(power[x], natural[x], target[x]) for x in live if x != s)
                fits = lambda x, s=s, rest=rest: tilted(x, natural[s], target[s]) * total <= room[s] * (tilted(x, natural[s], target[s]) + rest)
                power[s] = bisect(fits, COLDEST, power[s])
            raw = {s: tilted(power[s], natural[s], target[s]) for s in live}
            w = {s: v / sum(raw.values()) for s, v in raw.items()}
    return w, min(total, min(room[s] / w[s] for s in live if w[s] > 0)), power


def tilted(a: float, natural: float, target: float) -> float:
    return natural * (target / natural) ** a


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", budget: float | None = None, target_entropy: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) from ``sizes`` (cut it first: it is read several times) and the target table.

    mixture: key, source, n_tokens, copies. report: one row per target source.
    """
    spark = sized.sparkSession
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect() if r.source is not None}
    by = sized.join(F.broadcast(spark.createDataFrame([(s,) for s in want], "source string")), "source")
    got = {r.source: r.n for r in by.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    w, total, power = solve_weights(got, want, budget, target_entropy)
    plan = []
    for s, (share, most) in want.items():
        quota = w.get(s, 0.0) * total
        full = min(int(quota // got[s] + 1e-9), most) if got.get(s) else 0
        rest = quota - full * got[s] if got.get(s) and full < most else 0.0
        plan.append((s, share, most, w.get(s, 0.0), quota, full, max(rest, 0.0), power.get(s)))
    # as many rows as the target table has
    quotas = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, weight double, quota double, full_passes int, rest double, exponent double")
    used = sized.where("n_tokens > 0").join(F.broadcast(quotas), "source").withColumn("_block", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BLOCKS)))
    blocks = used.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_block_tokens"), F.first("rest").alias("rest"))
    # at most BLOCKS rows per source
    order = Window.partitionBy("source").orderBy(F.xxhash64("_block", F.lit(seed + 1)), "_block")
    ends = blocks.withColumn("_end", F.sum("_block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = ends.select("source", "_block", (F.col("_end") - F.col("_block_tokens")).alias("_start"), (F.col("_end") <= F.col("rest")).alias("_whole"))
    # two longs and a flag for each of at most BLOCKS * targets blocks
    placed = used.join(F.broadcast(place), ["source", "_block"])
    whole = placed.where("_whole").select(key, "source", "n_tokens", (F.col("full_passes") + 1).alias("copies"))
    beyond = placed.where("NOT _whole AND _start >= rest").select(key, "source", "n_tokens", F.col("full_passes").alias("copies"))
    edge = placed.where("NOT _whole AND _start < rest")
    inside = Window.partitionBy("source", "_block").orderBy(F.xxhash64(F.col(key), F.lit(seed + 2)), key)
    cutting = edge.withColumn("_end", F.col("_start") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    cutting = cutting.select(key, "source", "n_tokens", (F.col("full_passes") + (F.col("_end") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).alias("copies"))
    mixture = whole.unionByName(beyond).unionByName(cutting).where("copies > 0")
    used_up = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("records_used"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("n_tokens") == 0).alias("records_without_tokens"), F.sum("n_tokens").alias("source_tokens"))
    report = quotas.join(used_up, "source", "left").join(there, "source", "left").fillna(0, ["records_used", "uses", "most_uses", "tokens", "records", "records_without_tokens", "source_tokens"])
    report = report.withColumn("actual_share", F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))))
    report = report.select(
        "source", "target_share", F.col("weight").alias("share_aimed_at"), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), "max_repeats", "most_uses", "records", "records_without_tokens",
        "records_used", "uses", "source_tokens", "tokens", "exponent", F.lit(entropy(w)).alias("entropy"), F.lit(float(total)).alias("budget_tokens"),
    )
    return mixture, report


def mixture_of(documents: DataFrame, targets: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    return mix(cut(sizes(documents)), targets, **options)
