"""Splitting oversized items at natural boundaries, by ranges.

No item is cut whole. It is laid out in ranges of RANGE code points (bytes for files), and
the ranges are dealt to all tasks; a worker gets its range with a halo on both sides, finds the
natural boundary at which its range really begins and the one at which the next begins (both
from text it holds, so neighbours agree), and cuts what lies between. The boundary tables of
the ranges are stitched by a prefix sum over the pieces per range, which numbers the pieces,
and over the lengths, which turns bytes into code points for files.

A cut is made at the best kind of boundary in the second half of the room that is left,
at the last one of that kind: blank line, line end, sentence end, clause end, blank.
Only where there is none in the whole room the text is cut hard, never before a
combining mark. Every piece but an item's first begins ``overlap`` code points before the
end of the piece before it, and has at most ``limit`` code points in all.

Defined results: null and short items are not split (they have no pieces); an overlap is
at most half of the limit; repeated rows of one item give its pieces once; an item kind
without a limit is not split; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = 1 << 16
SENTENCE = re.compile(r"[.!?…][\"»”')\]]*\s+")
CLAUSE = re.compile(r"[;:,]\s+")
BLANK = re.compile(r"\s+")
JOINERS = {"‍", "︎", "️"}


def whole(text: str, at: int) -> int:
    """The nearest place at or before ``at`` that parts no combining sequence."""
    k = at
    while 0 < k < len(text) and at - k < 32 and (unicodedata.combining(text[k]) or text[k] in JOINERS or text[k - 1] == "‍"):
        k -= 1
    return k if 0 < k and at - k < 32 else at


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    end = -1
    for m in pattern.finditer(text, low, high):
        end = m.end()
    return end


def natural_end(text: str, low: int, high: int) -> int:
    """The end of the last boundary of the best kind that ends in (low, high]; -1 if there is none."""
    if (k := text.rfind("\n\n", low, high)) >= 0:
        return k + 2
    if (k := text.rfind("\n", low, high)) >= 0:
        return k + 1
    for pattern in (SENTENCE, CLAUSE):
        if (k := _last(pattern, text, low, high)) > low:
            return k
    if (k := text.rfind(" ", low, high)) >= 0:
        return k + 1
    return _last(BLANK, text, low, high)


def range_start(text: str, at: int, halo: int) -> int:
    """Where the range that is laid out at ``at`` really begins: the first boundary of the best kind in the halo."""
    high = min(len(text), at + halo)
    for mark in ("\n\n", "\n"):
        if (k := text.find(mark, at, high)) >= 0 and k + len(mark) < len(text):
            return k + len(mark)
    for pattern in (SENTENCE, CLAUSE, BLANK):
        if (m := pattern.search(text, at, high)) and m.end() < high:
            return m.end()
    return whole(text, at)


def cuts(text: str, begin: int, end: int, limit: int, overlap: int, first: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of text[begin:end]; all but an item's first reach ``overlap`` back."""
    at = begin
    while at < end:
        start = at if first else at - overlap
        high = start + limit
        if high >= end:
            stop = end
        else:
            stop = natural_end(text, at + (high - at) // 2, high)
            if stop <= at:
                stop = natural_end(text, at, high)
            if stop <= at:
                stop = whole(text, high)
                if stop <= at:
                    stop = high
        yield start, stop
        at, first = stop, False


PIECE = "start bigint, n_chars int, piece string"


def _range_pieces(x: str, n: int, limit: int, over: int, k: int, frm: int, span: int) -> list[tuple[int, int]]:
    """(start, end) within ``x`` of the pieces that belong to range ``k`` of an item of ``n`` code points; x begins at ``frm``."""
    begin = 0 if k == 0 else range_start(x, k * span - frm, limit)
    end = len(x) if (k + 1) * span >= n else range_start(x, (k + 1) * span - frm, limit)
    return list(cuts(x, begin, end, limit, over, k == 0))


def piece_table(items: DataFrame, keys: list[str], text: str, limit: str, overlap: str, with_text: bool = True, span: int = RANGE) -> DataFrame:
    """(keys, piece_no, start, n_chars[, piece]) of every item longer than its limit; start counts code points from 0.

    Items of one range are cut where they lie. Longer ones are sliced into ranges in one pass and
    dealt to all tasks by (keys, range); the pieces of each range are counted, the prefix sum over
    that small table gives the number of a range's first piece, and the text is emitted last.
    """
    i = items.where(F.col(limit) > 0).where(F.length(F.col(text)) > F.col(limit))
    i = i.select(*keys, F.col(text).alias("_x"), F.length(F.col(text)).alias("_n"), F.col(limit).cast("int").alias("_limit"), F.least(F.coalesce(F.col(overlap), F.lit(0)), F.floor(F.col(limit) / 2)).cast("int").alias("_over"))
    nk, kinds = len(keys), ", ".join(f"`{k}` {i.schema[k].dataType.simpleString()}" for k in keys)
    fields = ["_x", "_n", "_limit", "_over", "_range", "_from"]

    def lay_out(batches):
        """Slices items into ranges with their halos, each in time linear in its text."""
        for b in batches:
            for r, (x, n, lim, over) in enumerate(zip(*(b.column(nk + j).to_pylist() for j in range(4)), strict=True)):
                for first in range(0, n, 64 * span):
                    ks = range(first // span, min(first // span + 64, -(-n // span)))
                    froms = [max(0, k * span - over - 64) for k in ks]
                    parts = [x[f : (k + 1) * span + lim + 64] for k, f in zip(ks, froms, strict=True)]
                    m = len(parts)
                    at = pa.array([r] * m, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(j).take(at) for j in range(nk)), pa.array(parts), *(pa.array([v] * m, pa.int32()) for v in (n, lim, over)), pa.array(list(ks), pa.int32()), pa.array(froms, pa.int32())],
                        names=[*keys, *fields],
                    )

    def pieces(batches):
        """The pieces of a range, numbered from ``_first`` on."""
        for b in batches:
            row, number, start, size, piece = [], [], [], [], []
            for r, (x, n, lim, over, k, frm, first) in enumerate(zip(*(b.column(nk + j).to_pylist() for j in range(7)), strict=True)):
                for j, (s, e) in enumerate(_range_pieces(x, n, lim, over, k, frm, span)):
                    row.append(r)
                    number.append(first + j)
                    start.append(frm + s)
                    size.append(e - s)
                    piece.append(x[s:e] if with_text else None)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j).take(at) for j in range(nk)), pa.array(number, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(piece, pa.string())],
                names=[*keys, "piece_no", "start", "n_chars", "piece"],
            )

    def counts(batches):
        for b in batches:
            got = [len(_range_pieces(*v, span)) for v in zip(*(b.column(nk + j).to_pylist() for j in range(6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(nk)), b.column(nk + 4), pa.array(got, pa.int64())], names=[*keys, "_range", "_pieces"])

    zero = F.lit(0)
    small = i.where(F.col("_n") <= span)
    if with_text:  # repeated rows go before the text is cut
        small = small.dropDuplicates(keys)
    small = small.select(*keys, "_x", "_n", "_limit", "_over", zero.alias("_range"), zero.alias("_from"), zero.cast("bigint").alias("_first"))
    of_small = small.mapInArrow(pieces, f"{kinds}, piece_no bigint, {PIECE}")
    if not with_text:
        of_small = of_small.dropDuplicates([*keys, "piece_no"])

    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = i.where(F.col("_n") > span).mapInArrow(lay_out, f"{kinds}, _x string, _n int, _limit int, _over int, _range int, _from int")
    ranges = ranges.repartition(tasks, *keys, "_range").dropDuplicates([*keys, "_range"])
    # one small row per range of a long item
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.mapInArrow(counts, f"{kinds}, _range int, _pieces bigint").withColumn("_first", F.coalesce(F.sum("_pieces").over(before), zero.cast("bigint"))).drop("_pieces")
    of_long = ranges.join(first, [*keys, "_range"]).select(*keys, *fields, "_first").mapInArrow(pieces, f"{kinds}, piece_no bigint, {PIECE}")
    out = of_small.unionByName(of_long)
    return out if with_text else out.drop("piece")


def own_lengths(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_chars, longest): the code points of each item without the overlaps, and those of its longest piece, from the pieces alone."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("piece_no"))  # over small rows, without text
    own = pieces.select(*keys, "start", "n_chars", nxt.alias("_next"))
    return own.groupBy(*keys).agg(F.max(F.when(F.col("_next").isNull(), F.col("start") + F.col("n_chars"))).alias("n_chars"), F.max("n_chars").alias("longest"))


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def split_files(spark: SparkSession, path: str, limit: int, overlap: int, span: int = 8 << 20) -> DataFrame:
    """(path, piece_no, start, n_chars, piece) of UTF-8 text files of any size; no file is read whole by anyone.

    Workers read byte ranges with halos from storage that all executors reach.
    Bytes that are no UTF-8 become U+FFFD. An empty file has no piece.
    """
    overlap, halo = min(overlap, limit // 2), 4 * limit + 256
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("rng", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / span)))).repartition(F.col("path"), F.col("rng"))

    def load(p: str, n: int, k: int) -> tuple[str, list[tuple[int, int]]]:
        """The text around range k, and the pieces that belong to the range."""
        with _open(p) as f:
            low = max(0, k * span - 4 * overlap - 256)
            f.seek(low)
            raw = f.read(min(n, (k + 1) * span + halo) - low)
        # ranges are laid out at character starts, found by bytes; each side of a seam decodes the same bytes
        edges = []
        for at in (k * span - low, (k + 1) * span - low):
            while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            edges.append(min(at, len(raw)))
        skip = 0
        while low and skip < 4 and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
            skip += 1
        stop = len(raw)
        if low + len(raw) < n:  # not in the middle of a character
            while stop and raw[stop - 1] & 0xC0 == 0x80:
                stop -= 1
            stop -= 1
        parts = [raw[x:y].decode("utf-8", "replace") for x, y in ((skip, edges[0]), (edges[0], edges[1]), (edges[1], max(stop, edges[1])))]
        t = "".join(parts)
        begin = 0 if k == 0 else range_start(t, len(parts[0]), limit)
        end = len(t) if (k + 1) * span >= n else range_start(t, len(parts[0]) + len(parts[1]), limit)
        return t, list(cuts(t, begin, end, limit, overlap, k == 0))

    def boundaries(batches):
        for b in batches:
            path, length, rng = (b.column(j).to_pylist() for j in range(3))
            got = [load(*x)[1] for x in zip(path, length, rng, strict=True)]
            reach = [(g[-1][1] - g[0][0] - (0 if k == 0 else overlap)) if g else 0 for g, k in zip(got, rng, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(g) for g in got], pa.int64()), pa.array(reach, pa.int64())], names=["path", "length", "rng", "pieces", "chars"])

    def emit(batches):
        for b in batches:
            for p, n, k, first, start in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                t, got = load(p, n, k)
                base = start - got[0][0] - (0 if k == 0 else overlap) if got else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in (([p] * len(got), pa.string()), ([first + j for j in range(len(got))], pa.int64()), ([base + s for s, _ in got], pa.int64()), ([e - s for s, e in got], pa.int32()), ([t[s:e] for s, e in got], pa.string()))],
                    names=["path", "piece_no", "start", "n_chars", "piece"],
                )

    seams = ranges.mapInArrow(boundaries, "path string, length bigint, rng bigint, pieces bigint, chars bigint")
    # one small row per range of a file
    before = Window.partitionBy("path").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    numbered = seams.select("path", "length", "rng", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("pieces", "first"), ("chars", "start"))))
    return numbered.repartition("path", "rng").mapInArrow(emit, "path string, piece_no bigint, start bigint, n_chars int, piece string")
