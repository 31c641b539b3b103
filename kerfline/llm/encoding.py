"""Corpus encoding with a public byte-level BPE vocabulary.

Words are cut by the vocabulary's own pre-tokenizer pattern. Distinct words are
sorted into length buckets, each bucket is one padded integer matrix, and every
round every row merges its leftmost pair of minimum rank. Pairs are found in an
open-addressing hash table held in two numpy arrays; after a round each merged row
is one column shorter, and rows that have no pair left leave the matrix.

Defined results: a null or an empty text has the empty list of ids; strings that
look like special tokens are ordinary text; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-tokenizer pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128)
NO_RANK = np.int32(2**31 - 1)
EMPTY = np.uint32(0xFFFFFFFF)
TABLE_BITS = 18
#: Words a Python worker remembers before it starts afresh; a bound on memory, results do not depend on it.
REMEMBERED_WORDS = 400_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in the vocabulary file: printable Latin-1 stays, the rest follow from U+0100."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, fresh = {b: chr(b) for b in stay}, 256
    for b in range(256):
        if b not in letters:
            letters[b], fresh = chr(fresh), fresh + 1
    return letters


class PairTable:
    """(left id, right id) -> (rank, merged id), linear probing over a power-of-two table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        size = 1 << TABLE_BITS
        self.keys = np.full(size, EMPTY, np.uint32)
        self.ranks = np.full(size, NO_RANK, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at = slot[todo]
            first = np.unique(at, return_index=True)[1]
            free = first[self.keys[at[first]] == EMPTY]
            self.keys[at[free]] = keys[todo[free]]
            self.ranks[at[free]] = todo[free]
            rest = np.ones(len(todo), bool)
            rest[free] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & (size - 1)
        self.merged = merged.astype(np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((seen != keys) & (seen != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen != EMPTY)]
        return out


class Encoder:
    def __init__(self, path: str):
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        self.table = PairTable(left, right, np.array([vocab[a + b] for a, b in pairs]))
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.words_of = regex.compile(PATTERN).findall
        self.cut_at_spaces = regex.compile(r"(?<=\S) (?=\S)").split
        self.after_space = re.compile(r" \s").search
        self.before_space = re.compile(r"[^\S \n] ").search
        self._forget()

    def _forget(self) -> None:
        #: By words; by chunks that follow a space; by chunks that begin a text.
        self.words: dict[str, np.ndarray] = {}
        self.spaced: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.store = np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- merging ---------------------------------------------------------
    def merge_matrix(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix to its end; returns the matrix (padded by -1) and the row sizes."""
        n, width = ids.shape
        final = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], ids, -1)
        ranks = np.full((n, width), NO_RANK, np.int32)
        real = column[None, 1:] < sizes[:, None]
        a, b = ids[:, :-1][real], ids[:, 1:][real]
        ranks[:, :-1][real] = self.table.rank(a, b)
        while len(rows):
            best = ranks.argmin(1)
            at = np.arange(len(rows))
            low = ranks[at, best]
            live = low != NO_RANK
            if not live.all():
                done = ~live
                final[rows[done], : ids.shape[1]] = ids[done]
                rows, ids, ranks, best, low = rows[live], ids[live], ranks[live], best[live], low[live]
                if not len(rows):
                    break
                at = np.arange(len(rows))
            ids[at, best] = self.table.merged[low]
            keep = np.ones(ids.shape, bool)
            keep[at, best + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep[at, best + 1] = True  # of the two pairs that touched the merged ones, one is gone
            keep[at, best] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            w = ids.shape[1]
            for left in (best - 1, best):  # only the pairs beside the new token have a new rank
                ok = (left >= 0) & (left + 1 < w)
                r, c = at[ok], left[ok]
                x, y = ids[r, c], ids[r, c + 1]
                whole = y >= 0
                ranks[r, c] = NO_RANK
                ranks[r[whole], c[whole]] = self.table.rank(x[whole], y[whole])
            over = best >= w
            if over.any():
                raise AssertionError("a merge beyond the row")
            last = best == w - 1
            ranks[at[last], best[last]] = NO_RANK
        return final, (final >= 0).sum(1)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One very long row: each round merges all places of the minimum rank, leftmost first.

        A pair made of a merged token ranks later than the merge that made the token,
        so this is the same as merging these places one after the other.
        """
        while len(ids) > 1:
            ranks = self.table.rank(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NO_RANK:
                break
            at = np.flatnonzero(ranks == low)
            run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
            within = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            at = at[within % 2 == 0]
            ids[at] = self.table.merged[low]
            ids = np.delete(ids, at + 1)
        return ids

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        out: list[np.ndarray] = [flat[:0]] * len(words)
        below = 0
        for top in BUCKETS:
            rows = np.flatnonzero((sizes > below) & (sizes <= top))
            below = top
            if len(rows):
                take = np.minimum(starts[rows, None] + np.arange(top), len(flat) - 1)
                got, n = self.merge_matrix(flat[take], sizes[rows])
                for k, r in enumerate(rows):
                    out[r] = got[k, : n[k]]
        for r in np.flatnonzero(sizes > below):
            out[r] = self.merge_long(flat[starts[r] : starts[r] + sizes[r]].copy())
        return out

    # -- texts -----------------------------------------------------------
    def _remember(self, chunks: list[str], index: dict[str, int], lead: str) -> None:
        """Put the ids of new chunks into the store."""
        parts = [self.words_of(lead + c) for c in chunks]
        new = list({w for p in parts for w in p}.difference(self.words))
        if new:
            self.words.update(zip(new, self.encode_words(new), strict=True))
        none = self.store[:0]
        ids = [self.words[p[0]] if len(p) == 1 else np.concatenate([none, *(self.words[w] for w in p)]) for p in parts]
        base = len(self.starts)
        index.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        n = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(n) - n])
        self.sizes = np.concatenate([self.sizes, n])
        self.store = np.concatenate([self.store, *ids])

    def _has_odd_space(self, t: str) -> bool:
        """Whether some space isn't between two visible characters."""
        return bool(t[0] == " " or t[-1] == " " or "\n " in t or self.after_space(t) or self.before_space(t))

    def _chunks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the store of every chunk, and chunks per text.

        A space between two visible characters always begins a word of the pattern, so
        texts are first cut there and whole chunks are looked up.
        """
        heads: list[str] = []
        spaced: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                c = self.cut_at_spaces(t) if self._has_odd_space(t) else t.split(" ")
                counts[k] = len(c)
                heads.append(c[0])
                spaced += c[1:]
        if len(self.spaced) + len(self.words) > REMEMBERED_WORDS:
            self._forget()
        if new := list(set(heads).difference(self.first)):
            self._remember(new, self.first, "")
        if new := list(set(spaced).difference(self.spaced)):
            self._remember(new, self.spaced, " ")
        at = np.empty(len(heads) + len(spaced), np.int64)
        head = np.zeros(len(at), bool)
        used = counts[counts > 0]
        head[np.cumsum(used) - used] = True
        at[head] = np.fromiter(map(self.first.__getitem__, heads), np.int64, len(heads))
        at[~head] = np.fromiter(map(self.spaced.__getitem__, spaced), np.int64, len(spaced))
        return at, counts

    def _ends(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.sizes[at])])
        return total[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        at, counts = self._chunks(texts)
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        values = self.store[np.repeat(self.starts[at] - before, sizes) + np.arange(int(sizes.sum()))]
        return pa.ListArray.from_arrays(pa.array(self._ends(at, counts).astype(np.int32)), pa.array(values))

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, counts = self._chunks(texts)
        return np.diff(self._ends(at, counts))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, one row per input row; other columns are not read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), e.encode(b.column(1).to_pylist())], names=[key, "ids"])

    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """All columns but the text, and the number of tokens of the text (0 for a null or an empty text)."""
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            n = e.count(b.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n)], names=[*(f.name for f in rest), out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` bigint"])
    return df.select(*[F.col(f"`{f.name}`") for f in rest], F.col(text).alias("_text")).mapInArrow(run, schema)
