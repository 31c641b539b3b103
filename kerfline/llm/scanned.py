"""Noise in text read from scanned pages: finding it, and repairing the text.

1. Words of all documents are counted (distributed). Words with at least SHARE of all word
   places are the frequent words; there are at most 1 / SHARE of them at any size.
2. Furniture of each document: lines repeated from page to page (apart from a page
   number, and with misread letters), and lines that carry only a page number. Bare
   numbers count where they go on from page to page.
3. Words cut at a line end: the mark isn't part of the word if the frequent words have the
   joined word more often than the hyphenated one.
4. Skip-gram vectors. The pairs of words within a window are counted over all documents
   (distributed), and the vectors are what skip-gram with one negative sample a pair tends to:
   the factors of the pointwise mutual information of its pairs (Levy, Goldberg 2014), its
   positive part, found by rounds of products over the counted pairs. Only shares of pairs
   enter and the rounds are a fixed number, so the vectors stay when all counts grow alike.
   A rare word lies where its surroundings lie: its vector is the mean of those of the words
   around all its places.
5. Misread words: for each rare word the frequent words that plausible glyph edits lead to
   are ranked by how near they are to it among the frequent words, and how near to the
   surroundings of the place itself. That rank and the counts decide together, for every
   place: a word that fits its place needs less evidence from counts than one that doesn't.
   Spaced-out and broken words are judged in the same way by their joined form.
6. Repair drops the furniture, joins cut words, replaces misread ones and reflows lines.

Defined results: null, empty and blank contents have no noise and repair to null or an
empty text; every content and every quotation in a message is searched, whether or not it
bears other traces of scanning; redelivered rows add nothing; texts of any length are read whole; an empty
table has no noise; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.session import cut

#: Letters of the longest word that is counted.
LONGEST = 39
#: (misread, true) glyphs; the first group can't be in a word, the second can.
ODD = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "é"), ("6", "b"), ("6", "e"), ("8", "b"), ("9", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("†", "t"), ("‡", "t"), ("@", "a"), ("¢", "c"), ("€", "e"), ("$", "s"), ("§", "s"), ("|", "l"), ("!", "l"), ("!", "i"), ("£", "e"), ("e'", "é"), ("e`", "è"), ("a`", "à"), ("e´", "é"), ("e^", "ê"), ("u`", "ù"), ("c,", "ç"), ("µ", "u"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("(", "c"), ("[", "l"), ("]", "l"), ("}", "j"), ("¡", "i"), ("°", "o"), ("®", "o"), ("©", "c"), ("¥", "y")]
PLAIN = [("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("vv", "w"), ("y", "v"), ("v", "y"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("u", "n"), ("n", "u"), ("h", "b"), ("b", "h"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("q", "g"), ("g", "q"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("fi", "ﬁ"), ("in", "m"), ("m", "in"), ("nn", "m"), ("ni", "m"), ("r", "n"), ("s", "5"), ("è", "é"), ("é", "è"), ("e", "é"), ("é", "e"), ("ê", "é"), ("i", "j"), ("j", "i"), ("lc", "k"), ("tl", "d"), ("ll", "u"), ("rr", "n"), ("s", "a"), ("z", "s"), ("s", "z"), ("iii", "m"), ("w", "vv"), ("b", "lo"), ("x", "k")]
def by_first(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    got: dict[str, list[tuple[str, str]]] = {}
    for a, b in rules:
        got.setdefault(a[0], []).append((a, b))
    return got


ODD_AT, PLAIN_AT = by_first(ODD), by_first(PLAIN)
#: Accents read as marks of their own.
ACCENTS = [("e'", "é"), ("e`", "è"), ("a`", "à"), ("e´", "é"), ("e^", "ê"), ("u`", "ù"), ("c,", "ç"), ("e’", "é")]
DETACHED = re.compile(r"(?:[ea]`|e['´^’]|u`|c,)(?=[^\W\d_])")
ELIDED = re.compile(r"(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu)['’]")
LIGATURES = "ﬁﬂﬀﬃﬄ"
#: How many times as frequent the true word must be.
RATIO = 12
#: Evidence that the true word needs at least; more rows can only add to it.
LEAST = 4
#: Share of all word places that makes a frequent word; where nothing is there to compare it with, a form with
#: this share counts as a word of its own.
SHARE = 2e-6
#: How many times the evidence of counts the fit of the surroundings is worth, from the worst to the best: e ** FIT.
FIT = 4.0
#: Links of rare words (less than RARE of all word places) whose counts fall short by this factor at most are left to
#: the surroundings.
SOFT, RARE = 4.0, 4e-5
EDGE = ".,;:!?…()[]{}«»“”\"<>‹›*•–—-"
LETTERS = re.compile(r"[^\W\d_]+")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
CODE = re.compile(r"[\W\d_]*|[A-Z]{1,4}[-.]?[\d.:/-]+|(?:CVE|ISO|REF|POL|PROC)\b.*|[\d.,:/%-]+[a-zA-Zèéº°]{0,4}|https?:.*|www\..*|\S+@\S+\.\w+|\d+[a-z]?|n[°º]?\d*")
CUT_END = re.compile(r"([^\W_][\w'’@†¢€$|!]*(?:-[^\W\d_]+)*)\s?([-‐‑¬­])\s*$")
MARKS = frozenset("-‐‑¬\xad")
SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_] ){2,}[^\W\d_](?![\w'’])")
PAGE = re.compile(r"(?:p[aoe@4][gq9][ecé]s?|pg|p|pag|seite|página|folio|feuillet)\b[\s.:n°º]*([\dlIOoSi|]{1,4}|[ivxl]{1,6})(?:\s*(?:/|sur|of|von|de|su r|sut|snr)\s*[\dlIOoSB|]{1,4})?", re.IGNORECASE)
N_OF_M = re.compile(r"([\dlIOoSB|]{1,4})\s*(?:/|sur|of|von)\s*([\dlIOoSB|]{1,4})")
DASHED = re.compile(r"[-–—~=]+\s*([\dlIOoSB|]{1,4}|[ivxlcIVXLC]{1,6})\s*[-–—~=]+")
BARE = re.compile(r"[|\[(\s]*([\dlIOoSB]{1,4}|[ivxlc]{1,6}|[IVXLC]{1,6})[|\])\s.]*")
DIGIT = re.compile(r"\d")
NUMBER_AT_EDGE = re.compile(r"^\W*(?:p(?:age|\.)?\s*)?\d{1,4}(?:\s*(?:/|sur|of)\s*\d{1,4})?\s*[-–—|/:]?\s+|[\s|–—/-]*(?:p(?:age|\.)?\s*)?\d{1,4}(?:\s*(?:/|sur|of)\s*\d{1,4})?\W*$", re.IGNORECASE)
HEADING = re.compile(r"(?:section|chapitre|article|annexe|titre|partie|part|chapter|appendix|\d+(?:\.\d+)*[.)]?)\s", re.IGNORECASE)
DIGITS = str.maketrans("lI|OoSB", "1110058")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
QUOTES = re.compile(r"«\s*(.*?)\s*»|<(.*?)>|\"(.*?)\"|“(.*?)”", re.DOTALL)


def fold(s: str) -> str:
    return s.lower() if s.isascii() else re.sub("[\u0300-\u036f]+", "", unicodedata.normalize("NFKD", s)).lower()


def cut_end(line: str) -> re.Match | None:
    """The match of a word and a mark at the end of a line."""
    return CUT_END.search(line[-70:]) if line.rstrip()[-1:] in MARKS else None


def detached(core: str) -> tuple[str, str] | None:
    """(elided word before it, word with an accent beside its letter) of a lower-cased chunk, if it has such an accent."""
    if not DETACHED.search(core):
        return None
    m = ELIDED.match(core)
    return (m[0], core[m.end() :]) if m else ("", core)


def page_value(s: str) -> int:
    if s.isascii() and s.isdigit():
        return int(s)
    if re.fullmatch(r"[ivxlc]+|[IVXLC]+", s):
        v = [ROMAN[c] for c in s.lower()]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))
    t = s.translate(DIGITS)
    return int(t) if t.isdigit() else -1


# -- furniture -------------------------------------------------------------
def furniture(lines: list[str]) -> dict[int, str]:
    """Line number -> ``running_line`` or ``page_number``."""
    out: dict[int, str] = {}
    bare: list[tuple[int, int]] = []
    for k, line in enumerate(lines):
        s = line.strip().strip("'`´·.,; ")
        if not s or len(s) > 28:
            continue
        inner = s.strip("[](){}<> ")
        if PAGE.fullmatch(inner) or (DASHED.fullmatch(s) and len(s) < 14) or N_OF_M.fullmatch(inner):
            out[k] = "page_number"
        elif (m := BARE.fullmatch(s)) and 0 < page_value(m[1]) < 1000:
            bare.append((k, page_value(m[1])))
    # bare numbers that go on by one from page to page, the longest such chain
    chain: dict[int, list[int]] = {}
    best: list[int] = []
    for k, v in bare:
        chain[v] = [*chain.get(v - 1, []), k] if len(chain.get(v - 1, [])) >= len(chain.get(v, [])) else chain[v]
        if len(chain[v]) > len(best):
            best = chain[v]
    values = dict(bare)
    if len(best) >= 2 or (len(best) == 1 and values[best[0]] <= 2 and len(bare) == 1):
        out.update(dict.fromkeys(best, "page_number"))
    # lines repeated from page to page
    at: dict[str, list[int]] = {}
    for k, line in enumerate(lines):
        s = line.strip()
        if k in out or not 8 <= len(s) <= 110 or s[0].islower():
            continue
        bare_line = NUMBER_AT_EDGE.sub("", s) if DIGIT.search(s) else s
        key = " ".join(LETTERS.findall(fold(bare_line))) + "#" + "".join(filter(str.isdigit, bare_line))
        if len(key) >= 7:
            at.setdefault(key, []).append(k)

    def interrupts(k: int) -> bool:
        if k == 0 or k in out:
            return False
        near = [j for j in range(max(0, k - 2), min(len(lines), k + 3)) if out.get(j) == "page_number"]
        return bool(near) or bool(lines[k - 1].strip()) or (k + 1 < len(lines) and lines[k + 1].strip()[:1].islower())

    running: list[str] = []
    for key, where in at.items():
        if len(where) < 2 or any(b - a < 4 for a, b in zip(where, where[1:], strict=False)):
            continue
        s = lines[where[0]].strip()
        words = key.split("#")[0].split()
        if HEADING.match(s) or (len(words) < 3 and not re.search(r"\d", s)):
            continue
        if sum(map(interrupts, where)) * 2 >= len([k for k in where if k]):
            running.append(key)
            out.update(dict.fromkeys(where, "running_line"))
    if running:
        for key, where in at.items():
            if key in running or len(where) > 2:
                continue
            for r in running:
                if abs(len(r) - len(key)) <= 0.25 * len(r) + 3:
                    m = SequenceMatcher(None, key, r, autojunk=False)
                    if m.quick_ratio() > 0.72 and m.ratio() > 0.72:
                        out.update(dict.fromkeys((k for k in where if not HEADING.match(lines[k].strip())), "running_line"))
                        break
    return out


# -- words ------------------------------------------------------------------
class Reader:
    """Judges words by a bounded vocabulary {word: count}; compounds are in it with their hyphen,
    words with an accent beside its letter as they stand.

    Counts are compared with each other, so that a verdict stays when all of them grow alike.
    """

    def __init__(self, known: dict[str, int]):
        self.known = known
        total = sum(known.values())
        self.least, self.rare = max(LEAST, SHARE * total), max(1.0, RARE * total)
        #: the greatest count of a word of so many letters or more
        self.top = [0] * 50
        for w, n in known.items():
            self.top[min(len(w), 49)] = max(self.top[min(len(w), 49)], n)
        for k in range(48, -1, -1):
            self.top[k] = max(self.top[k], self.top[k + 1])
        self.seen: dict[str, tuple[tuple[str, ...], tuple[float, ...], str] | None] = {}
        self.chunks: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], tuple[str, float] | None] = {}
        #: chunks, and neighbours, in which there is nothing to note
        self.clean: set[str] = set()
        self.fine: set[tuple[str, str]] = set()

    def n(self, w: str) -> int:
        return self.known.get(w, 0)

    def _links(self, forms, own: int, how: str, ratio: int = RATIO, soft: float = SOFT) -> tuple[tuple[str, ...], tuple[float, ...], str] | None:
        """(frequent words, logarithm of each count to the one that would do alone, how) of the forms that may be meant."""
        need = max(LEAST, ratio * own)
        if own > self.rare:
            soft = 1.0
        good = sorted(((self.known[f], f) for f in forms if self.known.get(f, 0) * soft >= need), reverse=True)[:8]
        return (tuple(f for _, f in good), tuple(math.log(n / need) for n, _ in good), how) if good else None

    @staticmethod
    def _edits(w: str, rules: dict[str, list[tuple[str, str]]]) -> set[str]:
        """``w`` with one of the glyphs read otherwise."""
        return {w[:k] + b + w[k + len(a) :] for k, c in enumerate(w) if c in rules for a, b in rules[c] if len(a) == 1 or w.startswith(a, k)}

    def links(self, raw: str) -> tuple[tuple[str, ...], tuple[float, ...], str] | None:
        """Frequent words that ``raw`` may be a misreading of, with their margins, and how: 'odd' or 'plain' letters."""
        if raw in self.seen:
            return self.seen[raw]
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[raw] = got = self._judge(raw)
        return got

    def misread(self, raw: str) -> tuple[str, str] | None:
        """(the most frequent word, how) where the counts would do alone."""
        got = self.links(raw)
        return (got[0][0], got[2]) if got and got[1][0] >= 0 else None

    def _judge(self, raw: str) -> tuple[tuple[str, ...], tuple[float, ...], str] | None:
        w = raw.lower()
        if any(c in LIGATURES for c in w):
            return (unicodedata.normalize("NFKC", w),), (5.0,), "odd"
        if not 3 <= len(w) <= LONGEST + 4 or CODE.fullmatch(raw):  # an edit takes two letters at most, so no frequent word is near a longer one
            return None
        own = self.n(w)
        if raw[-1:] == "I" and raw[:-1].isalpha() and any(c.islower() for c in raw) or re.search(r"[a-zé]I[a-zé]", raw):
            if got := self._links({raw.replace("I", "l").lower()}, own, "odd", soft=1):
                return got
        if not w.isalpha():
            forms = self._edits(w, ODD_AT)
            if got := self._links([x for x in forms if x.isalpha()], 0, "odd", soft=1):
                return got
            two = {y for x in forms for y in self._edits(x, ODD_AT)} | {y for x in forms if x.isalpha() for y in self._edits(x, PLAIN_AT)}
            return self._links([x for x in two if x.isalpha()], 0, "odd", soft=1)
        if raw.isupper() and len(raw) < 5:
            return None
        if RATIO * own > SOFT * self.top[min(max(len(w) - 2, 0), 49)]:  # an edit takes two letters at most
            return None
        forms = self._edits(w, PLAIN_AT)
        one = self._links(forms, own, "plain")
        if one and one[1][0] >= 0:
            return one
        if len(w) >= 7 and RATIO * RATIO * own <= self.top[min(len(w) - 4, 49)]:  # two slips in a word are rarer than one
            if got := self._links({y for x in forms for y in self._edits(x, PLAIN_AT)}, own, "plain", RATIO * RATIO, 1):
                return got
        return one

    def parts(self, chunk: str) -> list[str]:
        core = chunk.strip(EDGE)
        if core.endswith(("'", "’", "`", "´")) and len(core) > 4:
            return [*(p for p in re.split(r"(?<=^[^\W_])['’]|(?<=^qu)['’]", core[:-1]) if p and p != core[:-1]), re.split(r"['’]", core[:-1])[-1] + "'"]
        return [p for p in re.split(r"['’/-]", core) if p]

    def cut_word(self, line: str, after: str) -> str | None:
        """The joined word if ``line`` ends in a word that is divided by a mark of its own, going on in ``after``."""
        m = cut_end(line)
        if not m:
            return None
        rest = re.match(r"[\"«(]?([^\W_][\w'’@†¢]*)", after.strip())
        if not rest:
            return None
        head, tail = re.split(r"['’-]", m[1])[-1].lower(), re.split(r"['’]", rest[1])[0].lower()
        if not head or not tail or head.isdigit() or tail[0].isdigit():
            return None
        joined, dashed = head + tail, f"{head}-{tail}"
        whole = m[1].split("'")[-1].lower() + "-" + tail
        if m[2] in "¬­":
            return joined
        if self.n(joined) >= max(1, self.n(dashed), self.n(whole) if "-" in m[1] else 0):
            return joined
        if max(self.n(dashed), self.n(whole)) >= 2:
            return None
        if self.misread(joined):
            return joined
        if rest[1][:1].isupper() and m[1][:1].isupper():
            return None if min(self.n(head), self.n(tail)) >= self.least / 2 else joined
        return None if min(self.n(head), self.n(tail)) >= self.least else joined

    def _chunk(self, c: str) -> tuple[str, str, str, tuple]:
        """(core, first part if it could end a broken word, last part if it could begin one, misread parts)."""
        core = c.strip(EDGE)
        pieces = re.split(r"['’-]", core)
        first = pieces[0].lower() if c[:1].isalnum() and pieces[0].isalnum() else ""
        last = pieces[-1].lower() if c[-1:].isalnum() and pieces[-1].isalnum() else ""
        hits = []
        accent = self._accent(core)
        if accent:
            hits.append((core, (accent,), (2.0,), "odd"))
        else:
            hits = [(p, *got) for p in self.parts(c) if (got := self.links(p))]
        if len(self.chunks) > 500_000:
            self.chunks.clear()
            self.clean.clear()
        if not hits:
            self.clean.add(c)
        self.chunks[c] = got = (core, first, last, tuple(hits))
        return got

    def _accent(self, core: str) -> str | None:
        """The word meant if an accent stands beside its letter: the joined form must be more frequent than what was read."""
        got = detached(core.lower())
        if not got:
            return None
        before, read = got
        form = read
        for a, b in ACCENTS:
            form = form.replace(a, b)
        own = max(1, self.n(read))
        meant = []
        for w in re.split(r"['’-]", form):
            if len(w) > 2 and self.n(w) < max(LEAST, 2 * own):
                fixed = self.misread(w)
                if not fixed or self.n(fixed[0]) < RATIO * own:
                    return None
                w = fixed[0]
            meant.append(w)
        return before + "-".join(meant) if max(map(len, meant)) > 2 else None

    def _broken(self, a: str, b: str) -> tuple[str, float] | None:
        """(the word that a blank parts into ``a`` and ``b``, margin)."""
        n, na, nb = self.n(a + b), self.n(a), self.n(b)
        low = min(na, nb)
        if a.isalpha() and b.isalpha():
            if n >= LEAST and (low == 0 or n >= RATIO * low):
                return a + b, 1.0 + math.log(n / max(LEAST, RATIO * low))  # two fragments that are no words
            least = RATIO * max(na, nb)
            if least <= self.top[max(min(len(a) + len(b), 53) - 4, 0)] and (got := self.misread(a + b)) and self.n(got[0]) >= max(least, 1):
                return got[0], 1.0 + math.log(self.n(got[0]) / max(least, LEAST))
        elif not a.isdigit() and not b.isdigit() and low == 0 and len(a) + len(b) >= 6 and not CODE.fullmatch(a + b) and (got := self.misread(a + b)):
            return got[0], 2.0
        return None

    def scan(self, line: str, after: str = "", before: str = "") -> list[tuple[str, tuple[str, ...], tuple[float, ...], str, int]]:
        """(read, words that may be meant, margins, kind, index of the chunk) of the places of a line that may be misread."""
        out: list[tuple[str, tuple[str, ...], tuple[float, ...], str, int]] = []
        chunks = line.split()
        # the inner ones of letters set apart are chunks of their own
        if 1 in map(len, chunks) and SPACED.search(line):
            for m in SPACED.finditer(line):
                joined = m[0].replace(" ", "").lower()
                if len(joined) >= 4 or self.n(joined) >= self.least:
                    out.append((m[0], (joined,), (2.0,), "odd", len(line[: m.start()].split())))
            chunks = SPACED.sub(lambda m: " " * len(m[0]), line).split()
        if self.clean.issuperset(chunks) and self.fine.issuperset(zip(chunks, chunks[1:], strict=False)):
            return out
        known = self.chunks
        seen = [known.get(c) or self._chunk(c) for c in chunks]
        skip_last, skip_first = bool(cut_end(line)), bool(cut_end(before))
        last = len(chunks) - 1
        for k, (core, _, a, hits) in enumerate(seen):
            b = seen[k + 1][1] if k < last else ""
            broken = self._pair(a, b) if a and b else None
            if not broken and k < last:
                self.fine.add((chunks[k], chunks[k + 1]))
            if (k == last and skip_last) or (k == 0 and skip_first):
                continue
            if broken:
                out.append((f"{core} {seen[k + 1][0]}", (broken[0],), (broken[1],), "odd", k))
                continue
            for p, meant, margin, how in hits:
                out.append((p, meant, margin, how, k))
        return out

    def _pair(self, a: str, b: str) -> tuple[str, float] | None:
        """What two neighbours are the halves of, if anything; each distinct pair is judged once (memory bound only)."""
        if (a, b) in self.pairs:
            return self.pairs[a, b]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
            self.fine.clear()
        self.pairs[a, b] = got = self._broken(a, b) if len(a) + len(b) >= 5 else None
        return got


def around(lines: list[str], k: int, chunk: int, reach: int = 8) -> list[str]:
    """Lower-cased words of three letters or more around a chunk of line ``k``, without the chunk itself."""
    before = [w for j in (k - 1,) if j >= 0 for c in lines[j].split() if (w := plain_word(c.lower()))]
    own = lines[k].split()
    left = [w for c in own[:chunk] if (w := plain_word(c.lower()))]
    right = [w for c in own[chunk + 1 :] if (w := plain_word(c.lower()))]
    after = [w for j in (k + 1,) if j < len(lines) for c in lines[j].split() if (w := plain_word(c.lower()))]
    return (before + left)[-reach:] + (right + after)[:reach]


def plain_word(chunk: str) -> str:
    """The last word of a chunk, if it has three letters or more."""
    w = re.split(r"['’-]", chunk.strip(EDGE))[-1]
    return w if len(w) > 2 and w.isalpha() else ""


Note = tuple[int, str, str, tuple[str, ...], tuple[float, ...], str, list[str]]


def notes_of(content: str | None, reader: Reader) -> list[Note]:
    """(line, noise, read, words that may be meant, margins, how, words around) of a document's content."""
    if not content:
        return []
    lines = content.split("\n")
    dressed = furniture(lines) if len(lines) > 1 else {}
    body = [k for k, x in enumerate(lines) if k not in dressed and x and not x.isspace()]
    cuts: dict[int, str] = {}
    for k, j in zip(body, body[1:], strict=False):
        if w := reader.cut_word(lines[k], lines[j]):
            cuts[k] = w
    out: list[Note] = [(k, kind, "", (), (), "", []) for k, kind in dressed.items()]
    out += [(k, "cut_word", "", (w,), (), "", []) for k, w in cuts.items()]
    for x, k in enumerate(body):
        before = lines[body[x - 1]] if x else ""
        for read, meant, margin, how, chunk in reader.scan(lines[k], before=before):
            out.append((k, "misread", read, meant, margin, how, around(lines, k, chunk)))
        if k in cuts and (got := reader.links(cuts[k])) and got[1][0] >= 0:
            m = cut_end(lines[k])
            head_bad = not m[1].split("'")[-1].isalpha() or not got[0][0].startswith(re.split(r"['’-]", m[1])[-1].lower())
            at, chunk = (k, len(lines[k].split()) - 1) if head_bad else (body[x + 1], 0)
            out.append((at, "misread", cuts[k], *got, around(lines, at, chunk)))
    return out


def message_notes(messages: list[str | None] | None, reader: Reader) -> list[Note]:
    out: list[Note] = []
    for k, text in enumerate(messages or []):
        for m in QUOTES.finditer(text or ""):
            quoted = next(g for g in m.groups() if g is not None).split("\n")
            for j, line in enumerate(quoted):
                if j + 1 < len(quoted) and (w := reader.cut_word(line, quoted[j + 1])):
                    out.append((k, "cut_word", "", (w,), (), "", []))
                for read, meant, margin, how, chunk in reader.scan(line, before=quoted[j - 1] if j else ""):
                    out.append((k, "misread", read, meant, margin, how, around(quoted, j, chunk)))
    return out


# -- Spark --------------------------------------------------------------------
def whole_words(text: str) -> list[str]:
    """The chunks between blanks, without the two halves of a word that is divided at a line end."""
    if "\n" not in text:
        return text.split()
    out: list[str] = []
    halved = False
    for line in text.split("\n"):
        chunks = line.split()
        if chunks:
            cut_here = chunks[-1][-1] in MARKS
            out += chunks[halved : len(chunks) - cut_here]
            halved = cut_here
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(w, n) over all rows: lower-cased words and hyphenated compounds; words with an accent beside its letter whole, not their fragments."""

    def run(batches):
        for b in batches:
            # words are found once in each distinct chunk between blanks
            chunks: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    chunks.update(whole_words(t.lower()))
            n: Counter[str] = Counter()
            for c, k in chunks.items():
                if c.isalpha():
                    n[c] += k
                    continue
                if got := detached(c.strip(EDGE)):
                    n[got[1]] += k
                    continue
                for w in LETTERS.findall(c):
                    n[w] += k
                if "-" in c:
                    for w in COMPOUND.findall(c):
                        n[w] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    return df.select(text).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str, share: float = SHARE) -> dict[str, int]:
    """Words that make up ``share`` of all word places or more, and occur twice: 1 / share words at most, whatever the size."""
    counted = cut(word_counts(df, text).where((F.length("w") > 1) & (F.length("w") <= LONGEST)))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    return {r.w: r.n for r in counted.where(F.col("n") >= max(2, share * total)).collect()}


#: Products with the matrix of pairs from which the vectors come, at any size.
ROUNDS = 5
#: Words that are paired at once, and cells of the matrix in a row (memory bounds only).
WORDS_AT_ONCE, CELLS = 500_000, 500_000
LONG_WORDS = re.compile(r"[^\W\d_]{4,}").findall


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sum of ``n`` of each."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[start], np.add.reduceat(n, start) if len(start) else n


def pairs_within(ids: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(i << 32 | j, how often), both ways, of words at most ``window`` places apart in a document."""
    codes = []
    for d in range(1, window + 1):
        a, b = ids[:-d], ids[d:]
        same = doc[:-d] == doc[d:]
        a, b = a[same], b[same]
        codes.append(np.minimum(a, b) << 32 | np.maximum(a, b))
    code = np.sort(np.concatenate(codes))
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    n, code = np.diff(np.append(start, len(code))), code[start]
    return np.concatenate([code, (code & 0xFFFFFFFF) << 32 | code >> 32]), np.concatenate([n, n])


def word_pairs(docs: DataFrame, content: str, words: list[str], window: int) -> DataFrame:
    """(i, j, n), a row of many cells each: how often word j lies within the window of word i; all cells of a word i come from one task."""
    shared = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})  # no more than the frequent words

    def count(batches):
        at = shared.value
        for b in batches:
            flat: list[int] = []
            ends: list[int] = []
            texts = b.column(0).to_pylist()
            for k, t in enumerate(texts):
                if t:
                    flat += [x for w in LONG_WORDS(t.lower()) if (x := at.get(w)) is not None]
                ends.append(len(flat))
                if flat and (len(flat) > WORDS_AT_ONCE or k + 1 == len(texts)):
                    code, n = pairs_within(np.array(flat, np.int64), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), window)
                    yield pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["i", "j", "n"])
                    flat, ends = [], []

    def pack(batches):
        code, n, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for b in batches:
            i, j, k = (b.column(c).to_numpy() for c in range(3))
            new.append((i.astype(np.int64) << 32 | j, k))
            if sum(len(c) for c, _ in new) > max(len(code), CELLS):
                code, n = summed(np.concatenate([code, *(c for c, _ in new)]), np.concatenate([n, *(k for _, k in new)]))
                new = []
        code, n = summed(np.concatenate([code, *(c for c, _ in new)]), np.concatenate([n, *(k for _, k in new)]))
        for low in range(0, len(code), CELLS):
            c = code[low : low + CELLS]
            cells = (c >> 32).astype(np.int32), (c & 0xFFFFFFFF).astype(np.int32), n[low : low + CELLS]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], names=["i", "j", "n"])

    counted = docs.select(content).mapInArrow(count, "i int, j int, n bigint")
    return cut(counted.repartition("i").mapInArrow(pack, "i binary, j binary, n binary"))


def product(cells: DataFrame, v: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """The matrix times ``v``: of how often the words were paired, or of their positive pointwise mutual information if ``seen`` has the sums of that."""
    shared = cells.sparkSession.sparkContext.broadcast((v.astype(np.float32), seen))

    def run(batches):
        v, seen = shared.value
        for b in batches:
            for i, j, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                i, j, x = np.frombuffer(i, np.int32), np.frombuffer(j, np.int32), np.frombuffer(n, np.int64).astype(float)
                if seen is not None:
                    x = np.maximum(np.log(x / seen[i] / seen[j] * seen.sum()), 0.0)
                start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                got = np.stack([np.add.reduceat(x * v[j, k], start) for k in range(v.shape[1])], 1)
                yield pa.RecordBatch.from_arrays([pa.array([i[start].tobytes()], pa.binary()), pa.array([got.tobytes()], pa.binary())], names=["i", "v"])

    out = np.zeros(v.shape)
    for r in cells.mapInArrow(run, "i binary, v binary").collect():  # no more rows of the product than the frequent words, and one for each row of cells
        np.add.at(out, np.frombuffer(r.i, np.int32), np.frombuffer(r.v, float).reshape(-1, v.shape[1]))
    shared.destroy()
    return out


def skip_gram(docs: DataFrame, content: str, known: dict[str, int], size: int = 16, window: int = 3, seed: int = 3) -> tuple[list[str], np.ndarray]:
    """(words, vectors) by skip-gram over all documents; the words lie within the bounded frequent words.

    Words of four letters or more take part: shorter ones are function words, which say little about a place.
    """
    words = sorted(w for w in known if len(w) > 3 and w.isalpha())
    if not words:
        return [], np.zeros((0, size), np.float32)
    cells = word_pairs(docs, content, words, window)
    seen = product(cells, np.ones((len(words), 1)))[:, 0]
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(words), size)))[0]
    for _ in range(ROUNDS):
        y = product(cells, q, seen)
        inner = q.T @ y
        last, q = q, np.linalg.qr(y)[0]
    value, turn = np.linalg.eigh((inner + inner.T) / 2)
    v = np.zeros((len(words), size), np.float32)
    v[:, : len(value)] = last @ turn * np.sqrt(np.abs(value))
    held = np.flatnonzero(seen)  # a word without neighbours has no vector
    return [words[k] for k in held], v[held]


class Surroundings:
    """Ranks frequent words by how near they lie to a vector, among a fixed sample of the frequent words."""

    SAMPLE = 400

    def __init__(self, words: list[str], vectors: np.ndarray, known: dict[str, int]):
        self.at = {w: k for k, w in enumerate(words)}
        v = vectors - vectors.mean(0) if words else vectors
        self.v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        usual = sorted(range(len(words)), key=lambda k: -known.get(words[k], 0))[: max(len(words) // 2, 1)]
        self.sample = self.v[usual[:: max(len(usual) // self.SAMPLE, 1)]]

    def mean(self, words: list[str], read: str) -> list[float] | None:
        k = [self.at[w] for w in words if w in self.at and w != read]
        return self.v[k].mean(0).tolist() if len(k) > 1 else None

    def ranks(self, places: np.ndarray, words: list[str]) -> np.ndarray:
        """Of each place and word: the share of the sample that lies farther from the place than the word does; one half where either has no vector (NaN)."""
        k = np.array([self.at.get(plain_word(w), -1) for w in words])
        out = np.full(len(words), 0.5)
        for low in range(0, len(words), 4096):
            at = low + np.flatnonzero((k[low : low + 4096] >= 0) & ~np.isnan(places[low : low + 4096, 0]))
            if len(at):
                p = places[at]
                out[at] = (p @ self.sample.T < (p * self.v[k[at]]).sum(1)[:, None]).mean(1)
        return out


NOTE = "doc_id bigint, field string, pos int, noise string, read string, meant array<string>, margin array<double>, how string, place array<float>"


def noise_notes(docs: DataFrame, known: dict[str, int], around_: Surroundings, content: str = "content", messages: str = "parsing_errors") -> DataFrame:
    """Every place that may be noisy, with the words that may be meant and the mean vector of the words around."""
    shared = docs.sparkSession.sparkContext.broadcast((known, around_))  # 1 / SHARE words and vectors at most

    def run(batches):
        known, near = shared.value
        reader = Reader(known)
        for b in batches:
            rows = []
            for i, t, m in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                for field, got in (("content", notes_of(t, reader)), ("parsing_errors", message_notes(m, reader))):
                    rows += [(i, field, pos, noise, read, meant, margin, how, near.mean(words, read.lower())) for pos, noise, read, meant, margin, how, words in got]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "field", "pos", "noise", "read", "meant", "margin", "how", "place"])

    return docs.select("doc_id", content, messages).mapInArrow(run, NOTE)


FOUND = "doc_id bigint, field string, pos int, noise string, read string, meant string, how string"


def decided(notes: DataFrame, known: dict[str, int], around_: Surroundings, fit: float = FIT) -> DataFrame:
    """(doc_id, field, pos, noise, read, meant, how): of each misread place the word that counts and surroundings speak for together."""
    size = around_.v.shape[1]
    misread = notes.where("noise = 'misread'")
    form = F.lower("read")
    # the vector of a rare word: the mean over all its places
    rare = misread.where("place IS NOT NULL").groupBy(form.alias("form")).agg(F.array(*[F.avg(F.get("place", F.lit(k))).cast("float") for k in range(size)]).alias("mean"))
    j = misread.join(rare, form == rare["form"], "left").select("doc_id", "field", "pos", "noise", "read", "meant", "margin", "how", "place", "mean")
    shared = notes.sparkSession.sparkContext.broadcast(around_)

    def run(batches):
        near = shared.value
        for b in batches:
            meant, margin, _, place, mean = (b.column(k).to_pylist() for k in range(5, 10))
            n = [len(x) for x in meant]
            words = [w for x in meant for w in x]
            none = [np.nan] * size
            near_ = [near.ranks(np.repeat(np.array([x or none for x in v], np.float32).reshape(-1, size), n, axis=0), words) for v in (place, mean)]
            score = np.array([m for x in margin for m in x]) + fit * ((near_[0] + near_[1]) / 2 - 0.5)
            at, word, low = [], [], 0
            for r, k in enumerate(n):
                best = max(range(low, low + k), key=lambda j: (score[j], words[j]))
                if score[best] >= 0:
                    at.append(r)
                    word.append(words[best])
                low += k
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(5)), pa.array(word, pa.string()), b.column(7).take(take)], names=["doc_id", "field", "pos", "noise", "read", "meant", "how"])

    rest = notes.where("noise <> 'misread'").select("doc_id", "field", "pos", "noise", "read", F.get("meant", F.lit(0)).alias("meant"), "how")
    return j.mapInArrow(run, FOUND).unionByName(rest)


def find_noise(docs: DataFrame, content: str = "content", share: float = SHARE, fit: float = FIT) -> DataFrame:
    """(doc_id, field, pos, noise, read, meant, how) of every noisy place."""
    known = frequent_words(docs, content, share)
    near = Surroundings(*skip_gram(docs, content, known), known)
    return decided(cut(noise_notes(docs, known, near, content)), known, near, fit)


def repair(docs: DataFrame, content: str = "content", messages: str = "parsing_errors", **options) -> DataFrame:
    """(doc_id, text, messages): continuous readable paragraphs of every document and its messages with their quotations repaired, one row per doc_id."""
    # one delivery of each document gives both the notes and the text
    one = cut(docs.select("doc_id", content, messages).dropDuplicates(["doc_id"]))
    noise = find_noise(one, content, **options)
    # bounded by the lines of one document
    by = noise.groupBy("doc_id").agg(F.collect_list(F.struct("field", "pos", "noise", "read", "meant")).alias("notes"))
    j = one.join(by, "doc_id", "left").select("doc_id", content, messages, "notes")

    def run(batches):
        for b in batches:
            out, said = [], []
            for t, m, notes in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
                out.append(rebuild(t, [x for x in notes or [] if x["field"] == "content"]))
                said.append(m and reworded(m, [x for x in notes or [] if x["field"] == messages]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "text", "messages"])

    return j.mapInArrow(run, "doc_id bigint, text string, messages array<string>")


def corrected(line: str, read: str, meant: str) -> str:
    """``line`` with the places of ``read`` that stand alone read as ``meant``."""
    word = meant.upper() if read.isupper() else meant.capitalize() if read[:1].isupper() else meant
    return re.sub(rf"(?<![^\W_]){re.escape(read)}(?![^\W_])", lambda _: word, line)


def reworded(messages: list[str | None], notes: list[dict]) -> list[str | None]:
    out = list(messages)
    for x in notes:
        if out[x["pos"]] is None:
            continue
        if x["noise"] == "misread":
            out[x["pos"]] = corrected(out[x["pos"]], x["read"], x["meant"])
    for k in {x["pos"] for x in notes if x["noise"] == "cut_word" and out[x["pos"]] is not None}:
        out[k] = re.sub(r"(?<=[^\W\d_])\s?[-‐‑¬\xad]\s*\n\s*(?=[^\W\d_])", "", out[k])
    return out


def rebuild(text: str | None, notes: list[dict] | None) -> str | None:
    if not text or not notes:
        return text
    lines = text.split("\n")
    gone = {x["pos"] for x in notes if x["noise"] in ("running_line", "page_number")}
    cuts = {x["pos"] for x in notes if x["noise"] == "cut_word"}
    for x in notes:
        if x["noise"] == "misread" and x["pos"] not in gone:
            lines[x["pos"]] = corrected(lines[x["pos"]], x["read"], x["meant"])
    paragraphs: list[str] = []
    open_ = joined = False
    after_gone = False
    for k, line in enumerate(lines):
        if k in gone:
            after_gone = True
            continue
        s = line.strip()
        if not s:
            if not (after_gone and open_ and paragraphs and paragraphs[-1][-1:].isalnum()):
                open_ = False
            continue
        after_gone = False
        if not open_:
            paragraphs.append(s)
        else:
            paragraphs[-1] += s if joined else " " + s
        joined = k in cuts
        if joined:
            paragraphs[-1] = re.sub(r"\s?[-‐‑¬­]\s*$", "", paragraphs[-1])
        short = len(s) < 45 and not joined and s[-1] not in ".,;:" and k + 1 < len(lines) and lines[k + 1][:1].isupper()
        open_ = not short
    return "\n\n".join(paragraphs)
