"""Linking the spellings of one person or organisation.

1. Names are folded (case, accents) and cut into words; titles, legal forms, remarks
   and placeholders go.
2. MinHash banding over the padded q-grams of the words that identify an entity. The
   number of bands comes from the collision curve (:func:`bands_for`), for the
   similarity that one slip of the pen leaves in a short word. Where a word is borne by
   more than COMMON spellings (given names, kinds of services), a second key from another
   word of the name is asked for, so that the number of pairs stays low; nothing that the
   verification accepts is lost by it. Names of short words only are banded as wholes.
3. Candidates are verified by Monge-Elkan: every word of the shorter name must have its
   own partner in the longer (equal, a slip, an initial, a shortened or pet form, or an
   acronym of several words), and the mean similarity must reach ``threshold``.
4. Star clustering by rounds: an unassigned name that outranks all its unassigned
   neighbours becomes the centre of a star, its neighbours its satellites. A short form
   (no given name, or only its initial) that fits several centres stays alone.

Defined results: null, blank and placeholder names are linked to nothing; identical
strings are one name; very long names are compared whole; an empty table has no links.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerfline.session import cut

Q = 2
ROWS = 3
#: Similarity of the q-gram sets of a short word and the word with one slip, and the recall aimed at there.
SLIP_SIMILARITY, RECALL = 0.36, 0.99
#: Names that share a word in more spellings than this must also share a second key.
COMMON = 200
#: Parts into which the names of a second key are dealt.
SALT = 8
THRESHOLD = 0.84

# Words without a name in them.
PLACEHOLDERS = frozenset("na,n a,nc,tbd,tba,xxx,xx,x,inconnu,inconnue,unknown,none,null,nil,neant,aucun,aucune,a completer,a definir,a preciser,a renseigner,non renseigne,non defini,sans objet,anonyme,personne,todo,to be defined,vide,ras,nobody,anonymous,unbekannt,desconocido".split(","))
TITLES = frozenset("m mr mme mlle mm dr me pr prof monsieur madame mademoiselle docteur maitre professeur mrs ms miss herr frau sr sra".split())
FORMS = frozenset("societe ste sa sas sasu sarl eurl sci snc gmbh ag ltd inc llc cie sl".split())
SMALL = frozenset("de des du d la le les l et a au aux the of and und der die das y".split())
ROLES = frozenset("dpo rssi dsi daf drh ciso cio dg ext externe interim audit resp responsable site suppleant adjoint prestataire consultant chef projet directeur directrice it secretariat remplacant".split())
#: Pet forms that share no beginning with the given name.
PET_FORMS = {"babeth": "elisabeth", "lisa": "elisabeth", "betty": "elisabeth", "manu": "emmanuel emmanuelle", "nico": "nicolas", "tina": "christine martine", "titi": "thierry", "seb": "sebastien", "toinette": "antoinette", "toni": "antoine", "jo": "josephine georges", "josy": "josephine", "fifi": "philippine philippe", "domi": "dominique", "mado": "madeleine", "guillou": "guillaume", "jb": "jean", "gaby": "gabrielle gabriel", "steph": "stephanie stephane", "nath": "nathalie", "cathy": "catherine", "kathy": "catherine", "vero": "veronique", "isa": "isabelle", "ludo": "ludovic", "greg": "gregory", "alex": "alexandre", "max": "maximilien maxime", "ben": "benjamin", "sam": "samuel", "flo": "florian florence", "vic": "victoire victor", "theo": "theodore", "leo": "leopold", "caro": "caroline", "chris": "christophe christine", "doudou": "edouard", "doud": "edouard", "ed": "edouard", "thib": "thibault", "gus": "augustin", "tintin": "augustin valentin", "coco": "corentin", "soso": "solange", "lolo": "laurent", "juju": "julien", "pat": "patricia patrick", "fred": "frederic", "olive": "olivier", "nanou": "anne", "nat": "nathalie", "val": "valerie valentin", "philou": "philippe", "mimi": "michel", "jojo": "josephine", "gab": "gabrielle"}


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace("’", "'").replace("œ", "oe").replace("Œ", "oe"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def words_of(name: str | None) -> list[str]:
    """The words that count; shortened ones keep a final dot. Empty for placeholders."""
    if not name:
        return []
    s = name.strip()
    plain = " ".join(re.findall(r"[a-z0-9]+", fold(s)))
    if plain in PLACEHOLDERS or not re.search(r"[a-z]{2}", plain):
        return []

    def remark(m: re.Match) -> str:
        inner = re.findall(r"[a-z]+", fold(m[1]))
        return " " if not inner or all(w in ROLES for w in inner) else f" {m[1]} "

    s = re.sub(r"\(([^)]*)\)", remark, s)
    parts = re.split(r"\s+[-–—/|:]\s+|\s*[/|]\s*", s)
    if len(parts) > 1:
        parts = [parts[0], *(p for p in parts[1:] if not p[:1].islower() or not all(w in ROLES for w in re.findall(r"[a-z]+", fold(p))))]
    s = " ".join(parts)
    if " " not in s.strip() and re.fullmatch(r"[a-z0-9'-]+(?:[._][a-z0-9'-]+)+(?:@.*)?", fold(s.strip())):
        s = re.sub(r"[._]", " ", s.split("@")[0])  # a login
    got = re.findall(r"[a-z0-9]+\.?", fold(s))
    if got:
        got[-1] = got[-1].rstrip(".") if len(got[-1]) > 5 and got[-1].rstrip(".") in FORMS else got[-1]
    while len(got) > 1 and got[0].rstrip(".") in TITLES and (got[0].rstrip(".") != "m" or got[0] != "m"):
        got = got[1:]
    kept = [w for w in got if w.rstrip(".") not in FORMS]
    return kept if [w for w in kept if w.rstrip(".") not in SMALL] else []


def strong(words: list[str]) -> list[str]:
    return [w.rstrip(".") for w in words if w.rstrip(".") not in SMALL and len(w.rstrip(".")) > 3]


def slips(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before2, before, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return row[-1]


def same_word(a: str, b: str) -> tuple[float, str]:
    """(similarity, kind) of a word of the shorter and one of the longer name; kind: e qual, s lip, i nitial, a bbreviated, '' none."""
    dot, a, b = a.endswith("."), a.rstrip("."), b.rstrip(".")
    if a == b:
        return 1.0, "e"
    if len(a) == 1 or len(b) == 1:
        return (0.9, "i") if a[0] == b[0] else (0.0, "")
    if len(a) >= 2 and len(a) < len(b) and b.startswith(a) and (dot or len(a) >= 3):
        return 0.92, "a"
    if len(b) >= 3 and len(b) < len(a) and a.startswith(b):
        return 0.92, "a"
    if b in PET_FORMS.get(a, "").split() or a in PET_FORMS.get(b, "").split():
        return 0.9, "a"
    if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4:
        n = slips(a, b)
        if n == 1 or (n == 2 and min(len(a), len(b)) >= 9):
            return 1 - 0.1 * n, "s"
    return 0.0, ""


def _acronym(short: str, words: list[str], at: list[int]) -> list[int] | None:
    """Places of ``words`` that ``short`` stands for: the first letters, small words being free to leave out."""
    got, k = [], 0
    for j in at:
        w = words[j].rstrip(".")
        if k < len(short) and w[0] == short[k]:
            got.append(j)
            k += 1
        elif w not in SMALL:
            return None
    return got if k == len(short) and len(got) > 1 else None


def compare(x: list[str], y: list[str]) -> tuple[float, bool]:
    """(Monge-Elkan similarity, whether the shorter is a short form); 0 if they can't be one entity."""
    big = [[w for w in v if w.rstrip(".") not in SMALL] for v in (x, y)]
    if len(big[0]) > len(big[1]) or (len(big[0]) == len(big[1]) and sum(map(len, big[0])) > sum(map(len, big[1]))):
        x, y, big = y, x, big[::-1]
    a, b = big
    if not a or not b:
        return 0.0, False
    scores = sorted(((*same_word(u, v), -abs(i - j), i, j) for i, u in enumerate(a) for j, v in enumerate(b)), reverse=True)
    mine: dict[int, tuple[float, str]] = {}
    used: set[int] = set()
    for s, kind, _, i, j in scores:
        if s > 0 and i not in mine and j not in used:
            mine[i] = (s, kind)
            used.add(j)
    if "".join(a) == "".join(b) or "".join(w.rstrip(".") for w in sorted(a)) == "".join(w.rstrip(".") for w in sorted(b)):
        return 1.0, False
    certain = [i for i, (s, k) in mine.items() if k in "es" and len(a[i].rstrip(".")) > 3]
    if not certain or sum(k == "s" for _, k in mine.values()) > 1:
        return 0.0, False
    for i, w in enumerate(a):  # an acronym stands for all words that have no partner
        if i not in mine or (mine[i][1] in "ia" and len(w.rstrip(".")) > 1 and len(b) > len(a)):
            taken = used - ({j for s, k, _, p, j in scores if p == i and (s, k) == mine.get(i)} if i in mine else set())
            names = {b[j] for j in taken}
            free = [j for j, v in enumerate(y) if v not in names]
            while free and y[free[0]].rstrip(".") in SMALL:
                free = free[1:]
            while free and y[free[-1]].rstrip(".") in SMALL:
                free = free[:-1]
            if 2 <= len(w.rstrip(".")) <= 6 and _acronym(w.rstrip("."), y, free):
                mine[i] = (0.9, "c")
                used |= {j for j, v in enumerate(b) if v not in names}
    if len(mine) < len(a):
        return 0.0, False
    extra = len(b) - len(used)
    kinds = [k for _, k in mine.values()]
    partial = False
    if extra:
        if len(a) == 1:
            partial = True
        elif any(k == "i" or a[i].endswith(".") for i, (_, k) in mine.items()) and extra == 1 and len(b) == 3:
            partial = "i" in kinds  # the first part of a double given name
        else:
            return 0.0, False
    if "i" in kinds:
        partial = True
    return sum(s for s, _ in mine.values()) / len(a), partial


# -- banding ---------------------------------------------------------------
def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands at which the collision curve 1 - (1 - s ** rows) ** bands reaches ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + Q] for i in range(len(w) - Q + 1)}


def band_keys(sets: list[set[str]], bands: int, rows: int) -> np.ndarray:
    import xxhash

    rng = np.random.default_rng(99)
    mul, add = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    for k, s in enumerate(sets):
        h = np.array([xxhash.xxh64_intdigest(g) for g in s], np.uint64)
        v = h[:, None] * mul + add
        v = ((v ^ (v >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)).min(0).reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = (key ^ v[:, r]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        out[k] = key
    return out.view(np.int64)


def _banded(df: DataFrame, column: str, bands: int) -> DataFrame:
    def run(batches):
        for b in batches:
            text = b.column(0).to_pylist()
            keys = band_keys([grams(t) for t in text], bands, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(text)), bands)).cast(pa.int32()), pa.array(keys.ravel()), pa.array([t for t in text for _ in range(bands)])], names=["n", "key", column])

    return df.select(column).mapInArrow(run, f"n int, key bigint, `{column}` string").select("key", column)


def _similar(df: DataFrame, column: str, bands: int) -> DataFrame:
    """(x, y), x < y, of strings that collide in a band."""
    k = _banded(df, column, bands)
    return k.select("key", F.col(column).alias("x")).join(k.select("key", F.col(column).alias("y")), "key").where("x < y").select("x", "y").distinct()


def second_keys(words: list[str], w: str) -> set[tuple[str, bool]]:
    """(key, whether it asks) of the words beside ``w``: two names that can be one entity by ``w`` have a key in common that one of them asks for."""
    rest = [v.rstrip(".") for v in words if v.rstrip(".") not in SMALL]
    if w in rest:
        rest.remove(w)
    got = {("*", not rest)}  # a lone word is compared with all
    for v in rest:
        got.add((f"1{v[0]}", len(v) == 1))  # an initial
        got.add((f"a{v[0]}", False))
        if 2 <= len(v) <= 6:
            got.add((f"a{v[0]}", True))  # it may be an acronym of several words
        if len(v) > 1:
            got |= {(f"2{x[:2]}", True) for x in (v, *PET_FORMS.get(v, "").split())}  # equal, shortened, pet form
        if len(v) > 2:  # one slip leaves the beginning, the end or both outer letters
            got |= {(f"e{v[-2:]}", True), (f"f{v[0]}{v[-1]}", True)}
        if len(v) > 8:  # two slips break eight trigrams at most, a word of nine letters has nine
            got |= {(f"3{t}", True) for t in (f"^{v}$"[k : k + 3] for k in range(len(v)))}
    if len(rest) < 2:  # an acronym stands for two words or more
        got = {(k, asks) for k, asks in got if k[0] != "a" or asks}
    return got


def _keyed(words: DataFrame) -> DataFrame:
    """(name, w, key, asks) from (name, w, words)."""

    def run(batches):
        for b in batches:
            rows = [(n, w, k, asks) for n, w, v in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True) for k, asks in second_keys(v, w)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.bool_()], strict=True)], names=["name", "w", "key", "asks"])

    return words.select("name", "w", "words").mapInArrow(run, "name string, w string, key string, asks boolean")


def candidates(parsed: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of names that share an identifying word, or one with a slip; of common words, those that share a second key too."""
    bands = bands_for(SLIP_SIMILARITY, RECALL, ROWS)
    word = parsed.select("name", F.explode("strong").alias("w")).distinct()
    df = word.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    pairs = _similar(df.select("w"), "w", bands)
    near = F.levenshtein("x", "y") <= 2  # at most two edits; a swap of neighbours is two
    both = pairs.where(near)
    links = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(df.select(F.col("w").alias("x"), F.col("w").alias("y")))
    links = links.join(df.select(F.col("w").alias("x"), F.col("df").alias("dx")), "x").join(df.select(F.col("w").alias("y"), F.col("df").alias("dy")), "y")
    links = cut(links.select("x", "y", (F.greatest("dx", "dy") > COMMON).alias("common")))
    a, b = word.select(F.col("name").alias("a"), F.col("w").alias("x")), word.select(F.col("name").alias("b"), F.col("w").alias("y"))
    by_word = links.where("NOT common").join(a, "x").join(b, "y").where("a < b").select("a", "b")
    hot = links.where("common").select("x", "y")
    keyed = _keyed(word.join(hot.select(F.col("x").alias("w")).distinct(), "w").join(parsed.select("name", "words"), "name"))
    p = keyed.where("asks").select(F.col("name").alias("p"), F.col("w").alias("x"), "key", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    q = keyed.select(F.col("name").alias("q"), F.col("w").alias("y"), "key", F.pmod(F.xxhash64("name"), F.lit(SALT)).cast("int").alias("part"))
    by_key = hot.join(p, "x").join(q, ["y", "key", "part"]).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    rest = parsed.where(F.size("strong") == 0).select(F.col("name"), F.array_join("words", " ").alias("s"))
    whole = _similar(rest.select("s").distinct(), "s", bands)
    whole = whole.unionByName(rest.select(F.col("s").alias("x"), F.col("s").alias("y")).distinct())
    by_whole = whole.join(rest.select(F.col("name").alias("p"), F.col("s").alias("x")), "x").join(rest.select(F.col("name").alias("q"), F.col("s").alias("y")), "y")
    by_whole = by_whole.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return by_word.unionByName(by_key).unionByName(by_whole).distinct()


def parse(names: DataFrame) -> DataFrame:
    """(name, n, words, strong) from (name, n); placeholders are left out."""

    def run(batches):
        for b in batches:
            text = b.column(0).to_pylist()
            words = [words_of(t) for t in text]
            at = [k for k, w in enumerate(words) if w]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([words[k] for k in at], pa.list_(pa.string())), pa.array([strong(words[k]) for k in at], pa.list_(pa.string()))], names=["name", "n", "words", "strong"]
            )

    return names.select("name", "n").mapInArrow(run, "name string, n bigint, words array<string>, strong array<string>")


def verified(parsed: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score, partial) of candidate pairs that Monge-Elkan accepts."""
    p = parsed.select("name", "words")
    j = pairs.join(p.select(F.col("name").alias("a"), F.col("words").alias("x")), "a").join(p.select(F.col("name").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            got = [compare(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            at = [k for k, (s, _) in enumerate(got) if s >= threshold]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([got[k][0] for k in at], pa.float64()), pa.array([got[k][1] for k in at], pa.bool_())], names=["a", "b", "score", "partial"])

    return j.mapInArrow(run, "a string, b string, score double, partial boolean")


def star_clusters(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, centre) of every linked name. Rank: full names first, then linked names, then mentions, then the name.

    A name that is left over joins the star that all its neighbours are in. Every round takes at least the
    name of the highest rank out, so the rounds end when no linked name is left.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "partial").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "partial"))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    full = F.size(F.filter("strong", lambda w: F.length(w) > 0)) >= F.lit(2)
    dotted = F.exists("words", lambda w: (w.endswith(".") | (F.length(w) <= 2)) & ~w.isin(sorted(SMALL)))
    rank = parsed.join(degree, parsed["name"] == degree["u"]).select("name", F.struct((full & ~dotted).cast("int").alias("full"), F.col("d"), F.col("n"), F.col("name").alias("by")).alias("rank"))
    both = cut(both.join(rank.select(F.col("name").alias("u"), F.col("rank").alias("ru")), "u").join(rank.select(F.col("name").alias("v"), F.col("rank").alias("rv")), "v"))
    done, live = None, both
    while not live.isEmpty():
        best = live.groupBy("u").agg(F.max("rv").alias("top"), F.first("ru").alias("ru"))
        centre = best.where("ru > top").select(F.col("u").alias("c"))
        reach = live.join(centre, live["v"] == centre["c"]).groupBy("u").agg(F.max(F.struct("rv", "v", "partial")).alias("m"), F.count_distinct("v").alias("k"))
        satellite = reach.select(F.col("u").alias("name"), F.when((F.col("k") > 1) & F.col("m.partial"), F.col("u")).otherwise(F.col("m.v")).alias("centre"))
        now = cut(satellite.unionByName(centre.select(F.col("c").alias("name"), F.col("c").alias("centre"))))
        done = now if done is None else done.unionByName(now)
        gone = now.select("name")
        live = cut(live.join(gone.withColumnRenamed("name", "u"), "u", "left_anti").join(gone.withColumnRenamed("name", "v"), "v", "left_anti"))
    if done is None:
        return both.select(F.col("u").alias("name"), F.col("v").alias("centre")).limit(0)
    lost = both.join(done.select(F.col("name").alias("u")), "u", "left_anti").join(done.select(F.col("name").alias("v"), "centre"), "v")
    late = lost.groupBy("u").agg(F.min("centre").alias("centre"), F.max("centre").alias("other")).where("centre = other")
    return done.unionByName(late.select(F.col("u").alias("name"), "centre"))


def link_names(df: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(name, centre): clusters of the spellings found in ``columns``; the centre is one of them."""
    names = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parsed = cut(parse(names))
    return star_clusters(parsed, cut(verified(parsed, candidates(parsed), threshold)))


def linked_pairs(clusters: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in code-point order, within a cluster."""
    a, b = clusters.select("centre", F.col("name").alias("name_a")), clusters.select("centre", F.col("name").alias("name_b"))
    return a.join(b, "centre").where("name_a < name_b").select("name_a", "name_b")
