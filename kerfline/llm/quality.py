"""Per-document text quality statistics, and the kind of a text by an ordered rule list.

Statistics are measured on whole texts in Arrow batches (the native form, regular
expressions and lambdas over arrays of lines and words, took ten times the CPU). The rule list was
induced in the same run by incremental reduced-error pruning (:func:`fit_rules`) on
documents that labelling functions describe beyond doubt (:data:`LABELLING`, a hash sample
of MAX_LABELLED documents); its thresholds are exported to one SQL CASE expression
(:func:`rules_to_sql`) which Spark evaluates natively on all documents.

Defined results: a null, empty or blank text has zero counts, null shares and the kind
null (no case); a text of any length is measured whole; repeated rows are measured
each; further columns are left out of the result unless named in ``keep``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK = re.compile(r"\r\n|[\n\r\x0B\x0C\x85\u2028\u2029]").split
BLANK = re.compile(r"[\s\u200b\u2060\ufeff]*").fullmatch
WORDS = re.compile(r"[^\W_]+").findall
MARKED = re.compile(
    r"\s*(?:[-–—•*·‣◦▪●○■□☐☑☒✔✗❖→►▸➢✓+>]|[0-9]{1,3}(?:\.[0-9]{1,2})*[.)°:]|[0-9]{1,3} ?[-–]|[A-Za-z][.)]|\([A-Za-z0-9]{1,3}\)|[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+\S"
).match
#: (what a line must contain, the pattern it must then have) to be a row of cells
CELLS = tuple(
    (mark, re.compile(pattern).search)
    for mark, pattern in (
        ("|", r"\|.*\||\S \| |^[\s|+:=_-]+$"),
        ("\t", r"\S\t+\S|^\t"),
        ("  ", r"\S {2,}\S.* {2,}\S|\S {3,}\S"),
        (";", r"^(?:[^;]{0,60};(?! )){2,}[^;]{0,60}$|^\"[^\"]*\";\""),
        (",", r"^(?:[^,]{0,40},(?! )){2,}[^,]{0,40}$|\"[^\"]*\",\""),
        (" / ", r"^(?:[^;,/|]{1,30} / ){2,}"),
        ("=", r"^(?:[^=,;]{1,30}=[^=,;]{0,60}[,;] ?)+[^=,;]{1,30}="),
        ("--", r"^[\s|+:=_*~-]+$"),
        ("==", r"^[\s|+:=_*~-]+$"),
    )
)
QUESTION = re.compile(r"(?:Q|R|A|F|P|Question|Réponse|Reponse|Answer|Frage|Antwort|Pregunta|Respuesta) ?:").match
TERM = re.compile(r".[^.!?:]{0,60} ?[:=–—→]+ ?\S").match
MARKUP = re.compile(r"<[^<>]{1,80}>|&(?:amp;)*#?[A-Za-z0-9]{1,8};|\\u[0-9a-fA-F]{4}|=[0-9A-F]{2}|\{\}").findall
VOWELS = re.compile(r"[aeiouyàâäéèêëîïôöùûüœæáíóú]+", re.IGNORECASE).findall
DIGITS = re.compile(r"\d+").findall
LONG = re.compile(r"\S{28,}").findall
#: Articles, and function words that do not follow an article in running text.
ARTICLES = frozenset("le la les un une des du au aux ce cette the a an el los las una der die das den dem ein eine einen".split())
NOT_NEXT = ARTICLES | frozenset("de à en et est doit peut que dans pour par sur avec of to in is must may that for by with and on at has no y por con se debe und zu von mit ist im muss soll".split())
FEATURES = ("n_words", "mean_word_len", "single_share", "common_share", "distinct_share", "misplaced_share", "letter_share", "digit_share", "symbol_share", "vowel_share", "marked_share", "cell_share", "open_share", "term_share", "list_share", "lower_start_share", "punct_end_share", "markup_share", "unbroken_share", "mean_line_len", "n_lines")


def line_kind(line: str) -> str:
    """c: row of cells, m: marked item, o: open-ended capital line, t: term and gloss, p: other."""
    for mark, test in CELLS:
        if mark in line and test(line):
            return "c"
    if MARKED(line):
        return "m"
    bare = line.strip()
    first, last = bare[0], bare[-1]
    begins = first.isupper() or first.isdigit()
    if len(line) <= 150 and len(bare) > 1 and (begins or first in "\"«(") and last not in ".!?…:;,-":
        return "o"
    if len(line) <= 240 and begins and ". " not in bare and not QUESTION(bare) and TERM(bare):
        return "t"
    return "p"


def measure(text: str | None, common: frozenset[str]) -> tuple:
    """The FEATURES of one text; a share without a base is None."""
    lines = [x for x in BREAK(text) if not BLANK(x)] if text else []
    if not lines:
        return (0, *[None] * (len(FEATURES) - 2), 0)
    words = WORDS(text.lower())
    n, in_words = len(words), sum(map(len, words))
    solid = sum(map(len, text.split()))
    digits = sum(map(len, DIGITS(text)))
    letters = in_words - digits
    size = dict.fromkeys("cmotp", 0)
    low = end = 0
    for x in lines:
        size[line_kind(x)] += len(x)
        bare = x.strip()
        low += bare[0].islower()
        end += bare[-1] in ".!?…:;»\")"
    chars = sum(size.values())
    return (
        n,
        in_words / n if n else None,
        sum(map((1).__eq__, map(len, words))) / n if n else None,
        sum(map(common.__contains__, words)) / n if n else None,
        len(set(words)) / n if n else None,
        sum(a in ARTICLES and b in NOT_NEXT for a, b in zip(words, words[1:], strict=False)) / n if n else None,
        letters / solid,
        digits / solid,
        (solid - in_words) / solid,
        sum(map(len, VOWELS(text))) / letters if letters > 0 else None,
        size["m"] / chars,
        size["c"] / chars,
        size["o"] / chars,
        size["t"] / chars,
        (size["m"] + size["o"] + size["t"]) / chars,
        low / len(lines),
        end / len(lines),
        sum(map(len, MARKUP(text))) / len(text),
        sum(map(len, LONG(text))) / solid,
        chars / len(lines),
        len(lines),
    )


def text_statistics(df: DataFrame, common_words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics...) of every row, over its whole text. ``common_words`` is a fixed list."""
    common = frozenset(w.lower() for w in common_words if w)
    kinds = [pa.int64() if f in ("n_words", "n_lines") else pa.float64() for f in FEATURES]

    def run(batches):
        for b in batches:
            got = [measure(t, common) for t in b.column(1).to_pylist()]
            columns = zip(*got, strict=True) if got else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *FEATURES])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} {'bigint' if k == pa.int64() else 'double'}" for f, k in zip(FEATURES, kinds, strict=True))
    return df.select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


# -- learning the rules ---------------------------------------------------
#: Documents in the sample that teaches the rules: a bound on the fit alone.
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Rule:
    kind: str
    #: (feature, "<=" or ">", threshold), all of which must hold
    tests: tuple[tuple[str, str, float], ...]


def _covers(tests, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, v in tests:
        c = x[:, names.index(f)]
        hit &= (c <= v) if op == "<=" else (c > v)
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> list:
    """Add the test of the greatest information gain until no wrong row is covered."""
    tests: list = []
    live = np.ones(len(x), bool)
    while True:
        p0, n0 = (y & live).sum(), (~y & live).sum()
        if not p0 or not n0 or len(tests) == 6:
            return tests
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j, f in enumerate(names):
            order = np.argsort(x[live, j], kind="stable")
            v, yy = x[live, j][order], y[live][order]
            edge = np.flatnonzero(np.diff(v) > 1e-12)
            if not len(edge):
                continue
            p = np.cumsum(yy)[edge]
            n = edge + 1 - p
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(pp + nn, 1)) - base), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, op, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
        if best[1] is None:
            return tests
        tests.append(best[1])
        live &= _covers(tests[-1:], x, names)


def _prune(tests: list, x: np.ndarray, y: np.ndarray, names: list[str]) -> list:
    """Drop final tests while that does not lower (p - n) / (p + n) on the pruning rows."""

    def worth(t):
        h = _covers(t, x, names)
        p, n = (h & y).sum(), (h & ~y).sum()
        return (p - n) / (p + n) if p + n else -1

    best = tests
    for k in range(len(tests) - 1, 0, -1):
        if worth(tests[:k]) >= worth(best):
            best = tests[:k]
    return best


def fit_rules(rows: DataFrame, label: str = "label", order: tuple[str, ...] = ("junk", "table", "list"), seed: int = 7) -> list[Rule]:
    """Ordered rules from labelled statistics by incremental reduced-error pruning.

    ``rows`` holds the FEATURES and ``label`` (the default kind is ``prose``). The rows are
    collected for the fit: see :func:`labelled` for their bound.
    """
    names = list(FEATURES)
    got = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names], label).toPandas().sort_values([*names, label])
    x, y = got[names].to_numpy(float), got[label].to_numpy()
    rng, rules = np.random.default_rng(seed), []
    for kind in order:
        while (y == kind).any():
            grow = rng.random(len(x)) < 2 / 3
            tests = _grow(x[grow], y[grow] == kind, names)
            if not tests:
                break
            tests = _prune(tests, x[~grow], y[~grow] == kind, names)
            hit = _covers(tests, x[~grow], names)
            if not hit.any() or (y[~grow][hit] == kind).mean() <= 0.5:
                break
            rules.append(Rule(kind, tuple(tests)))
            left = ~_covers(tests, x, names)
            x, y = x[left], y[left]
    return rules


def rules_to_sql(rules: list[Rule] | tuple[Rule, ...], default: str = "prose") -> str:
    cases = " ".join("WHEN " + " AND ".join(f"coalesce({f}, 0) {op} {v:.6g}" for f, op, v in r.tests) + f" THEN '{r.kind}'" for r in rules)
    return f"CASE WHEN coalesce(n_lines, 0) = 0 THEN NULL {cases} ELSE '{default}' END"


# -- labels ------------------------------------------------------------------
#: Labelling functions: tests on the statistics that are clear enough to label a document, in order.
#: Documents that none of them describes, or only nearly, have no label and teach nothing.
LABELLING = (
    ("junk", "letter_share < 0.3 AND cell_share < 0.3 AND marked_share < 0.3"),
    ("junk", "letter_share < 0.1 AND symbol_share > 0.4"),
    ("junk", "unbroken_share > 0.6 AND cell_share < 0.3"),
    ("junk", "digit_share > 0.45 AND mean_word_len < 2.3 AND single_share < 0.03"),
    ("junk", "n_words > 10 AND letter_share > 0.4 AND vowel_share < 0.28 AND common_share < 0.1"),
    ("junk", "n_words > 20 AND common_share < 0.1 AND list_share < 0.2 AND cell_share < 0.2"),
    ("junk", "n_words > 20 AND single_share > 0.4 AND list_share < 0.2 AND cell_share < 0.2"),
    ("junk", "n_words > 20 AND symbol_share > 0.2 AND common_share < 0.2 AND list_share < 0.2 AND cell_share < 0.2"),
    ("junk", "n_words > 20 AND misplaced_share > 0.05 AND list_share < 0.3 AND cell_share < 0.2"),
    ("junk", "n_words > 30 AND distinct_share < 0.1 AND common_share < 0.2 AND list_share < 0.2 AND cell_share < 0.2"),
    ("prose", "n_lines = 1 AND marked_share < 0.5 AND common_share > 0.25 AND misplaced_share < 0.025 AND n_words > 10"),
    ("prose", "lower_start_share > 0.25 AND marked_share < 0.3 AND cell_share < 0.3 AND common_share > 0.25 AND misplaced_share < 0.025"),
    ("table", "cell_share > 0.6 AND n_lines > 1"),
    ("list", "marked_share > 0.6 AND n_lines > 1"),
    ("list", "list_share > 0.7 AND lower_start_share < 0.1 AND n_lines > 2"),
    ("prose", "list_share < 0.4 AND cell_share < 0.4 AND common_share > 0.22 AND misplaced_share < 0.025 AND letter_share > 0.6"),
)


def label_sql() -> str:
    cases = " ".join(f"WHEN {re.sub(r'[a-z_]+_share|mean_word_len', lambda m: f'coalesce({m[0]}, 0)', test)} THEN '{kind}'" for kind, test in LABELLING)
    return f"CASE WHEN coalesce(n_lines, 0) = 0 THEN NULL {cases} END"


def labelled(df: DataFrame, common_words: list[str], key: str = "doc_id", text: str = "text", max_rows: int = MAX_LABELLED) -> DataFrame:
    """(FEATURES, label) of a hash sample of about ``max_rows`` documents, without those that the labelling functions leave open."""
    part = min(1.0, max_rows / max(df.count(), 1))
    chosen = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int(part * (1 << 30)))
    stats = text_statistics(chosen, common_words, key, text).withColumn("label", F.expr(label_sql()))
    return stats.where("label IS NOT NULL")


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` and ``kind``, by the CASE expression of the rules."""
    return stats.withColumn("kind", F.expr(rules_to_sql(rules)))


def kinds(df: DataFrame, common_words: list[str], key: str = "doc_id", text: str = "text", max_rows: int = MAX_LABELLED) -> DataFrame:
    """Statistics and kind of every document: label a sample, induce the rules, export them, apply them to all."""
    rules = fit_rules(labelled(df, common_words, key, text, max_rows))
    return classify(text_statistics(df, common_words, key, text), rules)
