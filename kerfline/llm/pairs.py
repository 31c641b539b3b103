"""Broken prompt and response pairs.

Defects, tested in this order (an answer has one at most):
empty            nothing is left but marks, placeholders, labels or markup
refusal          the refusal automaton reaches its accepting state within a sentence: someone
                 who speaks for the answerer, then inability or unwillingness, then an act
copied_question  by the suffix automaton of the prompt, runs of the prompt cover the answer
other_language   stopword votes of the answer (without quotations) are clearly for another
                 language than the prompt's, and the prompt doesn't ask for that
truncated        the delimiter stack isn't empty at the end, or the end is in a state in which no
                 sentence ends: after a comma, a colon, an elision, a function word, within a
                 word of the prompt, or in a sentence without a final mark

Every verdict rests on the pair alone, so it is the same in tables of any size. A word that
breaks off in a short answer without a final mark can't be told from a whole one.

Defined results: a null answer is empty; with a null prompt there is neither a copy nor
another language; repeated deliveries of a record are one record; texts of any length are
read whole; extra columns are ignored; empty tables have no defects.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SENTENCE_MARKS = frozenset(".!?")
TOKEN = re.compile(r"[^\W_]+|[.!?]")
MARKS = re.compile("[̀-ͯ]+")
#: What stands for "no answer".
NOTHING = frozenset("|a|r|q|na|n a|none|null|nil|nan|vide|empty|ras|neant|reponse|answer|tbd|todo|undefined|sans reponse|no answer|pas de reponse|aucune reponse|p p|br|div div|respuesta|antwort".split("|"))
#: Function words that do not end an answer, and votes beside the common-word table.
FUNCTION = {
    "fr": "le la les l un une des du de d à au aux et ou mais que qu qui dont où pour par sur sous dans avec sans en ne n se s son sa ses leur leurs ce cet cette ces est sont doit doivent peut peuvent devrait il elle ils elles on je nous vous avant après depuis lorsque si comme ainsi afin lors quel quelle quelles quels comment pourquoi quoi quand faut selon titre donc car puis relève relèvent souhaite",
    "en": "the a an of to in on at by for with without from and or but that which who whom whose this these those is are was were be been has have had must should may can shall will would could it its their his her as if when while before after since than then how what why where there do does within under into between during",
    "es": "el la los las un una unos unas de del al y o pero que quien cuyo para por sobre bajo en con sin se su sus este esta estos estas es son debe puede deben pueden lo le les como cuando antes después según qué cómo quién cuál dónde cada",
    "de": "der die das den dem des ein eine einen einem einer und oder aber dass für von mit ohne auf unter über an am im in zu zum zur bei nach vor seit ist sind war wird werden muss soll darf kann es sie er wir wie was wer wann warum als wenn bis durch",
}
ASKS_LANGUAGE = re.compile(
    r"\b(?:version|traduction|traduccion|ubersetzung|translation|traduisez|traduire|traduis|translate|traduzca|traduce|ubersetze\w*)\b"
    r"|\b(?:en|in|auf|into|to|al)\s+(?:langue\s+)?(?:anglais\w*|francais\w*|espagnol\w*|allemand\w*|english|french|spanish|german|ingles|frances|espanol|aleman|englisch|franzosisch|spanisch|deutsch)\b"
    r"|\b(?:anglaise|espagnole|allemande|inglesa|francesa|alemana)\b"
)
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"\n]*\"|„[^“”]*[“”]")
MARKUP = re.compile(r"<[^<>]{0,80}>|&[a-z]+;")

#: What a refusal says, word by word: a|b are alternatives, a* any word that begins so, ?a may be left out,
#: +k lets k words at most stand between.
REFUSING = """
je ne|n peux|puis|saurais|suis|souhaite|veux +12 repondre|aider|traiter|suite|communiquer|fournir|commenter|aborder|mesure|autorise*|habilite*|divulguer|partager|discuter|prononcer
il m est impossible|interdit|defendu
je prefere|dois decliner|refuser|passer
je prefere|dois ne|m pas|abstenir
je choisis|contraint*|oblig*|tenu* de decliner|refuser|passer
je choisis de ne|m pas|abstenir
je vais devoir decliner|refuser|passer|ne|m
je suis contraint*|oblig*|tenu* de decliner|refuser|passer|ne|m
je decline|refuse
je m abstiens
je me garde
je n ai pas +1 droit|autorisation|permission|acces|possibilite
nous ne donnons|pouvons|sommes|souhaitons|repondons|traitons +3 pas
aucune reponse ne ?vous sera|peut|pourra
cette question|demande +4 depasse|sort|excede
cette question|demande +3 ne releve pas
cette question|demande +3 n entre pas
ma|mes|les configuration|consigne|consignes|regle|regles|parametrage|parametres|instructions +4 interdi*|empech*
ma|mes|les configuration|consigne|consignes|regle|regles|parametrage|parametres|instructions +3 ne me permet|permettent
i cannot
i can|could|will|must|may not
i can|won t
i am|m unable
i am|m not able|allowed|permitted
i do not wish
i don t wish
i have|need to decline|refuse|abstain|pass|refrain|not
i must decline|refuse|abstain|pass|refrain
i would like|rather|prefer ?to decline|refuse|abstain|pass|refrain|not
i prefer|choose ?to decline|refuse|abstain|pass|refrain|not
i decline|refuse|abstain
i do not have ?the right|permission|access|authorization|authorisation
i don t have ?the right|permission|access|authorization|authorisation
we cannot +4 respond|answer|process|comment|handle|discuss|help|provide|share
we do|will not +4 respond|answer|process|comment|handle|discuss|help|provide|share
we don|can t +4 respond|answer|process|comment|handle|discuss|help|provide|share
we are unable +4 respond|answer|process|comment|handle|discuss|help|provide|share
we are not able +4 respond|answer|process|comment|handle|discuss|help|provide|share
this +5 is|goes|lies|falls +2 outside|beyond
my setup|configuration|instructions|rules|guidelines|settings +3 does|do not
my setup|configuration|instructions|rules|guidelines|settings +3 doesn|don t
my setup|configuration|instructions|rules|guidelines|settings +3 forbid*|prevent*|prohibit*
no answer will|can be
no puedo +4 responder|ayudar*|contestar|comentar|tratar|facilitar
me es imposible
debo declinar|rechazar
prefiero no
no estoy autorizad*
no estoy en condiciones
ich kann +8 nicht +4 beantworten|helfen|antworten
es ist mir unmoglich
es ist mir nicht moglich
ich muss|mochte +4 ablehnen
ich darf +8 nicht
"""


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    s = s.replace("’", "'").replace("œ", "oe").replace("Œ", "oe")
    return MARKS.sub("", unicodedata.normalize("NFKD", s)).lower()


class Automaton:
    """A deterministic automaton over classes of words, from patterns as in REFUSING; its states are made when first reached.

    A state is a set of (pattern, slot, words that may still stand before the slot's word). Words that play the
    same part in all slots are one class. Reaching the end of a pattern accepts.
    """

    def __init__(self, patterns: str):
        self.slots: list[list[tuple[frozenset[str], tuple[str, ...], int]]] = []
        for line in patterns.strip().splitlines():
            for variant in self._variants(line.split()):
                gap, out = 0, []
                for x in variant:
                    if x[0] == "+":
                        gap = int(x[1:])
                        continue
                    words = x.split("|")
                    out.append((frozenset(w for w in words if w[-1] != "*"), tuple(w[:-1] for w in words if w[-1] == "*"), gap))
                    gap = 0
                self.slots.append(out)
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.classes: dict[str, int] = {}
        self.kinds: dict[frozenset, int] = {}
        self.parts: list[frozenset] = []
        self.step: dict[tuple[int, int], int] = {}
        self._state(frozenset())
        self._class(frozenset())

    @staticmethod
    def _variants(items: list[str]):
        at = next((k for k, x in enumerate(items) if x[0] == "?"), None)
        if at is None:
            yield items
            return
        yield from Automaton._variants([*items[:at], items[at][1:], *items[at + 1 :]])
        yield from Automaton._variants([*items[:at], *items[at + 1 :]])

    def _state(self, s: frozenset) -> int:
        if s not in self.number:
            self.number[s] = len(self.states)
            self.states.append(s)
        return self.number[s]

    def _class(self, parts: frozenset) -> int:
        if parts not in self.kinds:
            self.kinds[parts] = len(self.parts)
            self.parts.append(parts)
        return self.kinds[parts]

    def class_of(self, word: str) -> int:
        if len(self.classes) > 500_000:
            self.classes.clear()
        plain = fold(word)
        parts = frozenset((p, k) for p, slots in enumerate(self.slots) for k, (words, stems, _) in enumerate(slots) if plain in words or plain.startswith(stems))
        self.classes[word] = got = self._class(parts)
        return got

    def _next(self, state: int, kind: int) -> int:
        parts, new = self.parts[kind], set()
        for p, k, left in [*self.states[state], *((p, 0, 0) for p in range(len(self.slots)))]:
            if (p, k) in parts:
                if k + 1 == len(self.slots[p]):
                    self.step[state, kind] = -1
                    return -1
                new.add((p, k + 1, self.slots[p][k + 1][2]))
            if left:
                new.add((p, k, left - 1))
        self.step[state, kind] = got = self._state(frozenset(new))
        return got

    def accepts(self, tokens: list[str]) -> bool:
        """Whether a pattern occurs in the words between two sentence marks; tokens are in lower case, with their accents."""
        classes, step, state = self.classes, self.step, 0
        for w in tokens:
            if w in SENTENCE_MARKS:
                state = 0
                continue
            kind = classes.get(w)
            if kind is None:
                kind = self.class_of(w)
            if state or kind:
                after = step.get((state, kind))
                state = self._next(state, kind) if after is None else after
                if state < 0:
                    return True
        return False


# -- empty and refusal -------------------------------------------------------
def tokens_of(text: str) -> list[str]:
    """Words in lower case and sentence marks."""
    return TOKEN.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())


def is_empty(answer: str, words: list[str]) -> bool:
    if "<" in answer or "&" in answer:
        words = words_of(tokens_of(MARKUP.sub(" ", answer)))
    return len(words) < 5 and " ".join(map(fold, words)) in NOTHING


def words_of(tokens: list[str]) -> list[str]:
    return [w for w in tokens if w not in SENTENCE_MARKS]


def unquoted(text: str) -> str:
    return QUOTED.sub(" ", text) if any(map(text.__contains__, '«"“„')) else text


# -- copies --------------------------------------------------------------------
class SuffixAutomaton:
    """Of a sequence of words; feeding another sequence gives at each word the longest run of the first that ends there."""

    def __init__(self, words: list[str]):
        self.go: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in words:
            new = self._state({}, -1, self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.go[p]:
                self.go[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.go[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.go[q]), self.link[q], self.size[p] + 1)
                    while p >= 0 and self.go[p].get(w) == q:
                        self.go[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, go: dict[str, int], link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def runs(self, words: list[str]) -> list[int]:
        out, at, n = [], 0, 0
        for w in words:
            while at and w not in self.go[at]:
                at = self.link[at]
                n = self.size[at]
            if w in self.go[at]:
                at, n = self.go[at][w], n + 1
            else:
                at, n = 0, 0
            out.append(n)
        return out


def copied_share(q: list[str], a: list[str], least: int = 3) -> tuple[float, float]:
    """(share of the answer's words in runs of ``least`` or more words of the prompt, longest run / words of the prompt)."""
    if not q or not a:
        return 0.0, 0.0
    known = set(q)
    if len(a) - sum(map(known.__contains__, a)) > max(2, 0.2 * len(a)):  # too many words of its own to be covered
        return 0.0, 0.0
    runs = SuffixAutomaton(q).runs(a)
    covered, until = 0, len(a)
    for k in range(len(a) - 1, -1, -1):
        if runs[k] >= min(least, len(q)):
            begin = k - runs[k] + 1
            covered += max(0, min(until, k + 1) - begin)
            until = min(until, begin)
    return covered / len(a), max(runs) / len(q)


def is_copy(q: list[str], a: list[str]) -> bool:
    share, longest = copied_share(q, a)
    return longest >= 0.6 and (1 - share) * len(a) <= max(2, 0.2 * len(a))


# -- language ----------------------------------------------------------------
LANGUAGES = tuple(FUNCTION)


class Votes:
    """Each function or common word has one vote, shared between the languages that have it."""

    def __init__(self, common: list[tuple[str, str]]):
        of: dict[str, set[str]] = {}
        for lang, words in [*((k, v.split()) for k, v in FUNCTION.items()), *((k, [w]) for k, w in common)]:
            for w in words:
                of.setdefault(w.lower(), set()).add(lang)
        plain: dict[str, set[str]] = {}
        for w, langs in of.items():
            plain.setdefault(fold(w), set()).update(langs)
        self.of = {w: tuple((LANGUAGES.index(x), 1 / len(langs)) for x in langs if x in FUNCTION) for w, langs in (plain | of).items()}

    def count(self, words: list[str]) -> list[float]:
        """Votes for each of LANGUAGES."""
        got = [0.0] * len(LANGUAGES)
        for shares in filter(None, map(self.of.get, words)):
            for k, v in shares:
                got[k] += v
        return got

    @staticmethod
    def language(votes: list[float], lead: float = 1.5, least: float = 1.5) -> int | None:
        first, second = sorted(votes, reverse=True)[:2]
        return votes.index(first) if first >= least and first >= lead * second else None

    def is_other(self, prompt: str, answer: list[str]) -> bool:
        a = self.language(self.count(answer))
        if a is None:
            return False
        q = self.count(tokens_of(unquoted(prompt)))
        best = max(q)
        if q.index(best) == a or best < 1 or best < 1.3 * q[a]:
            return False
        return not ASKS_LANGUAGE.search(fold(prompt))


# -- truncation ------------------------------------------------------------------
OPENING = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”"}
DELIMITER = re.compile(r"[()\[\]{}«»“”]")
ITEM = re.compile(r"\s*(?:[-–—•*·▪]|\d{1,3}[.)]|[a-z][.)])\s+")
ELISION = re.compile(r"(?:^|\W)(?:qu|[a-z])['’]$")
ENDED = re.compile(r"[^\W\d_]{3,}[.!?…][\"»”')\]]*\s+[^\W\d_a-z]")


def open_delimiters(text: str) -> int:
    """Depth of the delimiter stack at the end (straight quotes count by parity); stray closing marks are skipped."""
    stack: list[str] = []
    if DELIMITER.search(text):
        for line in text.split("\n"):
            for c in DELIMITER.findall(line[m.end() :] if (m := ITEM.match(line)) else line):
                if c in OPENING:
                    stack.append(OPENING[c])
                elif c in stack:
                    while stack.pop() != c:
                        pass
    return len(stack) + text.count('"') % 2


def is_truncated(answer: str, q: list[str], functions) -> bool:
    """``functions``: called where the function words of the pair's language are needed."""
    t = answer.rstrip()
    if open_delimiters(t):
        return True
    tail = t[-1]
    if tail in "'’" and ELISION.search(t.lower()):
        return True
    if tail in ".!?»)]”\"'’":
        return t.endswith(("..", "…")) and len(WORD.findall(t)) > 3
    if tail in ",;:-–—/…(":
        return True
    words = WORD.findall(t)
    if not words:
        return False
    last = words[-1].lower()
    held = functions()
    if last in held and not words[-1].isupper():
        return True
    plain = fold(last)
    if len(plain) > 3 and plain not in q and any(w.startswith(plain) and len(w) > len(plain) + 2 for w in q):  # within a word of the prompt
        return True
    lines = [x for x in t.split("\n") if x.strip()]
    if len(lines) > 1 and ITEM.match(lines[-1]):
        other = [WORD.findall(x)[-1] for x in lines[:-1] if ITEM.match(x) and WORD.findall(x)]
        return bool(other) and all(not w[:1].islower() for w in other) and words[-1][:1].islower()
    if ENDED.search(t):  # earlier sentences have their marks, the last has none
        return True
    return len(words) > 9 and sum(w.lower() in held for w in words) >= 2


class Judge:
    """Gives each pair its defect; made once in a task."""

    def __init__(self, common: list[tuple[str, str]]):
        self.votes, self.refusing = Votes(common), Automaton(REFUSING)
        self.functions = [frozenset(v.split()) for v in FUNCTION.values()]
        self.plain: dict[str, str] = {}

    def defect(self, prompt: str | None, answer: str | None) -> str | None:
        if answer is None:
            return "empty"
        tokens = tokens_of(answer)
        words = words_of(tokens)
        if is_empty(answer, words):
            return "empty"
        bare = unquoted(answer)
        spoken = tokens if bare is answer else tokens_of(bare)
        if self.refusing.accepts(spoken):
            return "refusal"
        q: list[str] = []
        if prompt:
            q = self.folded(words_of(tokens_of(prompt)))
            if is_copy(q, self.folded(words)):
                return "copied_question"
            if self.votes.is_other(prompt, spoken):
                return "other_language"

        def functions() -> frozenset[str]:
            counts = self.votes.count(tokens_of(unquoted(prompt or "")) + spoken)
            return self.functions[counts.index(max(counts))]

        return "truncated" if is_truncated(answer, q, functions) else None

    def folded(self, words: list[str]) -> list[str]:
        """Words without accents; each distinct word is folded once (memory bound only)."""
        if len(self.plain) > 500_000:
            self.plain.clear()
        for w in set(words).difference(self.plain):
            self.plain[w] = fold(w)
        return list(map(self.plain.__getitem__, words))


def judged(pairs: DataFrame, common_words: list[tuple[str, str]], keys: list[str], prompt: str = "query", answer: str = "answer") -> DataFrame:
    """(keys, defect) of every pair; null where there is none. ``common_words`` is the fixed (lang, word) table."""
    ready = pairs.select(*keys, F.col(prompt).alias("_q"), F.col(answer).alias("_a"))
    n = len(keys)

    def run(batches):
        judge = Judge(common_words)
        for b in batches:
            got = [judge.defect(q, a) for q, a in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(n)), pa.array(got, pa.string())], names=[*keys, "defect"])

    schema = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keys) + ", defect string"
    return ready.mapInArrow(run, schema)


def defects(pairs: DataFrame, common_words: list[tuple[str, str]], keys: list[str], prompt: str = "query", answer: str = "answer") -> DataFrame:
    """(keys, defect) of every defective pair."""
    return judged(pairs, common_words, keys, prompt, answer).where("defect IS NOT NULL")

