import random

import pytest

from kerfline.llm import pairs as P

COMMON = [("fr", w) for w in "de la le les et des du un une à".split()] + [("en", w) for w in "the of and to in a is".split()]
Q = "Qui doit tester les sauvegardes du portail Canre ?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \n", "empty"), (Q, "…", "empty"), (Q, "N/A", "empty"), (Q, "<p></p>", "empty"), (Q, "Réponse :", "empty"),
    (Q, "Le RSSI doit tester les sauvegardes avant le 12/03/2024.", None), (Q, "Oui.", None), (Q, "Non", None), (Q, "Deux fois par an", None), (Q, "cf. A.8.2", None), (Q, "Sous 8 jours ouvrés", None),
    (Q, "Désolé, je ne suis pas en mesure de vous aider sur ce point.", "refusal"), (Q, "I am sorry, but I cannot answer this request.", "refusal"), (Q, "Je regrette, je dois décliner cette demande.", "refusal"),
    (Q, "qui doit tester les sauvegardes du portail canre", "copied_question"), (Q, f"Vous demandez : {Q}", "copied_question"), (Q, f"« {Q} »", "copied_question"),
    (Q, f"Vous demandez : « {Q} » Le RSSI doit tester les sauvegardes du portail avant la fin du mois, avec une fiche de recette.", None),
    (Q, "The operations team must test the backups of the platform before the end of the month.", "other_language"),
    ("Rédigez en anglais une consigne pour les sauvegardes.", "The operations team must test the backups of the platform.", None),
    (Q, "Le RSSI teste les sauvegardes. Le titre du guide est « The operations team must test the backups of the platform ».", None),
    (Q, "Le RSSI doit tester les sauvegardes du portail et prévenir la", "truncated"), (Q, "Le RSSI doit tester les sauvegardes (voir aussi la mesure", "truncated"), (Q, "Depuis la revue du 06/05/2025,", "truncated"),
    (Q, "Le RSSI doit tester les sauvegardes du portail (mesure A.18.2)", None),
    (None, "Une réponse sans question.", None),
]


@pytest.mark.parametrize(("prompt", "answer", "defect"), CASES)
def test_defect(prompt, answer, defect):
    assert P.Judge(COMMON).defect(prompt, answer) == defect


def test_suffix_automaton_equals_brute_force():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(1, 14))] for _ in "ab")
        text = " ".join(a) + " "
        want = []
        for k in range(len(b)):
            n = 0
            while n <= k and (" " + text).find(" " + " ".join(b[k - n : k + 1]) + " ") >= 0:
                n += 1
            want.append(n)
        assert P.SuffixAutomaton(a).runs(b) == want


def test_delimiters():
    assert P.open_delimiters("a (b « c » d)") == 0 and P.open_delimiters("a « b (c)") == 1 and P.open_delimiters("a) point") == 0 and P.open_delimiters('dit "oui') == 1


def test_table(spark):
    rows = [("result", k, q, a) for k, (q, a, _) in enumerate(CASES)] + [("result", 900, Q, "mot " * 40_000 + "fin.")]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id bigint, query string, answer string").selectExpr("*", "'x' AS defect", "1 AS w", "2 AS _seen")
    got = {r.rec_id: r.defect for r in P.defects(df, COMMON, ["rec_kind", "rec_id"]).collect()}
    assert 900 not in got
    hit = sum(got.get(k) == d for k, (_, _, d) in enumerate(CASES))
    assert hit == len(CASES)
    assert P.defects(df.where("rec_id < 0"), COMMON, ["rec_kind", "rec_id"]).count() == 0


@pytest.mark.parametrize("answer", ["Prefiero no responder.", "No answer will be given.", "I don't have the right to answer.", "We don't answer such requests.", "Mes consignes ne me permettent pas de répondre.", "Je choisis de ne pas répondre."])
def test_every_refusal_pattern_is_reached(answer):
    assert P.Judge(COMMON).defect(Q, answer) == "refusal"


@pytest.mark.parametrize("answer", ["Le RSSI ne peut pas répondre seul à la demande.", "Je n'ai rien. Le portail ne permet pas de répondre.", "Il ne faut pas refuser l'aide. Nous avons répondu.", "This is the rule for the outside wall."])
def test_no_refusal(answer):
    assert not P.Automaton(P.REFUSING).accepts(P.tokens_of(answer))


def test_automaton_equals_search_of_patterns():
    """Against a plain search that tries every pattern at every word."""

    def at(slots, words, i, gap):
        if not slots:
            return True
        x = slots[0]
        if x[0] == "+":
            return at(slots[1:], words, i, int(x[1:]))
        if x[0] == "?" and at(slots[1:], words, i, gap):
            return True
        alternatives = x.lstrip("?").split("|")
        return any(k < len(words) and any(words[k] == a or (a[-1] == "*" and words[k].startswith(a[:-1])) for a in alternatives) and at(slots[1:], words, k + 1, 0) for k in range(i, i + gap + 1))

    r = random.Random(4)
    lines = [x.split() for x in P.REFUSING.strip().splitlines()]
    pool = sorted({a.strip("?*") for x in lines for s in x if s[0] != "+" for a in s.split("|")})
    dfa = P.Automaton(P.REFUSING)
    hits = 0
    for _ in range(1500):
        words = [r.choice(pool) for _ in range(r.randrange(2, 6))]
        line = r.choice(lines)
        for s in line:  # a pattern with words between, at times broken
            if s[0] == "+":
                words += [r.choice(pool) for _ in range(r.randrange(int(s[1:]) + 2))]
            elif r.random() < 0.93:
                words.append(r.choice(s.lstrip("?").split("|")).rstrip("*"))
        want = any(at(x, words, i, 0) for x in lines for i in range(len(words)))
        hits += want
        assert dfa.accepts(words) == want
    assert 200 < hits < 1500


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    one = [("result", k, q, a) for k, (q, a, _) in enumerate(CASES)] + [("result", 800, Q, "Le RSSI valide chaque mois les sauvegar")]
    many = one + [(kind, k + 1000 * j, q, a) for j in range(1, 4) for kind, k, q, a in one]
    schema = "rec_kind string, rec_id bigint, query string, answer string"
    few, more = ({tuple(r) for r in P.defects(spark.createDataFrame(x, schema), COMMON, ["rec_kind", "rec_id"]).where("rec_id < 1000").collect()} for x in (one, many))
    assert few == more
