import re

import pytest
from pyspark.sql import functions as F

from kerfline.operators import answers, sheets
from kerfline.operators import extraction as X
from kerfline.operators import stripping as S

POLICY = """Préambule libre
1. Objet
Le personnel doit changer le mot de passe chaque mois.
Nous devons rien ici, mais L'organisation doit tenir un registre.

Article 2 : Suite
Tout compte est revu par le responsable du service.
"""


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").selectExpr("*", "1 AS position", "'x' AS content", "2 AS level")


def test_sections_have_levels(spark):
    got = rows(S.sections(table(spark, POLICY, None, "", " \n "), "id", "t"), "id", "position", "header", "level")
    assert got == [(0, 0, "", 0), (0, 1, "1. Objet", 2), (0, 2, "Article 2 : Suite", 1)]


def test_policy_is_cut_into_statements(spark):
    got = rows(S.policy_strips(table(spark, POLICY), "id", "t"), "position", "strip_type")
    assert got[0] == (0, "policy_section") and ("policy_statement" in {k for _, k in got} or len(got) == 3)


def test_steps_equal_the_patterns(spark):
    """Against the same patterns in another engine."""
    texts = ["Étape 1 : ouvrir le ticket\nÉtape 2 : le RSSI doit valider\na) ceci", "1. un 2. deux\n3. trois", "a) lire\nb) écrire", "rien du tout", "1.2 pas une étape"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.steps(F.col("t")).alias("s"))
    for r in df.collect():
        want = []
        for p in S.STEPS:
            want = [(m[1], m[2].strip()) for m in re.finditer(p, r.t, re.MULTILINE | re.DOTALL)]
            if want:
                break
        assert [(x["number"], x["content"]) for x in r.s] == (want or [("1", r.t)])


def test_question_lists(spark):
    text = "Q: Qui valide ?\nR: Le RSSI valide.\nQ: Quand ?\nR: Chaque mois."
    got = rows(S.faq_strips(table(spark, text, "Un paragraphe.\n\nUn autre."), "id", "t"), "id", "position", "strip_type", "content")
    assert got[0] == (0, 0, "faq_entry", "Question: Qui valide ?\n\nRéponse: Le RSSI valide.") and [g[2] for g in got if g[0] == 1] == ["faq_content"] * 2


def test_adaptive_merging(spark):
    text = "Le personnel doit signer. Cela vaut pour tous. Une phrase neutre sans plus. - un\n- deux\n- trois\nUn registre est un document. Il reste ouvert. Autre chose encore."
    got = rows(S.adaptive_strips(table(spark, text, None, "", " "), "id", "t"), "position", "strip_type", "merged")
    assert got[0] == (0, "policy_statement", 2) and (3, "enumeration", 3) in got and (6, "definition", 2) in got
    assert sum(m for _, _, m in got) == 9


def test_dispatch_by_kind(spark):
    df = table(spark, "Politique de sécurité\n" + POLICY, "Procédure d'arrêt\nÉtapes\n1. couper\n2. noter", "Texte libre. Encore un.", None)
    got = {(r.id, r.strip_type.split("_")[0]) for r in S.strip_documents(df, "id", "t").collect()}
    assert (0, "policy") in got and (1, "procedure") in got and {i for i, _ in got} == {0, 1, 2}


@pytest.mark.parametrize(("text", "field", "value"), [
    ("Référence : POL-SEC-001 du groupe", "code", "POL-SEC-001"), ("Version : 2.1", "version", "2.1"), ("rien", "version", None), ("Rédigé par : Jean Martin\nsuite", "author", "Jean Martin"), ("Approuvé par: X", "approver", None),
    ("Classification : Confidentiel", "classification", "Confidential"), ("Le service Juridique répond", "department", "Juridique"), ("Établi le 3/4/24 ici", "creation", "2024-04-03"), ("Établi le 31/02/2024", "creation", None),
])
def test_fields(spark, text, field, value):
    c = F.col("t")
    e = {"code": X.first(c, X.CODES), "version": X.first(c, X.VERSIONS), "author": X.person(c, "author"), "approver": X.person(c, "approver"), "classification": X.classification(c), "department": X.department(c), "creation": X.day(X.first(c, X.DATES["creation"])).cast("string")}
    assert spark.createDataFrame([(text,)], "t string").select(e[field].alias("x")).first()["x"] == value


def test_relations_and_references(spark):
    df = spark.createDataFrame([("Remplace : POL-1. Remplace POL-1. Voir aussi : PROC-22 et [STD-9], voir section 4.2",)], "t string")
    r = df.select(X.relations(F.col("t")).alias("r"), X.every(F.col("t"), X.REFERENCES).alias("x")).first()
    assert {(x["kind"], x["ref"]) for x in r.r} >= {("related", "PROC-22")} and "STD-9" in r.x and "4.2" in r.x


def test_sheets(spark):
    data = [["", None], ["Contrôle", "Statut", "Référence"], ["c1", "conforme", "A.5"], ["c2", "non conforme", None], [None, "", " "], ["c3", None, "A.5"]]
    df = spark.createDataFrame([(1, [("t", data)]), (2, []), (3, None), (4, [("e", [])])], "id int, tables array<struct<title string, data array<array<string>>>>")
    got = rows(sheets.records(df, "id", "tables"), "id", "kind", "row_no", "name", "grouping")
    assert got == [(1, "control_matrix", 0, "c1", "A.5"), (1, "control_matrix", 1, "c2", ""), (1, "control_matrix", 2, "c3", "A.5")]
    assert sum(r.n for r in sheets.rollup(sheets.records(df, "id", "tables"), "id").collect()) == 3


def test_coverage_and_answers(spark):
    q = "Comment fonctionne le pare-feu ?"
    data = [(1, q, "Un pare-feu est un filtre. Il trie.", "definition", 0.9, 1), (1, q, "Il utilise des règles.", "statement", 0.8, 2), (1, q, "Architecture : couches", "enumeration", 0.75, 3), (2, q, None, "statement", 0.6, 1)]
    df = spark.createDataFrame(data, "k int, query string, content string, strip_type string, score double, place int")
    got = {r.k: r for r in answers.coverage(df, "k", F.lit("comment_fonctionne")).collect()}
    assert got[1].covered == "explication_mécanisme,description_architecture" and not got[1].needs_more and got[1].coverage > 0.7
    assert got[2].needs_more and got[2].missing.count(",") == 1
    parts = {r.k: r for r in answers.elements(df, "k").collect()}
    assert parts[1].short_definition == "Un pare-feu est un filtre." and parts[1].key_mechanism == "des règles" and parts[1].components == "Architecture : couches"
    assert {r.k: r.answer for r in answers.answer(answers.elements(df, "k"), "k").collect()}[2] == ""


def test_question_formats(spark):
    from kerfline.operators import questions as Q

    texts = [
        "## Accès\n1. Qui valide les accès ?\nLe RSSI valide les accès.\n\nHors sujet\n2) Quand sont-ils revus ?\nChaque mois, sans faute.\n3. Et ?\nrien",
        "Q : Qui teste ?\nR : L'équipe teste tout.\nQ: Quand est-ce ?\nR: Une fois par an.",
        "## Cat\n### Première question\n\nUne réponse\nen deux lignes\n## Autre\n### Seconde question\nUne autre réponse ici",
        "Pourquoi ceci ?\nParce que cela va bien.\n\nFin",
        None,
        "",
    ]
    got = [(r.id, r.format, r.question, r.answer, r.category) for r in Q.entries(table(spark, *texts), "id", "t").orderBy("id", "line_no").collect()]
    assert got == [
        (0, "numbered", "Qui valide les accès ?", "Le RSSI valide les accès.", "Accès"), (0, "numbered", "Quand sont-ils revus ?", "Chaque mois, sans faute.", "Accès"),
        (1, "prefixed", "Qui teste ?", "L'équipe teste tout.", None), (1, "prefixed", "Quand est-ce ?", "Une fois par an.", None),
        (2, "markdown", "Première question", "Une réponse en deux lignes", "Cat"), (2, "markdown", "Seconde question", "Une autre réponse ici", "Autre"),
        (3, "generic", "Pourquoi ceci ?", "Parce que cela va bien.", None),
    ]
    assert {(r.id, r.category, r.entries) for r in Q.sections(Q.entries(table(spark, *texts), "id", "t"), "id").collect()} >= {(0, "Accès", 2), (1, "Questions Générales", 2)}
