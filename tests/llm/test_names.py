import pytest

from kerfline.llm import names as N

SAME = [
    ("Guillaume Gamenon", "Gamenon, G."),
    ("Guillaume Gamenon", "GUILLAUME GAMZNON"),
    ("Guillaume Gamenon", "Guillou Gamenon"),
    ("Guillaume Gamenon", "Guillaume Gamenon (DPO)"),
    ("Jean-Baptiste Gevausas", "J.-B. Gevausas"),
    ("Jean-Baptiste Gevausas", "Jean. Gevausas"),
    ("Pierre-Yves Joudustois", "PY Joudustois"),
    ("Bureau de la Conformité Lebumier", "BDC Lebmier"),
    ("Comité de Sécurité Numérique Rochoupet", "Rochoupet - CSN"),
    ("Direction des Ressources Humaines Pusevier", "Direction des Ressources Humaines (Pusevier)"),
    ("Vouscisin Conseil", "Société Vouscisin Cons."),
    ("Joséphine Phaunerbot", "josephine.phaunerbot"),
    ("Grégory Mnurgéson", "M. MNURGÉSON"),
]
OTHER = [
    ("Vouscisin Conseil", "Vouscisin Ingénierie"),
    ("Caroline Clougropun", "Christophe Clougropun"),
    ("Marie-Claire Fatrotard", "Léopold Fatrotard"),
    ("Bureau de la Conformité Lebumier", "Bureau de la Conformité Rochoupet"),
    ("Bureau de la Conformité Rochoupet", "Comité de Sécurité Numérique Rochoupet"),
    ("Raphaël Fergalmun", "Raphaël Rerléchot"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert N.compare(N.words_of(a), N.words_of(b))[0] >= N.THRESHOLD


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert N.compare(N.words_of(a), N.words_of(b))[0] < N.THRESHOLD


@pytest.mark.parametrize("name", [None, "", "  ", "-", "?", "n/a", "N/A", "TBD", "inconnu", "xxx", "à compléter", "à définir"])
def test_placeholders(name):
    assert N.words_of(name) == []


def test_collision_curve():
    b = N.bands_for(0.4, 0.99, 3)
    assert 1 - (1 - 0.4**3) ** b >= 0.99 > 1 - (1 - 0.4**3) ** (b - 1)


def test_linked_pairs(spark):
    rows = [(a, b, None) for a, b in SAME] + [(a, None, b) for a, b in OTHER] + [("n/a", "", " "), (None, None, None), ("Zoé Unique", "x" * 3000, "Guillaume Gamenon")]
    df = spark.createDataFrame(rows, "author string, owner string, approver string").withColumnRenamed("author", "name")
    got = {tuple(r) for r in N.linked_pairs(N.link_names(df, ["name", "owner", "approver"])).collect()}
    for a, b in SAME:
        assert (min(a, b), max(a, b)) in got, (a, b)
    for a, b in OTHER:
        assert (min(a, b), max(a, b)) not in got, (a, b)
    assert all(a < b for a, b in got)


def test_empty_table(spark):
    assert N.linked_pairs(N.link_names(spark.createDataFrame([], "author string"), ["author"])).count() == 0


def test_common_words_are_met(spark, monkeypatch):
    rows = [("Jean Martin",), ("Jean Martni",), ("P. Martin",), ("Philibert Martin",), ("Manu Martin",), ("Emmanuel Martin",), ("Ean Martin",), ("Dominique Clougropun",), ("Dominique Colugropuun",), ("Martin",), ("CSN Martin",), ("Comité de Sécurité Numérique Martin",), *((f"{g} Martin",) for g in ("Zoé", "Ugo", "Ines", "Karl"))]
    parsed = N.parse(spark.createDataFrame([*rows, *((x,) for pair in SAME for x in pair)], "name string").distinct().selectExpr("name", "1L AS n")).cache()
    edges = lambda: {tuple(r) for r in N.verified(parsed, N.candidates(parsed)).select("a", "b").collect()}
    monkeypatch.setattr(N, "COMMON", 10**9)
    want = edges()
    assert {("Jean Martin", "Jean Martni"), ("P. Martin", "Philibert Martin"), ("Emmanuel Martin", "Manu Martin"), ("Ean Martin", "Jean Martin")} <= want
    for common in (5, 0):
        monkeypatch.setattr(N, "COMMON", common)
        assert edges() == want


def test_long_chains_are_followed_to_their_end(spark):
    n = 90
    parsed = spark.createDataFrame([(f"nom {k:03}", n - k, ["nom", f"{k:03}"], []) for k in range(n)], "name string, n bigint, words array<string>, strong array<string>")
    edges = spark.createDataFrame([(f"nom {k:03}", f"nom {k + 1:03}", 1.0, False) for k in range(n - 1)], "a string, b string, score double, partial boolean")
    got = {r.name: r.centre for r in N.star_clusters(parsed, edges).collect()}
    assert len(got) == n and all(a == b or abs(int(a[4:]) - int(b[4:])) <= 2 for a, b in got.items())
