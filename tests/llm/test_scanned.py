import numpy as np

from kerfline.llm import scanned as S

BODY = "Le comité de pilotage doit documenter les risques résiduels du portail avant la revue annuelle et prévenir la personne responsable du dispositif de sauvegarde. "
HEAD = "Recueil des procédures Tubranmont — Diffusion restreinte"
PAGE = [
    "La procédure prévoit que le comité doit docu-",
    "menter les risques du portail avant la revue annuelle",
    "et prévenir la pers0nne responsable du d i s p o s i t i f",
    "de sauvegarde avec le comite' de pilotage du portail.",
    "Le comité su ivra les risques résiduels de sous-",
    "traitance avant la revue annuelle du dispositif et le",
]


def corpus():
    plain = [(k, BODY * 3 + "La sous-traitance reste soumise à la revue ; le comité suivra les risques résiduels de la procédure, elle prévoit que tout soit vu. " * 6, None) for k in range(1, 21)]
    scanned = "\n".join(line for n in (1, 2, 3) for line in [HEAD, *(x.replace("comité", "comité " + "ABC"[n - 1] * n) for x in PAGE), "Page %d sur 3" % n])
    return [*plain, (50, scanned, ["Ligne rejetée : « Le com1té de pilo-\ntage doit »", "Image ignorée page 2"]), (51, None, None), (52, "", []), (53, " \n ", [None]), (54, "x" * 50_000, None)]


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, content string, parsing_errors array<string>").selectExpr("*", "'a' AS noise", "1 AS pos")
    return S.find_noise(df)


def test_places(spark):
    rows = corpus()
    got = {(r.doc_id, r.field, r.pos, r.noise) for r in found(spark, [*rows, rows[20]]).collect()}
    want = set()
    for p in range(3):
        at = p * 8
        want |= {(50, "content", at, "running_line"), (50, "content", at + 7, "page_number"), (50, "content", at + 1, "cut_word")}
        want |= {(50, "content", at + k, "misread") for k in (3, 4, 5)}
    want |= {(50, "parsing_errors", 0, "cut_word"), (50, "parsing_errors", 0, "misread")}
    assert want <= got
    assert not {x for x in got - want if x[3] != "misread"} and len(got - want) <= 1


def test_hyphen_of_a_word_is_no_cut(spark):
    got = {(r.pos, r.noise) for r in found(spark, corpus()).where("doc_id = 50 AND field = 'content'").collect()}
    assert (5, "cut_word") not in got


def test_repair(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, content string, parsing_errors array<string>")
    rows = S.repair(df).collect()
    t = {r.doc_id: r.text for r in rows}
    assert next(r.messages for r in rows if r.doc_id == 50) == ["Ligne rejetée : « Le comité de pilotage doit »", "Image ignorée page 2"]
    assert len(t) == 25 and t[51] is None and t[54] == "x" * 50_000
    assert HEAD not in t[50] and "Page 2" not in t[50] and "documenter les risques" in t[50] and "personne responsable du dispositif" in t[50]
    assert t[1] == corpus()[0][1]


def test_empty_table(spark):
    assert found(spark, corpus()).where("false").count() == 0
    df = spark.createDataFrame([], "doc_id bigint, content string, parsing_errors array<string>")
    assert S.find_noise(df).count() == 0


def test_page_values():
    assert [S.page_value(x) for x in ("12", "iv", "XI", "l2", "S")] == [12, 4, 11, 12, 5]


def test_verdicts_stay_when_the_counts_grow():
    counts = {"périmètre": 4000, "pe'rimètre": 5, "procédure": 9000, "procédurc": 20, "conformément": 3000, "conformémcnf": 2, "le": 50_000, "pe": 40, "rimètre": 1, "continuité": 2000, "conti": 1, "nuifé": 1}
    for factor in (1, 10, 1000):
        r = S.Reader({w: n * factor for w, n in counts.items()})
        assert r._accent("pe'rimètre") == "périmètre" and r._accent("l'office's") is None
        assert r.misread("procédurc") == ("procédure", "plain") and r.misread("conformémcnf") == ("conformément", "plain")
        assert r._broken("conti", "nuifé")[0] == "continuité"
        assert r.misread("procédure") is None


def test_fragments_are_not_counted(spark):
    text = "le pe'rimètre et l'e'quipe ont docu-\nmenté la sous-traitance\n  - du périmètre"
    got = {r.w: r.n for r in S.word_counts(spark.createDataFrame([(text,)], "t string"), "t").collect()}
    assert got["pe'rimètre"] == 1 and got["e'quipe"] == 1 and got["périmètre"] == 1 and got["sous-traitance"] == 1
    assert not got.keys() & {"pe", "rimètre", "quipe", "docu", "menté"}


def test_replacements_keep_to_words():
    assert S.corrected("Les lcs salcs", "lcs", "les") == "Les les salcs" and S.corrected("aud1t, l'aud1t", "aud1t", "audit") == "audit, l'audit"
    assert S.corrected("Acha†s", "Acha†s", "achats") == "Achats"


def test_pages_without_other_traces_are_searched(spark):
    rows = [*corpus(), (60, "La pr0cédure est vue par le c0mité", None), (61, "Le comité suivra la proccdure du portail\navant la revue annuelle", None)]
    got = {(r.doc_id, r.pos, r.meant) for r in found(spark, rows).where("doc_id >= 60").collect()}
    assert {(60, 0, "procédure"), (60, 0, "comité")} <= got


def test_verdicts_stay_when_the_corpus_doubles(spark):
    rows = corpus()
    more = [*rows, *((k + 1000, *rest) for k, *rest in rows)]
    one, two = ({(r.doc_id, r.field, r.pos, r.noise) for r in found(spark, x).where("doc_id < 1000").collect()} for x in (rows, more))
    assert one == two


def test_surroundings_decide_between_words_of_like_counts(spark):
    """``vcnte`` may be ``vente`` or ``vinte``; the words around tell."""
    sell = "Le client règle la vente avec le vendeur du magasin contre facture. "
    other = "Le moine récite chaque vinte devant la chapelle du couvent ancien. "
    rows = [(k, sell * 15 if k % 2 else other * 15, None) for k in range(40)] + [(100, "Le client règle la vcnte avec le vendeur du magasin contre facture.", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, content string, parsing_errors array<string>")
    known = S.frequent_words(df, "content")
    near = S.Surroundings(*S.skip_gram(df, "content", known), known)
    at = near.mean("client règle vendeur magasin".split(), "vcnte")
    import numpy as np

    sell_rank, other_rank, unknown = near.ranks(np.array([at, at, at], np.float32), ["vente", "vinte", "inconnu"])
    assert sell_rank > other_rank and unknown == 0.5
    note = [(100, "content", 0, "misread", "vcnte", ["vinte", "vente"], [2.1, 2.0], "plain", [float(x) for x in at])]
    got = S.decided(spark.createDataFrame(note, S.NOTE), known, near).first()
    assert got.meant == "vente"
    assert S.decided(spark.createDataFrame(note, S.NOTE), known, near, 0.0).first().meant == "vinte"


def test_vectors_stay_when_the_corpus_grows(spark):
    """The surroundings of a word are the same in a table of many times the rows."""
    df = spark.createDataFrame(corpus(), "doc_id bigint, content string, parsing_errors array<string>")
    known = S.frequent_words(df, "content")
    one, many = (S.skip_gram(x, "content", {w: n * f for w, n in known.items()}) for f, x in ((1, df), (300, df.crossJoin(spark.range(300)).drop("id"))))
    assert one[0] == many[0] and "comité" in one[0]
    near = [v @ v.T for _, v in (one, many)]
    assert np.allclose(*near, atol=1e-3 * np.abs(near[0]).max())


def test_pairs_are_counted_whole(spark, monkeypatch):
    rows = [("un deux trois quatre trois trois",), ("quatre",), (None,), ("",), ("deux trois",)]
    df = spark.createDataFrame(rows, "t string").repartition(3)
    words, want = ["deux", "quatre", "trois"], np.zeros((3, 3), int)
    for t in (["deux", "trois", "quatre", "trois", "trois"], ["quatre"], ["deux", "trois"]):
        for a in range(len(t)):
            for b in range(len(t)):
                want[words.index(t[a]), words.index(t[b])] += 0 < abs(a - b) <= 2
    for at_once in (1, 500_000):
        monkeypatch.setattr(S, "WORDS_AT_ONCE", at_once)
        monkeypatch.setattr(S, "CELLS", at_once)
        assert (S.product(S.word_pairs(df, "t", words, 2), np.eye(3)) == want).all()
