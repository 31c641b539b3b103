import pytest

from kerfline.llm import mixing as M


def test_weights_meet_targets_or_limits():
    tokens = {"a": 1000, "b": 100, "c": 10}
    targets = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.1, 10), "none": (0.1, 2)}
    w, budget, a = M.solve_weights(tokens, targets)
    assert budget == 1110 and "none" not in w and sum(w.values()) == pytest.approx(1)
    assert all(w[s] * budget <= tokens[s] * targets[s][1] * (1 + 1e-6) for s in w)
    assert a["a"] == 1 and a["b"] == 1 and 0 < a["c"] < 1 and w["c"] * budget == pytest.approx(100, rel=1e-6)
    assert w["a"] / w["b"] == pytest.approx(5 / 3)  # the others keep their targets in proportion
    w, budget, a = M.solve_weights(tokens, targets, budget=100)
    assert budget == 100 and set(a.values()) == {1.0} and w["c"] == pytest.approx(1 / 9)
    w, budget, a = M.solve_weights(tokens, targets, budget=10_000)  # more than all limits allow
    assert all(w[s] * budget <= tokens[s] * targets[s][1] * (1 + 1e-6) for s in w) and budget <= 1500
    goal = 0.7
    w, _, a = M.solve_weights(tokens, targets, target_entropy=goal)
    assert M.entropy(w) == pytest.approx(goal, abs=1e-3) and len(set(a.values())) == 1
    assert M.solve_weights({}, targets) == ({}, 0.0, {})


def test_a_tiny_source_bounds_itself_alone():
    tokens = {"large": 1_000_000, "tiny": 10}
    targets = {"large": (0.8, 2), "tiny": (0.2, 3)}
    w, budget, a = M.solve_weights(tokens, targets)
    assert budget == 1_000_010 and a["large"] == 1 and a["tiny"] < 0.5 and w["tiny"] * budget == pytest.approx(30, rel=1e-6)


def test_mixture(spark):
    rows = [(k, f"texte numéro {k} de la source principale", " Wiki-Interne" if k % 2 else "wiki_interne") for k in range(3000)]
    rows += [(5000 + k, f"petit texte {k}", "notes") for k in range(40)]
    rows += [(6000, None, "notes"), (6001, "", None), (6002, "sans cible", "autre"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS n_tokens", "2 AS copies")
    targets = spark.createDataFrame([("wiki_interne", 0.7, 3), ("notes", 0.01, 5), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixture, report = M.mixture_of(docs.drop("n_tokens", "copies"), targets)
    m, r = mixture.collect(), {x.source: x for x in report.collect()}
    limit = {"wiki_interne": 3, "notes": 5}
    assert len({x.doc_id for x in m}) == len(m) and all(1 <= x.copies <= limit[x.source] for x in m)
    assert r["wiki_interne"].actual_share == pytest.approx(70 / 71, abs=0.005) and r["notes"].actual_share == pytest.approx(1 / 71, abs=0.005)
    assert r["absent"].actual_share == 0 and r["notes"].records_without_tokens == 1
    assert r["notes"].tokens == sum(x.copies * x.n_tokens for x in m if x.source == "notes")
    again = M.mixture_of(docs.drop("n_tokens", "copies"), targets)[0].collect()
    assert sorted(m) == sorted(again)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = M.mixture_of(docs, targets)
    assert mixture.count() == 0 and report.count() == 1
