import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kerfline.operators import grading, retrieval, strips, structure
from kerfline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, int | bool | str) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()), key=repr)
    assert got == want


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "context"),
    [("La norme ISO 27001 exige quoi ?", "iso_27001"), ("Le RGPD et le DPO", "rgpd_gdpr"), ("corporate", "incident_response"), ("", "compliance_general"), ("configuration du firewall", "technical_audit")],
)
def test_audit_context(spark, query, context):
    assert one(spark, strips.audit_context(F.col("q")), q=query) == context


@pytest.mark.parametrize(("text", "bonus"), [("A.9 AC-2 CIS 5", 0.10), ("A.9.1 AC-2", 0.0), ("A.12.6 RA-5", 0.05), ("A.9 A.9 A.9 AC-2 CIS 5", 0.15)])
def test_mapped_controls(spark, text, bonus):
    assert one(spark, strips.mapped_controls(F.col("t")), t=text) == pytest.approx(bonus)


@pytest.mark.parametrize(("text", "level"), [("ne doit pas", "mandatory"), ("interdit", "forbidden"), ("devrait", "recommended"), ("peut", "optional"), ("rien", "informational")])
def test_obligation(spark, text, level):
    assert one(spark, strips.obligation(F.col("t")), t=text) == level


def test_category_and_signature(spark):
    assert one(spark, strips.category(F.col("t")), t="Le système doit utiliser le chiffrement") == "policy"
    assert one(spark, strips.signature(F.col("t")), t="Le chat mange la souris grise") == "chat grise mange souris"


def test_combined_scores(spark):
    mean, sure = grading.combine([(F.lit(0.5), 0.30), (F.lit(0.6), 0.20), (F.lit(0.7), 0.25)])
    row = spark.range(1).select(mean.alias("m"), sure.alias("c")).first()
    assert row["m"] == pytest.approx(0.593333, abs=1e-6) and row["c"] == pytest.approx(0.986667, abs=1e-6)


def test_answer_confidence(spark):
    x = grading.answer_confidence(F.lit(0.8), F.lit(5), F.lit("x" * 300), F.lit(0.7))
    assert spark.range(1).select(x.alias("x")).first()["x"] == pytest.approx(0.875)


def test_concepts(spark):
    got = one(spark, F.to_json(grading.concepts(F.col("q"))), q="Comment fonctionnent les transformers ?")
    assert '"comment","weight":0.3' in got and '"fonctionnent","weight":0.8' in got and '"transformers","weight":1.0' in got


def test_top_k_equals_brute_force_and_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[7] = v[3]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id bigint, e array<float>")
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in retrieval.top_k(df.where("id % 10 = 3"), df, "id", "e", 4).collect()}
    w = v.astype(np.float64)
    for q in range(3, 90, 10):
        d = ((w - w[q]) ** 2).sum(1)
        want = sorted(range(90), key=lambda i: (round(d[i], 12), i))[:4]
        assert [got[q, k + 1] for k in range(4)] == want


def test_index_refuses_other_sizes(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    retrieval.save_index(df, str(tmp_path / "i"), 2)
    assert retrieval.load_index(spark, str(tmp_path / "i")).count() == 1
    with pytest.raises(Exception, match="hasn't 3"):
        retrieval.save_index(df, str(tmp_path / "i"), 3)


def test_structure_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "texte sans titre"), (4, "# A\nx\n\n## B\ny\n# C"), (4, None)], "doc_id bigint, content string")
    s = {(r.doc_id, r.title): (r.level, r.content) for r in structure.sections(df, "doc_id", "content").collect()}
    assert s == {(4, "# A"): (1, "x"), (4, "## B"): (2, "y"), (4, "# C"): (1, "")}
    h = {(r.title): r.parent_line for r in structure.headings(df, "doc_id", "content").collect()}
    assert h == {"A": None, "B": 0, "C": None}
    assert structure.sections(df.where("doc_id > 9"), "doc_id", "content").count() == 0
