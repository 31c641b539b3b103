import pytest
from pyspark.sql import functions as F

from kerfline.llm.splitting import own_lengths, piece_table, split_files


def check(pieces, text, limit, overlap):
    at = 0
    for j, p in enumerate(sorted(pieces, key=lambda p: p["piece_no"])):
        assert p["piece_no"] == j and p["n_chars"] <= limit
        assert p["piece"] == text[p["start"] : p["start"] + p["n_chars"]]
        assert p["start"] == (0 if j == 0 else at - overlap)
        at = p["start"] + p["n_chars"]
    assert at == len(text)


TEXTS = {
    1: ("Une phrase assez longue, avec une virgule. " * 6 + "\n\n") * 40,
    2: "x" * 2500,
    3: "é" * 1500,
    4: "ligne sans point\n" * 300,
    5: None,
    6: "",
    7: "court",
    8: "a" * 300,
    9: "😀 emoji " * 400,
}


@pytest.mark.parametrize("span", [700, 65536])
def test_pieces_cover_items_with_exact_overlap(spark, span):
    df = spark.createDataFrame([*TEXTS.items(), (2, TEXTS[2])], "id int, x string").withColumn("l", F.lit(300)).withColumn("o", F.lit(40)).withColumn("piece", F.lit("clash"))
    rows = piece_table(df, ["id"], "x", "l", "o", span=span).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {1, 2, 3, 4, 9}
    for k, v in by.items():
        check(v, TEXTS[k], 300, 40)
    first = sorted(by[1], key=lambda r: r["piece_no"])[0]
    assert first["piece"].endswith(("\n", ". "))
    for r in by[3]:  # never before a combining mark
        assert not r["piece"].startswith("́") or r["piece_no"] > 0


def test_no_limit_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 50, None, 3)], "id int, x string, l int, o int")
    assert piece_table(df, ["id"], "x", "l", "o").count() == 0
    assert piece_table(df.where("id < 0"), ["id"], "x", "l", "o").count() == 0


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    text = ("Première phrase de la page. Deuxième, plus courte ! " * 3 + "\n") * 200
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("é" * 5000, encoding="utf-8")
    (tmp_path / "c.txt").write_text("", encoding="utf-8")
    rows = split_files(spark, str(tmp_path), 400, 50, span=3001).collect()
    for name, want in (("a.txt", text), ("b.txt", "é" * 5000)):
        check([r for r in rows if r["path"].endswith(name)], want, 400, 50)
    assert not [r for r in rows if r["path"].endswith("c.txt")]


def test_giant_item_is_cut_in_several_tasks(spark):
    text = "Une phrase de la page, avec une virgule. Une autre !\n"
    df = spark.range(1).selectExpr("id", f"repeat('{text}', 40000) AS x", "4000 AS l", "200 AS o")
    got = piece_table(df, ["id"], "x", "l", "o").withColumn("task", F.spark_partition_id()).collect()
    check(got, text * 40000, 4000, 200)
    assert len({r.task for r in got}) > 1


def test_lengths_come_back_from_the_pieces(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id int, x string").selectExpr("*", "300 AS l", "40 AS o")
    got = {r.id: (r.n_chars, r.longest <= 300) for r in own_lengths(piece_table(df, ["id"], "x", "l", "o", False, span=700), ["id"]).collect()}
    assert got == {k: (len(TEXTS[k]), True) for k in (1, 2, 3, 4, 9)}
