from pyspark.sql import functions as F

from kerfline.sources import files as S


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Politique\nversion: 2.1\n---\n# Objet\nTexte  de la poli-\ntique.\n", encoding="utf-8")
    (tmp_path / "sub" / "b.html").write_text("<html><style>x{}</style><p>Un &amp; deux</p><p>trois</p></html>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes("Données latin".encode("latin-1"))
    (tmp_path / "d.json").write_text("pas du json", encoding="utf-8")
    (tmp_path / "e_draft.txt").write_text("brouillon")
    (tmp_path / "f.bin").write_bytes(b"\x00\x01")
    (tmp_path / "vide.txt").write_text(" \n")
    (tmp_path / "nul.txt").write_text("")
    listing = S.scan(spark, str(tmp_path), excluded=["*_draft.*"])
    got = {r.path.rsplit("/", 1)[1]: r for r in S.parse(listing).collect()}
    assert set(got) == {"a.md", "b.html", "c.txt", "d.json", "vide.txt"}
    assert got["a.md"].metadata["version"] == "2.1" and "politique." in got["a.md"].content and "---" not in got["a.md"].content
    assert got["b.html"].content.split() == ["Un", "&", "deux", "trois"]
    assert got["c.txt"].content == "Données latin"
    assert got["d.json"].parsing_errors == ["no JSON"] and got["vide.txt"].parsing_errors == ["no text"]
    assert S.scan(spark, str(tmp_path), patterns=["*.md", "?.txt"]).count() == 2
    manifest = listing.where("file_name = 'a.md'").select("path", "length", "modified")
    assert S.unseen(listing, manifest).count() == 4


def test_markdown_parts(spark):
    text = "| a | b |\n|---|---|\n| 1 | |\n\n```python\nx = 1\n```\n[un](http://u) et [deux][r] [trois][absent]\n[r]: http://v\n[r]: http://w\n| seul |"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, t string")
    t = S.pipe_tables(df, "doc_id", "t").collect()
    assert [(r.start_line, r.data) for r in t] == [(0, [["a", "b"], ["1", ""]])]
    assert {(r.label, r.url) for r in S.links(df, "doc_id", "t").collect()} == {("un", "http://u"), ("deux", "http://w")}
    c = df.where("doc_id = 1").select(S.code_blocks(F.col("t")).alias("c")).first()["c"]
    assert [(x.language, x.code) for x in c] == [("python", "x = 1\n")]


def test_question_answer_lists(spark):
    rows = [
        (1, '[{"question": "A ?", "answer": "B"}, {"q": "C ?", "response": "D"}, {"q": "sans réponse"}]'),
        (2, '{"faq": {"accès": [{"question": "E ?", "a": "F"}]}}'),
        (3, '{"questions": [{"id": "X9", "question": "G ?", "answer": "H"}]}'),
        (4, "pas du json"),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {(r.k, r.id, r.question, r.answer, r.category) for r in S.faq_json(df, "k", "t").collect()}
    assert got == {(1, "Q1", "A ?", "B", None), (1, "Q2", "C ?", "D", None), (2, "accès-Q1", "E ?", "F", "accès"), (3, "X9", "G ?", "H", None)}
    text = "Q: Un ?\nR: Premier\nsuite\n\nQuestion 2 : Deux ?\nRéponse : Second\n"
    t = S.faq_text(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("pair_no").collect()
    assert [(r.question, r.answer) for r in t] == [("Un ?", "Premier\nsuite"), ("Deux ?", "Second")]
