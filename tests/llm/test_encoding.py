import pytest

from kerfline.llm import encoding as E

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "\n\n", "Bonjour l'équipe, voici 3 fichiers.", "a  b\xa0 c \n d", "<|endoftext|> texte", "é" * 3000, "x" * 5001, "aaaa " * 90, "日本語のテキスト" * 300,
    "I'll don't we're 'S", "tab\tet\r\nretour  ", " séparateur", "0123456789" * 40, "😀👩‍👩‍👧 emoji", "a \x1c b \x85 c ", "áé", "Bonjour l'équipe, voici 3 fichiers.",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(E.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "1 AS _text")
    got = {r.doc_id: r.ids for r in E.encode(df).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == reference.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


def test_counts_and_forgetting(spark, monkeypatch):
    monkeypatch.setattr(E, "REMEMBERED_WORDS", 3)
    e = E.Encoder(E.DEFAULT_VOCABULARY)
    whole = e.encode(TEXTS).to_pylist()
    again = [e.encode([t]).to_pylist()[0] for t in TEXTS]
    assert whole == again and list(e.count(TEXTS)) == [len(x) for x in whole]


def test_long_rows_equal_short_rows(monkeypatch):
    words = ["abcabcabc" * 12, "aaaaaaaaaaaa", " protection", "é" * 40]
    a = E.Encoder(E.DEFAULT_VOCABULARY).encode_words(words)
    monkeypatch.setattr(E, "BUCKETS", ())
    b = E.Encoder(E.DEFAULT_VOCABULARY).encode_words(words)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_empty_table(spark):
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
