"""Token counts against the sentencepiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from mosaiq.llm import queries, tokencounts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencounts.Counter(tokencounts.Pieces(PATH))


def test_random_texts(counter):
    r = random.Random(1)
    letters = "abE 12\n\t'’é½日👍.,-_\x0b\x85\xa0▁▁  stre()\r;=><{}$²\x00￾"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "  ", " a ", "<s></s><unk><0x0A>", "▁", "a▁ b"]
    assert counter.count(texts) == [len(x) for x in LIB.encode(texts)]


def test_long_words(counter):
    r = random.Random(2)
    texts = [" " * 3000, " " * 4000 + "a" + " " * 900, "a" * 4000, "ab" * 2000, "=-" * 1000, "é" * 4990, "".join(r.choice("abcdefgh") for _ in range(4000))]
    texts += ["a" * 70_000, " " * 70_000, "".join(r.choice("abcdefgh") for _ in range(50_000)), "word " * 60_000]
    assert counter.count(texts) == [len(x) for x in LIB.encode(texts)]


def test_both_ways_of_merging(counter):
    r = random.Random(3)
    words = ["".join(r.choice("aeinrst▁") for _ in range(r.randrange(1, 120))) for _ in range(400)]
    assert counter.merge(words).tolist() == [counter.merge_long(w) for w in words]


def test_memory_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(tokencounts, "MEMO", 50)
    small, texts = tokencounts.Counter(counter.pieces), [" ".join(f"w{k}x{j}" for j in range(15)) for k in range(60)]
    monkeypatch.setattr(tokencounts, "BATCH", 1)
    assert [n for t in texts for n in small.count([t])] == [len(x) for x in LIB.encode(texts)] and len(small) < 120


def test_rows(spark):
    """Null, empty, repeated and long texts, ids of any type, and columns of clashing names."""
    rows = [(None, "no id", 1), (2**60 + 1, None, 2), (3, "", 3), (3, "", 3), (4, "x " * 9000, 4), (5, "é日👍", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, tokencounts.count_tokens(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(LIB.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    strings = tokencounts.count_tokens(df.selectExpr("'k' || doc_id AS doc_id", "text"), PATH)
    assert {r.doc_id for r in strings.collect()} == {None, f"k{2**60 + 1}", "k3", "k4", "k5"}
    assert tokencounts.count_tokens(df.limit(0), PATH).count() == 0


def test_documents(spark, sf):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        n = len(LIB.encode(r.text or ""))
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 4096)
