"""BPE against the tokenizers library, and the quality model on held-out rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mosaiq.llm import bpe, quality, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [
    (1, None), (2, ""), (2, ""), (None, "a<|endoftext|> b <|endoftext|><|endoftext|>\n\n  it's we'll  x"), (4, " \x85\xa0　​\x1c\x1dx\x1f y᠎ z \n\t q"),
    (5, "é" * 3000 + "a" * 5000 + " zz"), (6, "日本語 1234 १२३ 👍🏽 ½ ²\r\n\r\n end  "), (7, "word " * 40000), (8, "'s't 'S 're''ve  'd"),
]


def random_texts():
    r = random.Random(3)
    letters = "abE 12\n\t'’é½日👍.,-_\x0b\x85\xa0    stre"
    return [(100 + k, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for k in range(400)]


def test_encode_matches_library(spark, sf):
    rows = EDGE + random_texts() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, ids string").repartition(4)
    lib = Tokenizer.from_file(PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(df, PATH, 2000).collect()) == sorted(want)
    full = {r.doc_id: r for r in bpe.encode(df.filter("doc_id >= 1000"), PATH, 2000).collect()}
    for i, t in rows[-50:]:
        assert full[i].ids == lib.encode(t, add_special_tokens=False).ids and full[i].decoded == t


def test_lexicon_is_minimal():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["walking", "talking", "walked", "talked", "walk", "x"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    assert lexicon.find([*words, b"wal", b"walkingx", b"zz"]) == [*map(tuple, words.values()), None, None, None]
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(lexicon.final) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find([b"a"]) == [None]


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([(s >= 0.3) == q for q, s in held])
    print("AUC", auc, "accuracy", right, len(held))
    assert auc > 0.95 and right > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [(r.score, r.predicted) for r in quality.quality_digest(docs, none).collect()] == [(0.5, 1)] * 4
    assert quality.quality_digest(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(2, 1, 0), (2, None, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    scores = quality.quality_digest(docs, one).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)


def test_gam_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_gam(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert (1, 0) in model.pairs


@pytest.mark.parametrize("n", [1, 5, 199, 201, 400])
def test_long_merge(n):
    model = bpe.Bpe(PATH)
    r = random.Random(n)
    word = bytes(r.choice(b"aaabbthe er\xc3\xa9") for _ in range(n))
    ids = model.merge(word)
    assert ids == model._merge_long([model.first[b] for b in word])


def test_ids_that_are_no_numbers(spark):
    """They count as unknown; an empty table gives no rows."""
    df = spark.createDataFrame([("k1", "some text"), ("7", "more"), (None, None)], "doc_id string, text string")
    assert sorted(str(r.doc_id) for r in bpe.bpe_digest(df, PATH, 100).collect()) == ["7", "None", "None"]
    assert bpe.bpe_digest(df.limit(0), PATH, 100).count() == 0 and bpe.encode(df.limit(0), PATH, 100).count() == 0
