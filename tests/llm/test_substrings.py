"""Repeated substrings against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from mosaiq.llm import substrings


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, length=400):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, length).collect())


def test_cover():
    c, v = substrings.COVER, substrings.PERIOD
    assert {(a - b) % v for a in c for b in c} == set(range(v))


@pytest.mark.parametrize("seed", range(3))
def test_planted(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings.packed, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(substrings.packed, "BUCKET_ROWS", 3000)
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    pool = [word(r.choice([300, 390, 399, 400, 401, 450, 540, 700, 1500])) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [word(r.randrange(0, 300))]
        for _ in range(r.randrange(3)):
            p = r.choice(pool)
            a = r.randrange(0, 60) if r.random() < 0.7 else 0
            parts += [p[a : len(p) - r.randrange(0, 60)], word(r.randrange(0, 200))]
        rows.append((k, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "x" * 400), (203, "y" * 401), (None, rows[3][1]), (3, rows[3][1]), (204, "ab" * 2000), (205, "é" * 200), (206, "é" * 199 + "zz" + "é" * 199)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, block int").repartition(3)
    assert got(df) == brute(rows, 400)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()], 400)


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id bigint, text string")) == []
    kept = substrings.remove_repeats(spark.createDataFrame([(1, "a" * 500), (2, "b")], "doc_id bigint, text string"), texts=True).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in kept) == [(1, b""), (2, b"b")]


def test_short_passages_are_counted(spark):
    """A passage of 290 bytes that stands in two documents isn't removed but counted in both, and nothing in others."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = [(k, word(r.randrange(100, 900))) for k in range(40)]
    passage = word(290)
    rows += [(100, word(77) + passage + word(50)), (101, word(333) + passage)]
    out = {x.doc_id: (x.n_removed, x.n_short > 0) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: (0, i >= 100) for i, _ in rows}
