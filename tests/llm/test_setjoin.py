"""The set join against all pairs."""

import random
import re

import numpy as np
import pytest

from mosaiq.llm import setjoin


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in setjoin.jaccard_components(df).collect())


def made(seed, n=220):
    r = random.Random(seed)
    fresh = lambda k: [r.choice("abcdefghij") * r.randrange(1, 4) + str(r.randrange(300)) for _ in range(k)]
    passage, rows, pool = fresh(60), [], []
    for k in range(n):
        kind = r.random()
        if kind < 0.5 and pool:
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = fresh(1)[0]
        elif kind < 0.7:
            w = fresh(r.randrange(5, 40)) + passage + fresh(r.randrange(5, 30))
        else:
            w = fresh(r.randrange(1, 120))
        pool.append(w)
        rows.append((k * 7 % n, r.choice([" ", "\n", "  ", "\x0b"]).join(w)))
    extra = [(None, None), (500, ""), (501, " \n"), (502, "One two"), (503, "one  TWO"), (None, rows[0][1]), (rows[5][0], rows[5][1]), (504, "É one"), (505, "é one"), (506, "x " * 5000)]
    return rows + extra


@pytest.mark.parametrize(("seed", "share"), [(1, 4000), (2, 7)])
def test_against_all_pairs(spark, monkeypatch, seed, share):
    monkeypatch.setattr(setjoin, "SHARE_SETS", share)
    monkeypatch.setattr(setjoin.packed, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(setjoin.packed, "BUCKET_ROWS", 2000)
    rows = made(seed)
    assert got(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int").repartition(3)) == brute(rows)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_order_is_the_same_in_all_blocks(spark):
    near, far, want = [], [], {}
    for k in range(60):
        shared = [f"s{k}x{j}" for j in range(9)]
        # x and y are linked across blocks; z shares much with x in its block but isn't linked
        x, y, z = [*shared, f"x{k}"], [*shared, f"y{k}"], [*shared[:7], *(f"z{k}x{j}" for j in range(5))]
        near += [(3 * k, " ".join(x)), (3 * k + 2, " ".join(z))]
        far.append((3 * k + 1, " ".join(y)))
        want |= {3 * k: 3 * k, 3 * k + 1: 3 * k, 3 * k + 2: 3 * k + 2}
    df = spark.createDataFrame(spark.sparkContext.parallelize([near, far], 2).flatMap(list), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in setjoin.jaccard_components(df, words=1).collect()} == want


def test_derived_answers():
    r = np.random.default_rng(0)
    base = [np.sort(r.choice(2**40, 50, replace=False)).astype(np.uint64) for _ in range(4)]
    sets = []
    for b in base:
        for _ in range(30):
            x = b.copy()
            x[r.choice(50, r.integers(0, 12), replace=False)] += np.uint64(1)
            sets.append(np.unique(x))
    sets.sort(key=len)
    root = setjoin.link_sets(sets, 80)
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = want[a], want[b]
                want = [new if w == old else w for w in want]
    assert len(set(zip(root.tolist(), want, strict=True))) == len(set(want)) == len(set(root.tolist()))


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, "other words"), (4, None), (5, ""), (None, text), (3, "other words")]
    kept = setjoin.keep_one(spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, nth string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 4, 5]


def test_keep_one_keeps_rows_as_they_are(spark):
    """Equal ids of different texts, null ids and texts, clashing names and types, copies: one row of each component."""
    import datetime

    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    long = " ".join(f"w{k}" for k in range(40))
    rows = [
        (1, long, at, "a", 1), (1, "other words that stand here alone", at, "b", 2), (2, long + " more", None, "c", None), (None, long, at, "d", 4),
        (3, None, at, "e", 5), (3, None, at, "e", 5), (4, "", None, "f", 6), (None, "only this one has no number at all", at, "g", 7), (None, "only this one has no number at all", at, "h", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept timestamp, nth string, rest int").repartition(2)
    got = setjoin.keep_one(df)
    assert got.schema == df.schema
    names = sorted(r.nth for r in got.collect())
    assert names in (["a", "b", "e", "e", "f", "g"], ["a", "b", "e", "e", "f", "h"])
    assert {r.nth: (r.doc_id, r.text, r.kept, r.rest) for r in got.filter("nth in ('a', 'b', 'f')").collect()} == {r[3]: (r[0], r[1], r[2], r[4]) for r in rows if r[3] in "abf"}


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_blocks_in_one_worker(spark):
    """What is made of blocks where they are packed sees the same blocks, and a task has one Python worker for both."""
    import pyarrow as pa

    from mosaiq.llm import packed

    def run(batches):
        for batch in batches:
            assert batch.num_rows == 1 and "rest" not in batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("data")], ["block", "ids", "data"])

    docs = spark.createDataFrame([(k, "x y " * k, "z" * k) for k in range(60)] + [(None, None, None)], "doc_id bigint, text string, lang string").repartition(3)
    for carry in (False, True):
        one = packed.pack_blocks(docs, carry, run, "block bigint, ids binary, data binary")
        assert sorted(one.collect()) == sorted(packed.pack_blocks(docs, carry).select("block", "ids", "data").collect())
        assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
