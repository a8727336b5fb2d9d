"""Fuzzy line deduplication against plain comparisons."""

import random

import numpy as np
import pytest

from mosaiq.llm import lines


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(600):
        a = bytes(r.choice(b"abc ") for _ in range(r.randrange(30)))
        b = bytes(r.choice(b"abc ") for _ in range(r.randrange(30))) if r.random() < 0.5 else bytes(x for x in a if r.random() < 0.8)
        assert lines.edit_distance(a, b) == plain_distance(a, b)
        assert lines.similar(a, b, 80) == (100 * plain_distance(a, b) <= 20 * max(len(a), len(b)))
        found = lines.edit_distances(b, [a, b, a + b], 80) if b else []
        for x, d in zip((a, b, a + b), found, strict=False):
            most, own = 20 * max(len(x), len(b)), plain_distance(x, b)
            assert d == own or 100 * own > most and 100 * d > most or 100 * d > most and own >= d


@pytest.mark.parametrize("words", [1, 3, 5, 7, 9])
def test_simhash(words):
    r = np.random.default_rng(2)
    h = r.integers(0, 2**63, (words, 50), dtype=np.uint64) * np.uint64(3)
    bits = np.unpackbits(h.view(np.uint8).reshape(words, 50, 8), axis=2).sum(0, dtype=int)
    assert np.array_equal(lines.simhash(*h), np.packbits(2 * bits > words, axis=1).view(np.uint64).ravel())


def test_changed_words_leave_blocks():
    """Equal words make equal blocks, in any order and batch; three of six anchors may change; frequent words are no anchors."""
    r = random.Random(4)
    w = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(40)]
    a, b = " ".join(w).encode(), " ".join(reversed(w)).encode()
    of, sim = lines.blocks_of_lines([a, b"other words entirely here and there, but many of them too, so many", b])
    assert set(sim[of == 0].tolist()) == set(sim[of == 2].tolist()) and not set(sim[of == 0].tolist()) & set(sim[of == 1].tolist())
    assert sorted(sim[of == 0].tolist()) == sorted(lines.blocks_of_lines([a])[1].tolist())
    assert len(sim[of == 0]) == 20
    frequent = np.sort(lines.Words(" ".join(w[:36]).encode() + b"\n").hash)
    assert len(lines.blocks_of_lines([a], frequent)[1]) == 4


def test_lines_of_frequent_words_have_blocks():
    """Nine words and more of which all, or all but two, are frequent: a line shares a block with what one changed word makes of it."""
    r = random.Random(7)
    w = ["".join(r.choice("abcdefghij") for _ in range(r.choice([2, 3, 6]))) for _ in range(40)]
    rare = ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(40)]
    frequent = np.unique(lines.Words(" ".join(w).encode() + b"\n").hash)
    for k in range(100):
        a = r.sample(w, r.randrange(9, 20)) + r.sample(rare[:20], k % 3)
        b, c = list(a), list(a)
        b[r.randrange(9)] = r.choice(w)
        c[r.randrange(9)] = r.choice(rare[20:])
        of, sim = lines.blocks_of_lines([" ".join(x).encode() for x in (a, b, c)], frequent)
        sets = [set(sim[of == j].tolist()) for j in range(3)]
        assert len(sets[0]) == (of == 0).sum() and sets[0] & sets[2]
        assert len(set(b)) <= lines.FEW or sets[0] & sets[1]


def test_aligned():
    """Aligned by words, a line's cost is never below its distance, and exact where whole words go or come."""
    r = random.Random(8)
    for _ in range(500):
        a = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 9))]
        b = [x for x in a if r.random() < 0.8] or [b"a"]
        b.insert(r.randrange(len(b) + 1), r.choice([b"cdefg", *a]))
        x, y = b" ".join(a), b" ".join(b)
        assert lines.aligned(x, y) >= plain_distance(x, y) and lines.aligned(x, x) == 0
        assert lines.aligned(x, x + b" cdefg") == lines.aligned(b"cdefg " + x, x) == 6


def test_stars():
    """Fewer edges connect the same nodes, and a node points to one other at most."""
    import pyarrow as pa

    def parts(edges):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in root if find(y) == find(x)) for x in root}

    r = random.Random(9)
    for _ in range(50):
        rows = [(r.randrange(-40, 40), [r.randrange(-40, 40) for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 40))]
        batch = pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in rows], pa.int64()), "hubs": pa.array([h for _, h in rows], pa.list_(pa.int64()))})
        (out,) = lines.stars(iter([batch]))
        found = list(zip(*out.to_pydict().values(), strict=True))
        assert len({a for a, _ in found}) == len(found)
        assert parts(found) == {p for p in parts([(x, y) for x, h in rows for y in h]) if len(p) > 1}


def test_words():
    """Words by place, line and hash, whatever their length and wherever a chunk ends; lines by their words."""
    text = "one  Two\n\n THREE,é-x\n---\none two\n".encode().translate(lines.FOLD)
    w = lines.Words(text)
    assert [text[a:b] for a, b in zip(w.start, w.end, strict=True)] == [b"one", b"two", b"three", "é".encode(), b"x", b"one", b"two"]
    number, one, two = w.lines()
    assert number.tolist() == [0, 2, 4] and one[0] == one[2] != one[1] and two[0] == two[2]
    r = random.Random(1)
    long = b" ".join(bytes(r.choice(b"abc") for _ in range(r.choice([1, 5, 3000]))) for _ in range(300)) + b"\n"
    whole, old = lines.Words(long).hash, lines.CHUNK
    try:
        lines.CHUNK = 1000
        assert np.array_equal(lines.Words(long).hash, whole)
    finally:
        lines.CHUNK = old
    assert len(lines.Words(b"\n\n").hash) == 0


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    base = [[word() for _ in range(r.choice([1, 3, 12, 30, 60]))] for _ in range(60)]
    rows = []
    for k in range(80):
        out = []
        for _ in range(r.randrange(6)):
            w = list(r.choice(base))
            if r.random() < 0.5 and len(w) > 10:
                w[r.randrange(len(w))] = word()
            out.append(r.choice(["", "  ", "* "]) + " ".join(w).capitalize() + r.choice(["", ".", "!!"]))
        rows.append((k * 13 % 80, "\n".join(out)))
    return rows + [(None, None), (100, ""), (101, "\n\n"), (102, "---\n***\n---"), (103, "one\none\nOne!"), (None, rows[2][1]), (rows[4][0], rows[4][1]), (104, "x" * 40000), (105, "Él")]


def brute(rows):
    """The groups of lines if all pairs are compared by their edit distance alone."""
    found = [(r, k, lines.normalise(x.encode())) for r, (_, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n")) if t]
    found = [f for f in found if f[2]]
    root = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][2], found[b][2]
            if root[a] != root[b] and abs(len(x) - len(y)) * 5 <= max(len(x), len(y)) and (x == y or 5 * plain_distance(x, y) <= max(len(x), len(y))):
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    return found, root


@pytest.mark.parametrize(("seed", "share"), [(1, 4000), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, share):
    monkeypatch.setattr(lines, "SHARE_LINES", share)
    monkeypatch.setattr(lines.packed, "BLOCK_BYTES", 3000)
    rows = made(seed)
    df = spark.createDataFrame([(i, t, "a\"b", [1], 5) for i, t in rows], "doc_id bigint, text string, lang string, removed array<int>, block int").repartition(3)
    got = lines.dedup_lines(df).collect()
    assert len(got) == len(rows) and {r.lang for r in got} == {"a\"b"} and got[0].__fields__ == ["doc_id", "text", "lang", "block", "n_lines", "removed"]
    found, root = brute(rows)
    # one of each group stays, in the document of the smallest id
    kept = [lines.normalise(x.encode()) for r in got if r.text for x in r.text.split("\n")]
    assert sum(map(bool, kept)) == len(set(root))
    least = {}
    for (r, _, _), g in zip(found, root, strict=True):
        i = rows[r][0]
        least[g] = min(least.get(g, 10**9), 10**9 if i is None else i)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).update(lines.normalise(x.encode()) for x in (r.text or "").split("\n"))
    for g, i in least.items():
        if i < 10**9:
            assert by_id[i] & {f[2] for f, x in zip(found, root, strict=True) if x == g}
    assert {r.doc_id for r in got if r.text is None} == {None}
    assert next(r.text for r in got if r.doc_id == 102) == "---\n***\n---"


def test_long_chains_are_dealt_in_proportion(spark, monkeypatch):
    """Lines that share a block with the next one each, but aren't alike, are dealt out twice at most, however many are connected."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(lines, "SHARE_LINES", 10)
    r, cut, links = random.Random(11), lines.cut, []
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(11))
    families = [" ".join(word() for _ in range(3)) for _ in range(121)]
    texts = [f"{x} {y}" for x, y in zip(families, families[1:])]  # noqa: B905
    # the last one has a near copy
    df = spark.createDataFrame(list(enumerate([*texts, texts[-1][:-1] + "z"])), "doc_id bigint, text string")
    monkeypatch.setattr(lines, "cut", lambda df: links.append(df) or cut(df))
    got = lines.dedup_lines(df).filter("size(removed) > 0").collect()
    assert [x.doc_id for x in got] == [120]
    (found,) = (x for x in links if x.columns[:2] == ["a", "b"])
    # what the comparisons read
    read = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, found._jdf.queryExecution().analyzed().children().head())
    n = DataFrame(read, spark).count()
    assert 121 <= n <= 2 * 121


@pytest.mark.parametrize(("words", "changes", "least"), [(50, 1, 0.99), (50, 5, 0.95), (30, 3, 0.95), (20, 2, 0.95), (12, 1, 0.95), (100, 18, 0.9)])
def test_recall_of_changed_words(words, changes, least):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 9)))
    both = []
    for _ in range(400):
        w = [word() for _ in range(words)]
        both.append(" ".join(w).encode())
        for k in r.sample(range(words), changes):
            w[k] = word()
        both.append(" ".join(w).encode())
    of, sim = lines.blocks_of_lines(both)
    sets = [set() for _ in both]
    for k, x in zip(of.tolist(), sim.tolist(), strict=True):
        sets[k].add(x)
    assert np.mean([bool(a & b) for a, b in zip(sets[::2], sets[1::2], strict=True)]) >= least


@pytest.mark.parametrize(("words", "alike", "least"), [(5, 0.95, 0.85), (12, 0.95, 0.9), (20, 0.95, 0.9), (40, 0.95, 0.85), (12, 0.9, 0.5), (20, 0.9, 0.4)])
def test_recall_of_changed_letters(words, alike, least):
    """Of changes of single letters, which break whole words, fewer are found the more there are; README gives the figures."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(2, 9)))
    both = []
    for _ in range(300):
        a = " ".join(word() for _ in range(words)).encode()
        b = bytearray(a)
        for k in r.sample(range(len(a)), int((1 - alike) * len(a) + 1e-9)):
            b[k] = r.choice(b"abcdefghijkl")
        both += [a, bytes(b)]
    of, sim = lines.blocks_of_lines(both)
    sets = [set() for _ in both]
    for k, x in zip(of.tolist(), sim.tolist(), strict=True):
        sets[k].add(x)
    assert np.mean([bool(a & b) for a, b in zip(sets[::2], sets[1::2], strict=True)]) >= least


def test_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lines, "RARE_LINES", 10)
    rows = [(k, f"often w{k} x{k}\nsome{k % 100} of it\n") for k in range(400)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert np.array_equal(lines.frequent_words(df)[0], np.sort(lines.Words(b"often of it\n").hash))
    assert lines.frequent_words(df)[1] == sum(len(t.encode()) for _, t in rows if t)
    assert len(lines.frequent_words(df.limit(0))[0]) == 0


def test_recall_on_documents():
    """All pairs of different lines of the documents that are 0.8 alike, found by comparing all, against the blocks."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    rows = sorted({x for t in texts for line in (t or "").encode().split(b"\n") if (x := lines.normalise(line)) and len(x) < 1500}, key=len)
    # an edit changes one count up and one down: a bound that loses no pair
    counts = np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in rows])
    size, good = np.array(list(map(len, rows))), []
    for k in range(len(rows)):
        differ = counts[k + 1 :] - counts[k]
        bound = np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1))
        near = k + 1 + np.flatnonzero((5 * bound <= size[k + 1 :]) & (5 * (size[k + 1 :] - size[k]) <= size[k + 1 :]))
        good += [(k, y) for y in near.tolist() if 5 * lines.edit_distance(rows[k], rows[y]) <= size[y]]
    of, sim = lines.blocks_of_lines(rows)
    sets = [set() for _ in rows]
    for k, x in zip(of.tolist(), sim.tolist(), strict=True):
        sets[k].add(x)
    assert len(good) > 20 and np.mean([bool(sets[a] & sets[b]) for a, b in good]) >= 0.9


def test_other_columns(spark):
    """Types, nulls and clashing names of other columns come back as they were; equal rows keep one of their lines."""
    import datetime

    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, "one line here\nand more", at, 1.5, [1, None], "x"), (1, "one line here\nand more", None, None, None, None), (2, None, at, 2.5, [], "y"), (3, "one line here", at, float("nan"), [3], "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, __null timestamp, `a.b` double, rest array<int>, place string")
    got = lines.dedup_lines(df)
    assert got.drop("n_lines", "removed").schema == df.schema
    assert sorted(r["__null"] is None for r in got.collect()) == [False, False, False, True] and {r["__null"] for r in got.collect()} == {at, None}
    assert sorted((r.doc_id, r.text or "", r.removed) for r in got.collect()) == [(1, "", [0, 1]), (1, "one line here\nand more", []), (2, "", []), (3, "", [0])]
    strings = df.selectExpr("'k' || doc_id AS doc_id", "text")
    assert {r.doc_id for r in lines.dedup_lines(strings).collect()} == {"k1", "k2", "k3"}


def test_empty(spark):
    assert lines.line_digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
