"""The conversation trie against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from mosaiq.llm import queries, tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, shared):
    """The nodes of a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    convs = own
    if shared:
        convs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    ends = {p: ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p))) for p, cs in nodes.items()}
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else -1, len(cs), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, cs in nodes.items())


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def made(seed, n=160):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(400), n):
        deep = r.choice([0, 1, 2, 3, 5, 9])
        turns = [(r.choice(["user", "assistant", None]), r.choice(["a b", "a b\tc", "", None, "x\x0by z w", "é\xa0ü"])) for _ in range(deep)]
        rows += [(c, k if k or r.random() < 0.5 else None, *t) for k, t in enumerate(turns)]
    rows += [(7000, k, "user", f"deep {k}") for k in range(40)] + [(7020, k, "user", f"deep {k}" if k < 30 else f"other {k}") for k in range(36)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(tries, "CHUNK", 3)
    rows = made(seed)
    df = spark.createDataFrame([(*x, 9, "z") for x in rows], SCHEMA + ", part int, place string").repartition(5)
    assert found(tries.prefix_trie(df)) == plain(rows, False)
    assert found(tries.shared_trie(df)) == plain(rows, True)


def test_edges(spark):
    """Rows without an id, repeated ones, one conversation of most rows, other types of ids, empty tables."""
    rows = [(None, 0, "user", "a"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, None, None, None), (4, None, "", ""), (-21, 0, "user", "word " * 50_000)] + [(40, k, "user", "same") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(tries.prefix_trie(df)) == plain(rows, False)
    strings = df.selectExpr("coalesce(cast(conv_id as string), 'none') AS conv_id", "turn", "role", "text")
    assert found(tries.prefix_trie(strings)) == plain(rows, False)
    assert tries.shared_trie(df.limit(0)).count() == 0 and tries.prefix_trie(df.limit(0)).count() == 0


def test_turnless(spark):
    """A conversation that loses its only turns, and whose donor is absent, is a member of the root alone."""
    rows = [(c, 0, "user", f"t{c}") for c in range(1, 20)]
    got = found(tries.shared_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows, True) and any(zlib.crc32(str(c).encode()) % 4 for c in range(1, 20))


def test_conversations(spark, sf):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_trie(spark, sf)) == plain(rows, True)
