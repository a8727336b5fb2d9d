"""Walks of layer trees against a plain walk."""

import random

import pytest

from mosaiq.operators import hierarchy


def plain(rows, root):
    """(node_id, layer_id, parent, tree_depth, subtree_end) by a stack."""
    below, seen = {}, []
    for i, parent, shown in rows:
        if shown and i != root:
            below.setdefault(parent, []).append(i)
    todo = [(root, None, 0)]
    while todo:
        i, parent, depth = todo.pop()
        seen.append((i, parent, depth))
        todo += [(c, i, depth + 1) for c in sorted(below.get(i, []), reverse=True)]
    depths = [d for *_, d in seen]
    ends, open_ = [len(seen)] * len(seen), []
    for k, d in enumerate(depths):
        while open_ and depths[open_[-1]] >= d:
            ends[open_.pop()] = k
        open_.append(k)
    return [(k, i, p, d, ends[k]) for k, (i, p, d) in enumerate(seen)]


@pytest.mark.parametrize("seed", [1])
def test_preorder(spark, seed):
    r = random.Random(seed)
    rows = [(i, None if i == 1 else r.choice([0, max(1, i - 1), r.randrange(1, i)]), r.random() < 0.9) for i in range(1, 60)]
    df = spark.createDataFrame([(i, p, 1 if s else 2) for i, p, s in rows], "layer_id long, parent long, visibility long")
    got = hierarchy.preorder(df).select("node_id", "layer_id", "parent", "tree_depth", "subtree_end").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain(rows, 1)


def test_another_root(spark):
    """A part of a tree, from a root that is hidden itself."""
    rows = [(1, None, True), (2, 1, False), (3, 2, True), (4, 2, False), (5, 3, True), (6, 4, True), (7, 1, True)]
    df = spark.createDataFrame([(i, p, 1 if s else 2) for i, p, s in rows], "layer_id long, parent long, visibility long")
    got = hierarchy.preorder(df, root=2).select("node_id", "layer_id", "parent", "tree_depth", "subtree_end").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == plain(rows, 2)


def test_deep_chain(spark):
    df = spark.range(1, 41).selectExpr("id AS layer_id", "CASE WHEN id > 1 THEN id - 1 END AS parent", "CAST(1 AS BIGINT) AS visibility")
    got = hierarchy.preorder(df)
    row = got.selectExpr("count(*) AS n", "count_if(node_id <> layer_id - 1 OR tree_depth <> node_id OR subtree_end <> 40) AS wrong").first()
    assert (row.n, row.wrong) == (40, 0)


def test_circles(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 3, 1), (3, 2, 1)], "layer_id long, parent long, visibility long")
    with pytest.raises(ValueError, match="circles"):
        hierarchy.preorder(df)


def test_siblings_look_ahead_from_one_row_each(spark, monkeypatch):
    """Ranks from stored links; in no round do many rows look for the same one."""
    n, rounds, plain_cut = 40, [], hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(plain_cut(df)) or rounds[-1])
    df = spark.createDataFrame([(1, 0, 2)] + [(i, i + 1 if i < n else 0, 0) for i in range(2, n + 1)], "layer_id long, next_id long, first_child long")
    got = {r.layer_id: (r.parent, r.rank) for r in hierarchy.linked(df).collect()}
    assert got == {1: (None, 0)} | {i: (1, i - 2) for i in range(2, n + 1)}
    assert 1 < len(rounds) <= 8
    for now in rounds:
        assert now.filter("open").groupBy("head").count().filter("count > 1").isEmpty()
