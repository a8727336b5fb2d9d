"""Overlaps of rectangles against all pairs."""

import random

import duckdb
import pytest

from mosaiq import registry
from mosaiq.operators import diffing, statistics, tiling

KIND = "rect_id long, x long, y long, w long, h long"


def rects(seed, n, crowd):
    r = random.Random(seed)
    out = []
    for k in range(n):
        size = r.choice([1, 3, 16, 100, 1000, 5000])
        x, y = (r.randrange(40, 60), r.randrange(40, 60)) if crowd else (r.randrange(-3000, 9000), r.randrange(-3000, 9000))
        out.append((k, x, y, max(1, size - r.randrange(5)), r.randrange(1, size + 1)))
    return [*out, (n, None, 1, 1, 1), (n + 1, 5, 5, 0, 3), (n + 2, 5, 5, 3, None)]


@pytest.mark.parametrize(("crowd", "heavy"), [(False, 20_000), (True, 40)])
def test_overlaps(spark, crowd, heavy):
    a, b = rects(1, 150, crowd), rects(2, 120, crowd)
    got = diffing.overlapping_rects(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), heavy).select("l_rect_id", "r_rect_id").collect()
    known = lambda rows: [r for r in rows if None not in r and r[3] > 0]
    want = {(p[0], q[0]) for p in known(a) for q in known(b) if p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_copies_count_without_pairs_of_their_own(spark, monkeypatch):
    a, b = rects(3, 60, False), rects(4, 50, False)
    copied = lambda rows: spark.createDataFrame([(r[0] + 1000 * k, *r[1:]) for r in rows for k in range(30)], KIND)
    pairs, plain = [], diffing.overlapping_rects
    monkeypatch.setattr(diffing, "overlapping_rects", lambda *x: pairs.append(plain(*x)) or pairs[-1])
    got = {tuple(r) for r in diffing.count_overlaps(copied(a), copied(b)).collect()}
    known = lambda rows: [r for r in rows if None not in r and r[3] > 0]
    want = set()
    for p in known(a):
        met = [q[0] for q in known(b) if p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4]]
        want |= {(p[0] + 1000 * k, 30 * len(met), 30 * sum(met) + 1000 * 435 * len(met)) for k in range(30) if met}
    assert got == want
    assert pairs[0].count() <= len(a) * len(b)


def test_sums_in_rectangles(spark):
    r, side = random.Random(5), 64
    points = [(k, r.randrange(side), r.randrange(side)) for k in range(500)]
    boxes = [(k, r.randrange(-20, 80), r.randrange(-20, 80), r.randrange(0, 40), r.randrange(0, 40)) for k in range(200)] + [(200, 0, 0, 64, 64), (201, -5, -5, 500, 500), (202, None, 1, 2, 2)]
    got = tiling.sums_in_rects(spark.createDataFrame(points, "id long, px long, py long"), spark.createDataFrame(boxes, KIND), side).collect()
    want = set()
    for k, x, y, w, h in boxes:
        ids = [i for i, px, py in points if x is not None and x <= px < x + w and y <= py < y + h]
        want |= {(k, len(ids), sum(ids))} if ids else set()
    assert {(row.rect_id, row.pixels, row.ids) for row in got} == want
    assert len(got) == len(want)


def test_islands_of_intervals_with_equal_starts(spark):
    rows = [(1, 0, 5), (1, 0, 5), (1, 0, 9), (1, 9, 10), (1, 12, 13), (1, 12, 12), (1, 12, 13), (2, 3, 3), (2, 3, 3)]
    found = statistics.coalesce_intervals(spark.createDataFrame(rows, "g long, a long, b long"), "g", "a", "b").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 10, 4), (1, 12, 13, 3), (2, 3, 3, 2)]


def test_island_sql_leaves_no_ties(spark, sf, tmp_path):
    """With the table 40 times over, equal intervals are many; the SQL gives what the query does."""
    duckdb.sql(f"COPY (SELECT p.* REPLACE (p_partkey + i * 34200 AS p_partkey) FROM '{sf}/part.parquet' p, range(40) r(i)) TO '{tmp_path}/part.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = [(r.fill, r.a, r.b, r.merged) for r in registry.QUERIES["w7_interval_islands"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(f"SELECT fill, a, b, merged FROM ({registry.ORACLES['w7_interval_islands']})").fetchall())


@pytest.mark.parametrize(("crowd", "heavy"), [(False, 20_000), (True, 40)])
def test_rects_that_meet_any(spark, crowd, heavy):
    """The left rectangles that any other overlaps, without a row for each pair."""
    a, b = rects(6, 150, crowd), rects(7, 200, crowd)
    got = [r.l_rect_id for r in diffing.overlapping_rects(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), heavy, any_of_right=True).collect()]
    known = lambda rows: [r for r in rows if None not in r and r[3] > 0]
    met = [(p[0], q[0]) for p in known(a) for q in known(b) if p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4]]
    assert set(got) == {p for p, _ in met}
    if crowd:
        assert len(got) < len(met) / 2


def test_dirty_items(spark):
    a, b = rects(8, 100, False), rects(9, 40, False)
    dirty = {r.rect_id: r.dirty for r in diffing.dirty_items(spark.createDataFrame(a, KIND), spark.createDataFrame([*b, *((1000 + r[0], *r[1:]) for r in b)], KIND)).collect()}
    for p in a:
        met = any(None not in q and q[3] > 0 and p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] for q in b) if None not in p and p[3] > 0 else None in p
        assert dirty[p[0]] == met
