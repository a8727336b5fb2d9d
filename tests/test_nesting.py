"""The fold of nested scopes in batches against the expressions on columns, and what its rows cost."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from mosaiq.operators import compositing, nesting


def some(r):
    acc = [r.choice([0, 1, 127, 255, r.randrange(256), None]) for _ in range(8)]
    return (*acc, r.choice([0, 255, r.randrange(256), None]), r.choice([0, 256, r.randrange(257), None]))


def test_steps_are_those_of_columns(spark):
    r = random.Random(1)
    rows = [some(r) for _ in range(400)]
    kind = [f"{p}{c}" for p in "xy" for c in "rgba"]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], f"k long, {', '.join(f'{c} long' for c in kind)}, alpha long, strength long")
    acc, other = (F.struct(*(F.col(f"{p}{c}").alias(c) for c in "rgba")) for p in "xy")
    source = F.struct(*(F.col(f"y{c}").alias(f"s{c}") for c in "rgb"))
    want = df.select("k", compositing.normal_over(acc, source, F.col("alpha")).alias("over"), compositing.through(acc, other, F.col("strength") / 256.0).alias("through")).orderBy("k").collect()
    v = np.array(rows, float).T
    for name, got in (("over", nesting.normal_over(v[:4], v[4:7], v[8])), ("through", nesting.through(v[:4], v[4:8], v[9] / 256.0))):
        assert [tuple(x[name]) for x in want] == [tuple(None if np.isnan(c) else int(c) for c in p) for p in got.T]


def test_pixels_of_unlike_depths(monkeypatch):
    """Pixels that are held in several parts come out as alone."""
    b, e, d = nesting.BEGIN, nesting.END, nesting.DRAW
    runs = [[d], [b, d, e], [b, b, d, e, d, e, d], [], [b, b, b, d, e, e, e]]
    counts, what = np.array([len(x) for x in runs]), np.concatenate([np.array(x, int) for x in runs])
    values = np.random.default_rng(2).integers(0, 256, (len(nesting.VALUES), len(what))).astype(float)
    values[4], values[6] = np.arange(len(what)) % 2, 0
    starts = np.cumsum(counts) - counts
    alone = [nesting.fold_stacks(counts[k : k + 1], what[s : s + counts[k]], values[:, s : s + counts[k]]) for k, s in enumerate(starts)]
    monkeypatch.setattr(nesting, "HELD", 5)
    assert np.array_equal(nesting.fold_stacks(counts, what, values), np.hstack(alone))


def test_draws_are_dealt_out_by_pixel_once(spark):
    draws = spark.range(50).selectExpr("id % 7 AS px", "id % 5 AS layer_id", "id AS ord", "id AS sr", "id AS sg", "id AS sb", "id AS alpha")
    scope = "named_struct('place', 0L, 'until', 9L, 'level', 1L, 'kind', 0L, 'strength', 256L, 'clipped', 0L)"
    paths = spark.range(5).selectExpr("id AS layer_id", "id + 1 AS node_id", "0L AS clip", f"array({scope}) AS scopes")
    events = nesting.pixel_events(draws, paths)
    assert len(re.findall(r"hashpartitioning\(px", events._jdf.queryExecution().executedPlan().toString())) == 1
    assert events.selectExpr("count_if(events[0].at.what = 1 AND size(filter(events, e -> e.at.what = 1)) = 1 AND events[size(events) - 1].at.what = 0) AS n").first().n == 7
