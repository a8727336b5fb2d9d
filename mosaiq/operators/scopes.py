"""Clipped containers, patches over a base image, caches between requests and planning of resources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions import filters
from mosaiq.model import PIXELS_SQL, RECTS_SQL, SEGMENTS_SQL
from mosaiq.operators.compositing import _ALPHA, _fold_sql, _over_sql, clip_step, composite_normal, event_alpha, fold, idiv, normal_over, ordered_events, start
from mosaiq.operators.planning import _RUNS, lower_runs
from mosaiq.registry import ORACLES, QUERIES, Tables, query
from mosaiq.streaming.sessions import CheckpointCache, answer_requests


def _clip_sql(alpha: str) -> str:
    return "{" + ", ".join(f"'{c}': (acc.{c} * (255 - {alpha}) + x.s{c} * {alpha} + 127) // 255" for c in "rgb") + ", 'a': acc.a}"


@query(
    "c7_clipped_container",
    f"""WITH {PIXELS_SQL}, i AS ({_fold_sql('WHERE ord > 2')}), o AS ({_fold_sql('WHERE ord <= 2')}),
j AS (SELECT o.px AS px, o.o AS acc, {{'sr': coalesce(i.o.r, 0), 'sg': coalesce(i.o.g, 0), 'sb': coalesce(i.o.b, 0), 'sa': coalesce(i.o.a, 0)}} AS x FROM o LEFT JOIN i ON i.px = o.px)
SELECT px, o.r AS r, o.g AS g, o.b AS b, o.a AS a FROM (SELECT px, {_clip_sql('(x.sa * 200 // 256)')} AS o FROM j)""",
)
def c7(t: Tables) -> DataFrame:
    """A container that is clipped: folded apart, then drawn within the alpha of the base below it."""
    p = t.model.pixels
    base = composite_normal(p.filter("ord <= 2")).select("px", F.struct("r", "g", "b", "a").alias("acc"))
    inside = composite_normal(p.filter("ord > 2")).select("px", *(F.col(c).alias(f"s{c}") for c in "rgba"))
    both = base.join(inside, "px", "left").select("px", "acc", F.struct(*(F.coalesce(f"s{c}", F.lit(0)).alias(f"s{c}") for c in "rgba")).alias("x"))
    alpha = idiv(F.col("x.sa") * 200, 256)
    channels = (idiv(F.col(f"acc.{c}") * (255 - alpha) + F.col(f"x.s{c}") * alpha + 127, 255).alias(c) for c in "rgb")
    return both.select("px", *channels, F.col("acc.a").alias("a"))


_PAPER = "{'r': 20::BIGINT, 'g': 40::BIGINT, 'b': 60::BIGINT, 'a': 255::BIGINT}"


@query(
    "c13_container_base",
    f"""WITH {PIXELS_SQL}, f AS ({_fold_sql(step='CASE WHEN x.ord <= 3 THEN ' + _over_sql(_ALPHA) + ' ELSE ' + _clip_sql(_ALPHA) + ' END')}),
j AS (SELECT px, {_PAPER} AS acc, {{'sr': o.r, 'sg': o.g, 'sb': o.b, 'sa': o.a}} AS x FROM f)
SELECT px, o.r AS r, o.g AS g, o.b AS b, o.a AS a FROM (SELECT px, {_over_sql('(x.sa * 128 // 256)')} AS o FROM j)""",
)
def c13(t: Tables) -> DataFrame:
    """A container as the base of clipped siblings: folded apart, its siblings within its alpha, and all of it over a paper at half."""
    step = lambda acc, x: F.when(x["ord"] <= 3, normal_over(acc, x, event_alpha(x))).otherwise(clip_step(acc, x))
    done = fold(ordered_events(t.model.pixels), start(), step)
    paper = F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in zip("rgba", (20, 40, 60, 255), strict=True)))
    drawn = done.select("px", paper.alias("acc"), F.struct(*(F.col(f"out.{c}").alias(f"s{c}") for c in "rgba")).alias("x"))
    return drawn.select("px", normal_over(F.col("acc"), F.col("x"), idiv(F.col("x.sa") * 128, 256)).alias("out")).select("px", "out.*")


@query("e7_tile_raster_run", f"WITH {PIXELS_SQL}, f AS ({_fold_sql()}) SELECT px // 64 AS tile, count(*) AS pixels, CAST(sum(o.r) AS BIGINT) AS r, CAST(max(o.a) AS BIGINT) AS a FROM f GROUP BY 1")
def e7(t: Tables) -> DataFrame:
    """Tiles of a run of rasters: pixels are folded where they meet, tiles are added up partially."""
    return composite_normal(t.model.pixels).groupBy(F.expr("px div 64").alias("tile")).agg(F.count(F.lit(1)).alias("pixels"), F.sum("r").alias("r"), F.max("a").alias("a"))


@query(
    "e23_patches_over_base",
    f"""WITH {PIXELS_SQL}, base AS ({_fold_sql('WHERE ord <= 2')}), whole AS ({_fold_sql('WHERE px % 64 < 16')})
SELECT coalesce(w.px, b.px) AS px, CASE WHEN w.px IS NULL THEN b.o.r ELSE w.o.r END AS r, CASE WHEN w.px IS NULL THEN b.o.a ELSE w.o.a END AS a, w.px IS NOT NULL AS patched FROM base b FULL JOIN whole w ON b.px = w.px""",
)
def e23(t: Tables) -> DataFrame:
    """Patches that are drawn anew over an image that is there already; the predicate reaches the scan."""
    p = t.model.pixels
    base = composite_normal(p.filter("ord <= 2")).select("px", F.col("r").alias("old_r"), F.col("a").alias("old_a"))
    patch = composite_normal(p.filter("px % 64 < 16")).select("px", "r", "a", F.lit(True).alias("p"))
    return base.join(patch, "px", "full").select("px", F.coalesce("r", "old_r").alias("r"), F.coalesce("a", "old_a").alias("a"), F.coalesce("p", F.lit(False)).alias("patched"))


@query(
    "a3_first_largest",
    f"""WITH {PIXELS_SQL}, c AS (SELECT px, ord, 0 AS channel, abs(sr - dr) AS diff FROM pixels UNION ALL SELECT px, ord, 1, abs(sg - dg) FROM pixels UNION ALL SELECT px, ord, 2, abs(sb - db) FROM pixels UNION ALL SELECT px, ord, 3, abs(sa - da) FROM pixels),
n AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY diff DESC, ord, channel) AS k FROM c) SELECT px, ord, channel, diff FROM n WHERE k = 1""",
)
def a3(t: Tables) -> DataFrame:
    """A3: where each pixel's largest difference is first, by event and channel: one aggregate of the least struct."""
    diffs = F.array(*(F.struct((-F.abs(F.col(f"s{c}") - F.col(f"d{c}"))).alias("d"), "ord", F.lit(k).alias("channel")) for k, c in enumerate("rgba")))
    least = t.model.pixels.select("px", F.array_min(diffs).alias("m")).groupBy("px").agg(F.min("m").alias("m"))
    return least.select("px", "m.ord", "m.channel", (-F.col("m.d")).alias("diff"))


@query("x16_rgb_hsv", f"WITH {PIXELS_SQL} SELECT px, ord, dr AS r, dg AS g, db AS b FROM pixels")
def x16(t: Tables) -> DataFrame:
    """To hue, saturation and value and back again gives the same bytes."""
    back = filters.hsl(0.0, 0.0, 0.0).apply(t.model.pixels)
    return back.select("px", "ord", *(F.round(F.col(f"m_{c}") * 255).cast("bigint").alias(c) for c in "rgb"))


@query("e11_mask_slots", "WITH m AS (SELECT DISTINCT o_custkey % 500 AS mask FROM orders), s AS (SELECT mask, row_number() OVER (ORDER BY mask) - 1 AS slot FROM m) SELECT mask, slot, slot % 32 * 256 AS x, slot // 32 * 256 AS y FROM s")
def e11(t: Tables) -> DataFrame:
    """A place in an atlas for each mask, whose number is bounded by the layers of one image."""
    masks = t["orders"].select((F.col("o_custkey") % 500).alias("mask")).distinct()
    slot = (F.row_number().over(Window.orderBy("mask")) - 1).cast("bigint")
    return masks.withColumn("slot", slot).selectExpr("mask", "slot", "slot % 32 * 256 AS x", "slot div 32 * 256 AS y")


@query("e14_resource_infos", f"WITH {RECTS_SQL} SELECT fill, count(*) AS uses, CAST(sum(w * h * 4) AS BIGINT) AS bytes, max(w * h) AS largest, min(rect_id) AS first FROM rects GROUP BY fill")
def e14(t: Tables) -> DataFrame:
    """What a cache knows of each resource."""
    area = F.col("w") * F.col("h")
    return t.model.rects.groupBy("fill").agg(F.count(F.lit(1)).alias("uses"), F.sum(area * 4).alias("bytes"), F.max(area).alias("largest"), F.min("rect_id").alias("first"))


@query(
    "e16_activity",
    f"""WITH {RECTS_SQL} SELECT y // 100 AS layer, CASE WHEN bool_or(rect_id % 97 = 0) THEN 'Unknown' WHEN bool_and(fill = 0) THEN 'Empty' ELSE 'Bounded' END AS state,
CASE WHEN NOT bool_or(rect_id % 97 = 0) THEN min(x) FILTER (fill <> 0) END AS x0, CASE WHEN NOT bool_or(rect_id % 97 = 0) THEN max(x + w) FILTER (fill <> 0) END AS x1 FROM rects GROUP BY 1""",
)
def e16(t: Tables) -> DataFrame:
    """Bounds of what a layer draws: unknown if any part is, empty if none is filled."""
    unknown, filled = F.bool_or(F.col("rect_id") % 97 == 0), F.col("fill") != 0
    grouped = t.model.rects.groupBy(F.expr("y div 100").alias("layer")).agg(unknown.alias("u"), F.bool_or(filled).alias("any"), F.min(F.when(filled, F.col("x"))).alias("a"), F.max(F.when(filled, F.col("x") + F.col("w"))).alias("b"))
    return grouped.select("layer", F.when(F.col("u"), "Unknown").when(~F.col("any"), "Empty").otherwise("Bounded").alias("state"), F.when(~F.col("u"), F.col("a")).alias("x0"), F.when(~F.col("u"), F.col("b")).alias("x1"))


_ACTIONS = ORACLES["i4_generation_actions"]


@query("e21_pool_stats", f"SELECT day, count(*) AS tiles, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'changed') AS changed, count(*) FILTER (action = 'reuse') AS reused FROM ({_ACTIONS}) GROUP BY day")
def e21(t: Tables) -> DataFrame:
    """A pool's statistics for each generation."""
    actions = QUERIES["i4_generation_actions"](t.spark, t.dir)
    return actions.groupBy("day").agg(F.count(F.lit(1)).alias("tiles"), *(F.count_if(F.col("action") == a).alias(n) for a, n in (("inserted", "inserted"), ("changed", "changed"), ("reuse", "reused"))))


@query("e27_slot_uploads", f"SELECT user_id, day, tile FROM ({_ACTIONS}) WHERE action <> 'reuse'")
def e27(t: Tables) -> DataFrame:
    """Tiles that must be decoded for their slots: all that aren't reused."""
    return QUERIES["i4_generation_actions"](t.spark, t.dir).filter("action <> 'reuse'").select("user_id", "day", "tile")


@query(
    "e30_option_presets",
    f"WITH {SEGMENTS_SQL}, presets(preset, clips, filters) AS (VALUES ('all', true, true), ('no_clips', false, true), ('rasters', false, false)) SELECT preset, count(*) FILTER (reason IS NULL AND (clips OR kind <> 'ClipRun') AND (filters OR kind <> 'FilterRun')) AS local, count(*) AS segments FROM segments, presets GROUP BY preset",
)
def e30(t: Tables) -> DataFrame:
    """How many segments each preset of options runs tile by tile; presets are three columns of one aggregate, not a join."""
    free = F.col("reason").isNull()
    presets = {"all": free, "no_clips": free & (F.col("kind") != "ClipRun"), "rasters": free & ~F.col("kind").isin("ClipRun", "FilterRun")}
    one = t.model.segments.agg(F.count(F.lit(1)).alias("segments"), *(F.count_if(c).alias(k) for k, c in presets.items()))
    return one.select("segments", F.inline(F.array(*(F.struct(F.lit(k).alias("preset"), F.col(k).alias("local")) for k in presets))))


@query("q2_program", f"{_RUNS} SELECT session, start, kind, row_number() OVER (PARTITION BY session ORDER BY start) - 1 AS step FROM plan")
def q2(t: Tables) -> DataFrame:
    """Q2: a session's segments, numbered as they run."""
    return lower_runs(t.model.segments).select("session", "start", "kind", (F.row_number().over(Window.partitionBy("session").orderBy("start")) - 1).cast("bigint").alias("step"))


#: Room of the texture cache below.
CACHE_ROOM = 768
_SIZE = "100 + event_id * 37 % 300"


@query(
    "i5_texture_cache",
    f"""WITH e AS (SELECT user_id, list({_SIZE} ORDER BY event_id) AS sizes FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(sizes, lambda acc, x: CASE WHEN acc % 10000 + x > {CACHE_ROOM} THEN (acc // 10000 + 1) * 10000 + x ELSE acc + x END, 0::BIGINT) AS s FROM e) SELECT user_id, s // 10000 AS clears, s % 10000 AS used FROM f""",
)
def i5(t: Tables) -> DataFrame:
    """A cache that drops all it has when the next texture doesn't fit: how often, and what it holds in the end."""
    sizes = t["events"].groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr(_SIZE).alias("n")))).alias("all"))
    zero = F.lit(0).cast("bigint")
    full = lambda acc, x: acc["used"] + x["n"] > CACHE_ROOM
    step = lambda acc, x: F.struct(F.when(full(acc, x), acc["clears"] + 1).otherwise(acc["clears"]).alias("clears"), F.when(full(acc, x), x["n"]).otherwise(acc["used"] + x["n"]).alias("used"))
    return sizes.select("user_id", F.aggregate("all", F.struct(zero.alias("clears"), zero.alias("used")), step).alias("s")).select("user_id", "s.*")


def _requests(t: Tables, answer) -> DataFrame:  # noqa: ANN001
    """Requests of each user in order, answered with a cache of their own."""
    return t["events"].select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandas(answer, "user_id bigint, event_id bigint, hit boolean, stored boolean")


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("event_id")
    requests: Iterator[list[dict]] = iter([[{"key": k, "priority": e % 5, "bytes": (1 + e % 3) * (200 << 20)} for k, e in zip(rows["event_type"], rows["event_id"].tolist(), strict=True)]])
    said = list(answer_requests(requests, CheckpointCache()))
    return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "hit": [s["hit"] for s in said], "stored": [s["stored"] for s in said]})


@query("i6_checkpoint_cache")
def i6(t: Tables) -> DataFrame:
    """What two entries of 512 MiB keep of each user's checkpoints; it depends on order, so SQL can't tell."""
    return _requests(t, _answers).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if("stored").alias("stored"), F.count_if(~F.col("hit") & ~F.col("stored")).alias("refused"))


@query("i10_request_loop")
def i10(t: Tables) -> DataFrame:
    """A status for each request, the cache kept between them."""
    return _requests(t, _answers)


@query("i8_patch_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sparse' WHEN o_orderkey % 5 < 3 THEN 'region' ELSE 'full' END AS drawn_by, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 WHEN o_orderkey % 5 < 3 THEN o_orderkey * 20 ELSE o_orderkey * 40 END AS bytes FROM orders")
def i8(t: Tables) -> DataFrame:
    """I8: the first way that could draw a patch: from the sparse atlas, as a region, or out of the whole image."""
    o = t["orders"].select("o_orderkey")
    way = lambda name, where, n: o.filter(where).select("o_orderkey", F.struct(F.lit(name).alias("drawn_by"), (F.col("o_orderkey") * n).alias("bytes")).alias(name))
    found = o.join(way("sparse", "o_orderkey % 3 = 0", 10), "o_orderkey", "left").join(way("region", "o_orderkey % 5 < 3", 20), "o_orderkey", "left").join(way("full", "true", 40), "o_orderkey", "left")
    return found.select("o_orderkey", F.coalesce("sparse", "region", "full").alias("x")).select("o_orderkey", "x.*")


@query("i9_changes", "WITH v AS (SELECT user_id, event_id, event_id % 3 AS hash, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT user_id, event_id, hash FROM v WHERE was IS DISTINCT FROM hash")
def i9(t: Tables) -> DataFrame:
    """Versions of a file that differ from the one before; the first counts."""
    was = F.lag(F.col("event_id") % 3).over(Window.partitionBy("user_id").orderBy("event_id"))
    return t["events"].select("user_id", "event_id", (F.col("event_id") % 3).alias("hash"), was.alias("was")).filter(~F.col("was").eqNullSafe(F.col("hash"))).drop("was")
