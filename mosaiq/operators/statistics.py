"""Aggregates, ordered analytics and top-k (A5 to A21, W1 to W11, O3 to O9) over segments, rectangles and requests."""

from __future__ import annotations



from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.model import PIXELS_SQL, RECTS_SQL, SEGMENTS_SQL

COST = "passes * 1024 + legacy * 2048 + tile_events * 8 + span * 16"
REUSE = "greatest(tile_events + span, 1)"
#: What 1 MiB of checkpoint costs.
MEMORY_MIB = 16


def running(order: str, group: str = "session") -> Window:
    """Segments of one session in order; sessions are independent, so no window spans the table."""
    return Window.partitionBy(group).orderBy(order)


def prefix_costs(segments: DataFrame) -> DataFrame:
    """What lies before a segment (exclusive), and the reuse signal from it on (inclusive)."""
    before = running("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    after = running("ordinal").rowsBetween(0, Window.unboundedFollowing)
    costed = segments.withColumns({"cost": F.expr(COST), "reuse": F.expr(REUSE)})
    return costed.withColumns({"prefix": F.coalesce(F.sum("cost").over(before), F.lit(0)), "suffix": F.sum("reuse").over(after)})


_PREFIX = f"""WITH {SEGMENTS_SQL}, p AS (SELECT *, CAST(coalesce(sum({COST}) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix,
CAST(sum({REUSE}) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS suffix FROM segments)"""
PRIORITY = f"CASE WHEN kind <> 'RasterRun' OR prefix = 0 THEN 0 ELSE least(prefix * suffix DIV {MEMORY_MIB}, 4294967295) END"


@query("w1_prefix_cost", f"{_PREFIX} SELECT ordinal, prefix FROM p")
def w1(t: Tables) -> DataFrame:
    return prefix_costs(t.model.segments).select("ordinal", "prefix")


@query("w2_suffix_reuse", f"{_PREFIX} SELECT ordinal, suffix FROM p")
def w2(t: Tables) -> DataFrame:
    return prefix_costs(t.model.segments).select("ordinal", "suffix")


@query("w3_checkpoint_priority", f"{_PREFIX} SELECT ordinal, {PRIORITY.replace('DIV', '//')} AS priority FROM p")
def w3(t: Tables) -> DataFrame:
    return prefix_costs(t.model.segments).select("ordinal", F.expr(PRIORITY.replace("DIV", "div")).cast("bigint").alias("priority"))


@query("w5_event_numbers", f"WITH {SEGMENTS_SQL} SELECT ordinal, row_number() OVER (PARTITION BY session, kind ORDER BY ordinal) - 1 AS event FROM segments")
def w5(t: Tables) -> DataFrame:
    numbered = F.row_number().over(Window.partitionBy("session", "kind").orderBy("ordinal"))
    return t.model.segments.select("ordinal", (numbered - 1).cast("bigint").alias("event"))


@query("w6_csr_spans", f"WITH {RECTS_SQL}, c AS (SELECT x // 256 AS tile_x, y // 256 AS tile_y, count(*) AS n FROM rects GROUP BY ALL) SELECT tile_x, tile_y, n, CAST(coalesce(sum(n) OVER (PARTITION BY tile_y ORDER BY tile_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def w6(t: Tables) -> DataFrame:
    """(start, count) of each tile within its row of tiles."""
    counts = t.model.rects.groupBy(F.expr("x div 256").alias("tile_x"), F.expr("y div 256").alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tile_y").orderBy("tile_x").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def coalesce_intervals(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Intervals of a group that overlap or touch, as one each; those of one start are one before, so that no order is left open."""
    one = rows.groupBy(group, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(start)
    reach = one.withColumn("reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = reach.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col(start) > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("merged")).drop("island")


@query(
    "w7_interval_islands",
    f"""WITH {RECTS_SQL}, r AS (SELECT fill, x AS a, max(x + w % 9) AS b, count(*) AS n FROM rects GROUP BY fill, x), m AS (SELECT *, max(b) OVER (PARTITION BY fill ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY fill ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT fill, min(a) AS a, max(b) AS b, CAST(sum(n) AS BIGINT) AS merged FROM i GROUP BY fill, island""",
)
def w7(t: Tables) -> DataFrame:
    return coalesce_intervals(t.model.rects.select("fill", F.col("x").alias("a"), F.expr("x + w % 9").alias("b")), "fill", "a", "b")


@query(
    "w8_batch_split",
    f"WITH {SEGMENTS_SQL}, f AS (SELECT session, ordinal, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY session ORDER BY ordinal) THEN 1 ELSE 0 END AS flag FROM segments), b AS (SELECT session, sum(flag) OVER (PARTITION BY session ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS batch FROM f) SELECT session, CAST(batch AS BIGINT) AS batch, count(*) AS n FROM b GROUP BY session, batch",
)
def w8(t: Tables) -> DataFrame:
    """A batch ends where the key changes."""
    w = running("ordinal")
    flagged = t.model.segments.withColumn("flag", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("bigint"))
    return flagged.withColumn("batch", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("session", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w9_open_until_barrier",
    f"WITH {SEGMENTS_SQL}, b AS (SELECT session, ordinal, tile_events, coalesce(sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM segments) SELECT session, CAST(open AS BIGINT) AS open, count(*) AS n, CAST(sum(tile_events) AS BIGINT) AS tile_events FROM b GROUP BY session, open",
)
def w9(t: Tables) -> DataFrame:
    """Runs that stay open until a barrier."""
    before = running("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    opened = t.model.segments.withColumn("open", F.coalesce(F.sum(F.col("reason").isNotNull().cast("bigint")).over(before), F.lit(0)))
    return opened.groupBy("session", "open").agg(F.count(F.lit(1)).alias("n"), F.sum("tile_events").alias("tile_events"))


@query("w10_counter_deltas", f"WITH {SEGMENTS_SQL} SELECT ordinal, passes - lag(passes, 1, 0) OVER (PARTITION BY session ORDER BY ordinal) AS delta FROM segments")
def w10(t: Tables) -> DataFrame:
    return t.model.segments.select("ordinal", (F.col("passes") - F.coalesce(F.lag("passes").over(running("ordinal")), F.lit(0))).alias("delta"))


@query("w11_first_barrier", f"WITH {SEGMENTS_SQL} SELECT session, min(ordinal) FILTER (reason IS NOT NULL) AS ordinal, arg_min(reason, ordinal) FILTER (reason IS NOT NULL) AS reason FROM segments GROUP BY session")
def w11(t: Tables) -> DataFrame:
    barrier = F.when(F.col("reason").isNotNull(), F.col("ordinal"))
    return t.model.segments.groupBy("session").agg(F.min(barrier).alias("ordinal"), F.min_by("reason", barrier).alias("reason"))


@query("a5_resource_stats", f"WITH {RECTS_SQL} SELECT fill, count(*) AS n, CAST(sum(w * h * 4) AS BIGINT) AS bytes, max(w * h * 4) AS largest, arg_min(rect_id, [-(w * h * 4), rect_id]) AS largest_id FROM rects GROUP BY fill")
def a5(t: Tables) -> DataFrame:
    """A5: counts and sums, and the first of the largest."""
    size = F.col("w") * F.col("h") * 4
    return t.model.rects.groupBy("fill").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.min_by("rect_id", F.struct(-size, F.col("rect_id"))).alias("largest_id"))


_TILED = "SELECT r.*, tx AS tile_x, ty AS tile_y FROM rects r, LATERAL (SELECT unnest(range(x // 256, (x + w - 1) // 256 + 1)) AS tx) a, LATERAL (SELECT unnest(range(y // 256, (y + h - 1) // 256 + 1)) AS ty) b"


def explode_tiles(rects: DataFrame, size: int = 256) -> DataFrame:
    """A row for each tile that a rectangle touches."""
    across = F.explode(F.sequence(F.expr(f"x div {size}"), F.expr(f"(x + w - 1) div {size}")))
    down = F.explode(F.sequence(F.expr(f"y div {size}"), F.expr(f"(y + h - 1) div {size}")))
    return rects.withColumn("tile_x", across).withColumn("tile_y", down)


@query("a6_tile_occupancy", f"WITH {RECTS_SQL}, tl AS ({_TILED}), c AS (SELECT tile_x, tile_y, count(*) AS n FROM tl GROUP BY ALL) SELECT count(*) AS active, max(n) AS most, avg(n) AS mean, CAST(sum(n) AS BIGINT) AS events FROM c")
def a6(t: Tables) -> DataFrame:
    counts = explode_tiles(t.model.rects).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("active"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.sum("n").alias("events"))


@query("a7_distinct_resources", f"WITH {SEGMENTS_SQL} SELECT session, count(DISTINCT tile_events) AS resources, count(DISTINCT (kind, depth)) AS slots FROM segments GROUP BY session")
def a7(t: Tables) -> DataFrame:
    return t.model.segments.groupBy("session").agg(F.count_distinct("tile_events").alias("resources"), F.count_distinct("kind", "depth").alias("slots"))


_ROLLUP = ("passes", "tile_events", "legacy", "span")


@query("a8_program_rollup", f"WITH {SEGMENTS_SQL} SELECT kind, count(*) AS segments, {', '.join(f'CAST(least(sum({c}), 4294967295) AS BIGINT) AS {c}' for c in _ROLLUP)}, count(*) FILTER (depth > 0) AS nested, count(*) FILTER (reason IS NOT NULL) AS barriers FROM segments GROUP BY kind")
def a8(t: Tables) -> DataFrame:
    """Saturating sums of the program's counters."""
    sums = [F.least(F.sum(c), F.lit(4294967295)).cast("bigint").alias(c) for c in _ROLLUP]
    return t.model.segments.groupBy("kind").agg(F.count(F.lit(1)).alias("segments"), *sums, F.count_if(F.col("depth") > 0).alias("nested"), F.count("reason").alias("barriers"))


@query("a10_barrier_histogram", f"WITH {SEGMENTS_SQL} SELECT reason, count(*) AS n FROM segments WHERE reason IS NOT NULL GROUP BY reason")
def a10(t: Tables) -> DataFrame:
    return t.model.segments.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a11_weighted_mode", f"WITH {SEGMENTS_SQL}, s AS (SELECT session, depth AS align, sum(span) AS total FROM segments GROUP BY ALL) SELECT session, arg_min(align, [-total, align]) AS align FROM s GROUP BY session")
def a11(t: Tables) -> DataFrame:
    """The alignment of most text; the smallest of equals."""
    sums = t.model.segments.groupBy("session", F.col("depth").alias("align")).agg(F.sum("span").alias("total"))
    return sums.groupBy("session").agg(F.max_by("align", F.struct(F.col("total"), -F.col("align"))).alias("align"))


@query("a13_bounds_union", f"WITH {RECTS_SQL} SELECT fill, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM rects GROUP BY fill")
def a13(t: Tables) -> DataFrame:
    x, y = F.min("x"), F.min("y")
    return t.model.rects.groupBy("fill").agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


_EXTENT = "CASE WHEN bool_or(kind = 'ClipRun') THEN 'Unknown' WHEN count(*) FILTER (kind = 'RasterRun') = 0 THEN 'Empty' ELSE 'Bounded' END"


@query("a14_extent_lattice", f"WITH {SEGMENTS_SQL} SELECT session, {_EXTENT} AS extent, coalesce(max(span) FILTER (kind = 'RasterRun'), 0) AS bound FROM segments GROUP BY session")
def a14(t: Tables) -> DataFrame:
    """An unknown extent wins, filters keep what is there, rasters grow it: a join of a lattice, so partial sums do."""
    raster = F.col("kind") == "RasterRun"
    extent = F.when(F.bool_or(F.col("kind") == "ClipRun"), "Unknown").when(F.count_if(raster) == 0, "Empty").otherwise("Bounded")
    return t.model.segments.groupBy("session").agg(extent.alias("extent"), F.coalesce(F.max(F.when(raster, F.col("span"))), F.lit(0)).alias("bound"))


@query("a15_dirty_area", f"WITH {RECTS_SQL} SELECT fill, CAST(sum(w * h) AS BIGINT) AS area, sum(w * h) / CAST(2048 * 2048 AS DOUBLE) >= 5e-1 OR count(*) > 256 AS whole FROM rects GROUP BY fill")
def a15(t: Tables) -> DataFrame:
    area = F.sum(F.col("w") * F.col("h"))
    return t.model.rects.groupBy("fill").agg(area.alias("area"), ((area / float(2048 * 2048) >= 0.5) | (F.count(F.lit(1)) > 256)).alias("whole"))


@query("a16_upload_bytes", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT fill, count(DISTINCT (tile_x, tile_y)) * 256 * 256 * 4 AS bytes FROM tl GROUP BY fill")
def a16(t: Tables) -> DataFrame:
    return explode_tiles(t.model.rects).groupBy("fill").agg((F.count_distinct("tile_x", "tile_y") * (256 * 256 * 4)).alias("bytes"))


@query("a17_signature", f"WITH {SEGMENTS_SQL} SELECT session, sha256(string_agg(concat_ws(':', ordinal, kind, passes, coalesce(reason, '-')), '|' ORDER BY ordinal)) AS signature FROM segments GROUP BY session")
def a17(t: Tables) -> DataFrame:
    """A signature over ordered fields; SHA-256 since only equality counts."""
    one = F.concat_ws(":", "ordinal", "kind", "passes", F.coalesce("reason", F.lit("-")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", one.alias("x"))))
    return t.model.segments.groupBy("session").agg(ordered.alias("xs")).select("session", F.sha2(F.array_join(F.transform("xs", lambda v: v["x"]), "|").cast("binary"), 256).alias("signature"))


@query("a18_prefix_signature", f"WITH {SEGMENTS_SQL}, c AS (SELECT session, min(ordinal) FILTER (reason IS NOT NULL) AS cut FROM segments GROUP BY session) SELECT s.session, sha256(string_agg(concat_ws(':', ordinal, kind), '|' ORDER BY ordinal)) AS signature FROM segments s JOIN c ON s.session = c.session AND ordinal < cut GROUP BY s.session")
def a18(t: Tables) -> DataFrame:
    """Only what lies before the first barrier of a session."""
    s = t.model.segments
    cut = F.min(F.when(F.col("reason").isNotNull(), F.col("ordinal"))).over(Window.partitionBy("session"))
    before = s.withColumn("cut", cut).filter("ordinal < cut")
    ordered = before.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind"))).alias("xs"))
    return ordered.select("session", F.sha2(F.array_join(F.transform("xs", lambda v: F.concat_ws(":", v["ordinal"], v["kind"])), "|").cast("binary"), 256).alias("signature"))


@query("a19_payload_sha256", "SELECT page_id, sha256(html) AS digest, octet_length(encode(html)) AS bytes FROM pages")
def a19(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("bigint").alias("bytes"))


@query("a20_request_summary", f"WITH {SEGMENTS_SQL}, d AS (SELECT session, passes - lag(passes, 1, 0) OVER (PARTITION BY session ORDER BY ordinal) AS delta, reason, tile_events FROM segments) SELECT session, count(*) AS requests, CAST(sum(delta) AS BIGINT) AS delta, CAST(sum(tile_events) AS BIGINT) AS events, bool_or(reason IS NOT NULL) AS blocked FROM d GROUP BY session")
def a20(t: Tables) -> DataFrame:
    d = t.model.segments.withColumn("delta", F.col("passes") - F.coalesce(F.lag("passes").over(running("ordinal")), F.lit(0)))
    return d.groupBy("session").agg(F.count(F.lit(1)).alias("requests"), F.sum("delta").alias("delta"), F.sum("tile_events").alias("events"), F.bool_or(F.col("reason").isNotNull()).alias("blocked"))


@query("a21_dominant_task", f"WITH {SEGMENTS_SQL} SELECT session, arg_min(ordinal, [-({COST}), ordinal]) AS ordinal, max({COST}) AS cost FROM segments GROUP BY session")
def a21(t: Tables) -> DataFrame:
    return t.model.segments.withColumn("cost", F.expr(COST)).groupBy("session").agg(F.min_by("ordinal", F.struct(-F.col("cost"), F.col("ordinal"))).alias("ordinal"), F.max("cost").alias("cost"))


@query("o3_multi_key_sort", f"WITH {SEGMENTS_SQL} SELECT kind, depth, session, ordinal FROM segments ORDER BY kind, depth, session, ordinal")
def o3(t: Tables) -> DataFrame:
    return t.model.segments.select("kind", "depth", "session", "ordinal").orderBy("kind", "depth", "session", "ordinal")


@query("o4_rect_sort_dedupe", f"WITH {RECTS_SQL} SELECT DISTINCT y // 64 AS y, x // 64 AS x, w // 64 AS w, h // 64 AS h FROM rects ORDER BY ALL")
def o4(t: Tables) -> DataFrame:
    return t.model.rects.select(*(F.expr(f"{c} div 64").alias(c) for c in ("y", "x", "w", "h"))).distinct().orderBy("y", "x", "w", "h")


@query("o5_top16_segments", f"WITH {SEGMENTS_SQL} SELECT ordinal, kind, {COST} AS cost FROM segments ORDER BY cost DESC, ordinal LIMIT 16")
def o5(t: Tables) -> DataFrame:
    """The 16 dearest segments; each task keeps its own 16."""
    return t.model.segments.select("ordinal", "kind", F.expr(COST).alias("cost")).orderBy(F.desc("cost"), "ordinal").limit(16)


@query("o6_top10", f"WITH {SEGMENTS_SQL}, b AS (SELECT ordinal, {COST} AS cost FROM segments ORDER BY cost DESC, ordinal LIMIT 16) SELECT * FROM b ORDER BY cost DESC, ordinal LIMIT 10")
def o6(t: Tables) -> DataFrame:
    return o5(t).select("ordinal", "cost").orderBy(F.desc("cost"), "ordinal").limit(10)


@query("o7_sorted_stops", "SELECT vec_id, list_sort([CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)])[2] AS median FROM embeddings")
def o7(t: Tables) -> DataFrame:
    """Stops in order within the row."""
    return t["embeddings"].select("vec_id", F.element_at(F.array_sort(F.slice("embedding", 1, 3)), 2).cast("double").alias("median"))


@query(
    "o9_take_while",
    f"WITH {SEGMENTS_SQL}, n AS (SELECT session, ordinal, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS nth, bool_and(coalesce(reason, '') <> 'UnsupportedBlend') OVER (PARTITION BY session ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS fine FROM segments) SELECT session, count(*) AS taken FROM n WHERE nth <= 256 AND fine GROUP BY session",
)
def o9(t: Tables) -> DataFrame:
    """Up to 256 events of a session, and only until one isn't eligible."""
    w = running("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    n = t.model.segments.withColumns({"nth": F.row_number().over(running("ordinal")), "fine": F.bool_and(F.coalesce("reason", F.lit("")) != "UnsupportedBlend").over(w)})
    return n.filter("nth <= 256 and fine").groupBy("session").agg(F.count(F.lit(1)).alias("taken"))




@query("u3_first_occurrence", f"WITH {PIXELS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY ord, sr, sg, sb, sa) AS nth FROM pixels) SELECT px, sr, sg, sb, sa FROM n WHERE nth = 1")
def u3(t: Tables) -> DataFrame:
    """The first of each key, as a partial aggregate rather than a window."""
    first = t.model.pixels.groupBy("px").agg(F.min(F.struct("ord", "sr", "sg", "sb", "sa")).alias("x"))
    return first.select("px", "x.sr", "x.sg", "x.sb", "x.sa")


@query("u4_reported_once", f"WITH {SEGMENTS_SQL} SELECT DISTINCT session, kind FROM segments")
def u4(t: Tables) -> DataFrame:
    return t.model.segments.select("session", "kind").dropDuplicates()


