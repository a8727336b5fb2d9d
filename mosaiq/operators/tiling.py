"""Tiled arrays (T2 to T10, X9 to X12, U5, E36): rectangles, tiles, packing."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.model import RECTS_SQL
from mosaiq.operators.statistics import _TILED, explode_tiles
from mosaiq.plans.recipe import Recipe

CANVAS = 2048


def crop(offset_x: str = "x - 300", offset_y: str = "y - 200") -> Recipe:
    """What a source placed at an offset shows of itself on the canvas, and where."""
    out = Recipe().add(ox=offset_x, oy=offset_y)
    out.add(left_="greatest(ox, 0)", top_="greatest(oy, 0)", right_=f"least(ox + w, {CANVAS})", bottom_=f"least(oy + h, {CANVAS})")
    return out.add(visible="right_ > left_ AND bottom_ > top_", source_x="left_ - ox", source_y="top_ - oy", crop_w="greatest(right_ - left_, 0)", crop_h="greatest(bottom_ - top_, 0)")


_CROP = ["rect_id", "visible", "left_", "top_", "source_x", "source_y", "crop_w", "crop_h"]


@query("x9_source_crop", f"WITH {RECTS_SQL} SELECT {', '.join(_CROP)} FROM ({crop().sql('SELECT * FROM rects')})")
def x9(t: Tables) -> DataFrame:
    return crop().apply(t.model.rects).select(*_CROP)


_REGION = Recipe().add(rx="greatest(x, 500)", ry="greatest(y, 400)", rr="least(x + w, 1500)", rb="least(y + h, 1400)").add(meets="rr > rx AND rb > ry")


@query("x10_region_recrop", f"WITH {RECTS_SQL} SELECT rect_id, rx, ry, rr - rx AS w, rb - ry AS h FROM ({_REGION.sql('SELECT * FROM rects')}) WHERE meets")
def x10(t: Tables) -> DataFrame:
    return _REGION.apply(t.model.rects).filter("meets").selectExpr("rect_id", "rx", "ry", "rr - rx AS w", "rb - ry AS h")


@query("x11_tile_on_canvas", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT rect_id, tile_x, tile_y, greatest(x, tile_x * 256) AS cx, greatest(y, tile_y * 256) AS cy, least(x + w, tile_x * 256 + 256) - greatest(x, tile_x * 256) AS cw, least(y + h, tile_y * 256 + 256) - greatest(y, tile_y * 256) AS ch FROM tl")
def x11(t: Tables) -> DataFrame:
    """Each tile's part of a rectangle."""
    return explode_tiles(t.model.rects).selectExpr(
        "rect_id", "tile_x", "tile_y", "greatest(x, tile_x * 256) AS cx", "greatest(y, tile_y * 256) AS cy",
        "least(x + w, tile_x * 256 + 256) - greatest(x, tile_x * 256) AS cw", "least(y + h, tile_y * 256 + 256) - greatest(y, tile_y * 256) AS ch",
    )


@query("x12_tile_counts", f"WITH {RECTS_SQL} SELECT rect_id, (w + 255) // 256 AS across, (h + 255) // 256 AS down, ((w + 255) // 256) * ((h + 255) // 256) AS tiles FROM rects")
def x12(t: Tables) -> DataFrame:
    return t.model.rects.selectExpr("rect_id", "(w + 255) div 256 AS across", "(h + 255) div 256 AS down", "((w + 255) div 256) * ((h + 255) div 256) AS tiles")


@query("u5_rect_geometry", f"WITH {RECTS_SQL} SELECT rect_id, least(x, 512) AS ux, least(y, 512) AS uy, greatest(x + w, 768) AS ur, greatest(y + h, 768) AS ub, greatest(least(x + w, 768) - greatest(x, 512), 0) * greatest(least(y + h, 768) - greatest(y, 512), 0) AS common FROM rects")
def u5(t: Tables) -> DataFrame:
    """Union and intersection with a fixed rectangle."""
    return t.model.rects.selectExpr(
        "rect_id", "least(x, 512) AS ux", "least(y, 512) AS uy", "greatest(x + w, 768) AS ur", "greatest(y + h, 768) AS ub", "greatest(least(x + w, 768) - greatest(x, 512), 0) * greatest(least(y + h, 768) - greatest(y, 512), 0) AS common"
    )


@query("p11_tile_membership", "SELECT o_orderkey, o_orderkey % 64 % 8 AS col, o_orderkey % 64 // 8 AS row FROM orders WHERE o_orderkey % 64 % 8 BETWEEN 2 AND 4 AND o_orderkey % 64 // 8 BETWEEN 1 AND 5")
def p11(t: Tables) -> DataFrame:
    placed = t["orders"].selectExpr("o_orderkey", "o_orderkey % 64 % 8 AS col", "o_orderkey % 64 div 8 AS row")
    return placed.filter(F.col("col").between(2, 4) & F.col("row").between(1, 5))


@query("t2_placement", "WITH p AS (SELECT o_orderkey % 4096 - 700 AS x, o_custkey % 2500 - 200 AS y, o_totalprice AS v, o_orderkey AS k FROM orders) SELECT k, x, y, v FROM p WHERE x BETWEEN 0 AND 2047 AND y BETWEEN 0 AND 2047")
def t2(t: Tables) -> DataFrame:
    """Pixels shifted onto the canvas; what falls outside drops out."""
    placed = t["orders"].selectExpr("o_orderkey AS k", "o_orderkey % 4096 - 700 AS x", "o_custkey % 2500 - 200 AS y", "o_totalprice AS v")
    return placed.filter(F.col("x").between(0, CANVAS - 1) & F.col("y").between(0, CANVAS - 1))


@query("t3_rect_tiles", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT rect_id, tile_x, tile_y FROM tl")
def t3(t: Tables) -> DataFrame:
    return explode_tiles(t.model.rects).select("rect_id", "tile_x", "tile_y")


@query("t4_tile_work_lists", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT tile_x, tile_y, count(*) AS n, string_agg(rect_id, ',' ORDER BY rect_id) AS work FROM tl GROUP BY tile_x, tile_y")
def t4(t: Tables) -> DataFrame:
    """T4: the ordered work of each tile."""
    lists = explode_tiles(t.model.rects).groupBy("tile_x", "tile_y").agg(F.array_sort(F.collect_list("rect_id")).alias("ids"))
    return lists.select("tile_x", "tile_y", F.size("ids").cast("bigint").alias("n"), F.array_join("ids", ",").alias("work"))


@query("j17_tile_grid", "SELECT x AS tile_x, y AS tile_y FROM range(8) a(x), range(8) b(y)")
def j17(t: Tables) -> DataFrame:
    """All tiles of a canvas, from two sequences."""
    return t.spark.range(CANVAS // 256).select(F.col("id").alias("tile_x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CANVAS // 256 - 1).cast("bigint"))).alias("tile_y"))


@query("t6_slot_address", "SELECT o_orderkey AS slot, o_orderkey // 1024 AS atlas, o_orderkey % 1024 % 32 * 256 AS x, o_orderkey % 1024 // 32 * 256 AS y FROM orders")
def t6(t: Tables) -> DataFrame:
    """A slot's atlas and place, 32 by 32 slots each."""
    return t["orders"].selectExpr("o_orderkey AS slot", "o_orderkey div 1024 AS atlas", "o_orderkey % 1024 % 32 * 256 AS x", "o_orderkey % 1024 div 32 * 256 AS y")


@query("t7_sparse_region", f"WITH {RECTS_SQL}, tl AS ({_TILED}), b AS (SELECT fill, min(tile_x) * 256 AS l, min(tile_y) * 256 AS t, (max(tile_x) + 1) * 256 AS r, (max(tile_y) + 1) * 256 AS b FROM tl GROUP BY fill) SELECT fill, greatest(l, 300) AS l, greatest(t, 300) AS t, least(r, 1700) AS r, least(b, 1700) AS b FROM b WHERE least(r, 1700) > greatest(l, 300) AND least(b, 1700) > greatest(t, 300)")
def t7(t: Tables) -> DataFrame:
    """The bounds of stored tiles, cut to what is visible."""
    b = explode_tiles(t.model.rects).groupBy("fill").agg(
        F.greatest(F.min("tile_x") * 256, F.lit(300)).alias("l"), F.greatest(F.min("tile_y") * 256, F.lit(300)).alias("t"),
        F.least((F.max("tile_x") + 1) * 256, F.lit(1700)).alias("r"), F.least((F.max("tile_y") + 1) * 256, F.lit(1700)).alias("b"),
    )
    return b.filter("r > l AND b > t")


@query("t8_atlas_chunks", f"WITH {RECTS_SQL}, tl AS ({_TILED}), n AS (SELECT *, row_number() OVER (PARTITION BY fill ORDER BY rect_id, tile_y, tile_x) - 1 AS slot FROM tl) SELECT fill, rect_id, tile_x, tile_y, slot, slot % 32 * 256 AS ax, slot // 32 * 256 AS ay FROM n")
def t8(t: Tables) -> DataFrame:
    """The tiles of each source group on consecutive slots."""
    slot = (F.row_number().over(Window.partitionBy("fill").orderBy("rect_id", "tile_y", "tile_x")) - 1).cast("bigint")
    return explode_tiles(t.model.rects).withColumn("slot", slot).selectExpr("fill", "rect_id", "tile_x", "tile_y", "slot", "slot % 32 * 256 AS ax", "slot div 32 * 256 AS ay")


def pack_shelves(rects: list[tuple[int, int]], limit: int = 8192) -> list[tuple[int, int]] | None:
    """T5: places on shelves of the root of the area, left to right; None if it can't fit."""
    import math

    if not rects or max(w for w, _ in rects) > limit:
        return None
    area = sum(w * h for w, h in rects)
    width = min(max(math.isqrt(area - 1) + 1 if area else 0, max(w for w, _ in rects)), limit)
    x = y = shelf = 0
    out = []
    for w, h in rects:
        if x and x + w > width:
            x, y, shelf = 0, y + shelf, 0
        if y + h > limit:
            return None
        out.append((x, y))
        x, shelf = x + w, max(shelf, h)
    return out


@query("t5_shelf_packing")
def t5(t: Tables) -> DataFrame:
    """T5: one atlas for each group; a fold in order has no form in sets, so a group's rectangles meet in one task."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rect_id")
        at = pack_shelves(list(zip(group["w"], group["h"], strict=True)))
        return pd.DataFrame({"fill": group["fill"], "rect_id": group["rect_id"], "ax": [a for a, _ in at] if at else -1, "ay": [b for _, b in at] if at else -1})

    return t.model.rects.groupBy("fill").applyInPandas(pack, "fill bigint, rect_id bigint, ax bigint, ay bigint")


def coalesce_rects(rects: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) joined until none overlap or touch, in order of y, x, width and height."""
    todo = sorted(r for r in rects if r[2] > r[0] and r[3] > r[1])
    done: list[tuple[int, int, int, int]] = []
    while todo:
        a = todo.pop()
        near = [b for b in done if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]]
        if not near:
            done.append(a)
            continue
        done = [b for b in done if b not in near]
        todo.append((min(a[0], *(b[0] for b in near)), min(a[1], *(b[1] for b in near)), max(a[2], *(b[2] for b in near)), max(a[3], *(b[3] for b in near))))
    return sorted(done, key=lambda r: (r[1], r[0], r[2] - r[0], r[3] - r[1]))


@query("t10_rect_coalescing")
def t10(t: Tables) -> DataFrame:
    """Dirty rectangles of each group joined to a fixpoint."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        boxes = coalesce_rects(set(zip(group["x"], group["y"], group["x"] + group["w"], group["y"] + group["h"], strict=True)))
        return pd.DataFrame([(group["fill"].iloc[0], a, b, c - a, d - b) for a, b, c, d in boxes], columns=["fill", "x", "y", "w", "h"])

    return t.model.rects.groupBy("fill").applyInPandas(join, "fill bigint, x bigint, y bigint, w bigint, h bigint")


@query("e36_dirty_output_tiles", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT rect_id % 10 AS frame, count(DISTINCT (tile_x, tile_y)) AS tiles FROM tl GROUP BY 1")
def e36(t: Tables) -> DataFrame:
    return explode_tiles(t.model.rects).groupBy((F.col("rect_id") % 10).alias("frame")).agg(F.count_distinct("tile_x", "tile_y").alias("tiles"))


def sums_in_rects(points: DataFrame, rects: DataFrame, side: int) -> DataFrame:
    """(rect_id, pixels, ids) of rects(rect_id, x, y, w, h): how many of points(px, py, id) on a canvas of that side lie within, and the sum of their ids; rectangles without any are left out.

    A summed-area table of the canvas, one row for each place, gives both at
    the four corners of a rectangle, so work grows with points and rectangles
    and not with their pairs.
    """
    canvas = points.sparkSession.range(side * side).select((F.col("id") % side).alias("px"), F.expr(f"id div {side}").alias("py"))
    here = points.groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    rows = lambda part, order: Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    table = canvas.join(here, ["px", "py"], "left")
    for window in (rows("py", "px"), rows("px", "py")):
        table = table.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(window) for c in ("n", "ids")})
    # a rectangle's last column and row on the canvas, and those before its first; what lies before the canvas adds nothing
    ends = {"x": [f"least(x + w, {side}) - 1", f"least(x, {side}) - 1"], "y": [f"least(y + h, {side}) - 1", f"least(y, {side}) - 1"]}
    corners = F.explode(F.array(*(F.struct(F.expr(p).alias("px"), F.expr(q).alias("py"), F.lit(1 if i == j else -1).alias("sign")) for i, p in enumerate(ends["x"]) for j, q in enumerate(ends["y"]))))
    looked = rects.filter("w > 0 AND h > 0").select("rect_id", corners.alias("c")).select("rect_id", "c.*").filter("px >= 0 AND py >= 0")
    sums = looked.join(table, ["px", "py"]).groupBy("rect_id").agg(F.sum(F.col("sign") * F.col("n")).alias("pixels"), F.sum(F.col("sign") * F.col("ids")).alias("ids"))
    return sums.filter("pixels > 0")


@query("e37_patch_extraction", f"WITH {RECTS_SQL} SELECT rect_id, count(*) AS pixels, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM rects JOIN orders ON o_orderkey % 2048 >= x AND o_orderkey % 2048 < x + w AND o_custkey % 2048 >= y AND o_custkey % 2048 < y + h GROUP BY rect_id")
def e37(t: Tables) -> DataFrame:
    """Pixels inside rectangles."""
    return sums_in_rects(t["orders"].selectExpr("o_orderkey AS id", "o_orderkey % 2048 AS px", "o_custkey % 2048 AS py"), t.model.rects, 2048)


