"""Operators on pixels: blends, adjustment filters, image comparison (B, L, X13, A2 to A4, A9, J14, J15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.functions import blend, filters
from mosaiq.functions.blend import RGB, byte
from mosaiq.model import PIXELS_SQL
from mosaiq.plans.recipe import Recipe

KEYS = ["px", "ord"]
OUT = ["r", "g", "b", "a"]


def apply_blend(pixels: DataFrame, mode: int, preserve: bool = False) -> DataFrame:
    """Blends each row's source over its destination."""
    done = blend.blend(mode, preserve).apply(pixels)
    return done.select(*KEYS, *(F.col(c).cast("bigint").alias(c) for c in OUT))


def _tail(source: str) -> str:
    return f"SELECT px, ord, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in OUT)} FROM ({source})"


for _mode, _name in blend.MODES.items():
    query(f"b{_mode}_{_name}", f"WITH {PIXELS_SQL} " + _tail(blend.blend(_mode).sql("SELECT * FROM pixels")))(lambda t, m=_mode: apply_blend(t.model.pixels, m))
for _mode in (0, 2, 3, 9, 10, 12):
    query(f"b{_mode}_{blend.MODES[_mode]}_preserve_alpha", f"WITH {PIXELS_SQL} " + _tail(blend.blend(_mode, True).sql("SELECT * FROM pixels")))(lambda t, m=_mode: apply_blend(t.model.pixels, m, True))

LUMA = {"gradient": "CAST(least(greatest(floor(dr * 0.3 + dg * 0.59 + db * 0.11), 0.0), 255.0) AS BIGINT)", "threshold": "CAST(least(greatest(floor(dr * 0.299 + dg * 0.587 + db * 0.114), 0.0), 255.0) AS BIGINT)"}


def lut_recipe(tables: list[list[int]] | None, index: str = "channel") -> Recipe:
    """Maps destination channels by table (or all by a luminance), mixed in by opacity and mask; alpha stays."""
    out = Recipe()
    if tables is not None:
        luma = {} if index == "channel" else {"lum": LUMA[index]}
        if luma:
            out.add(**luma)
        pick = lambda k, c: f"{{get:{k}:{'lum' if luma else 'd' + c}}}"
        out.add(**{f"m_{c}": f"{pick(k, c)} / 255.0" for k, c in enumerate(RGB)})
    out.add(strength="least(greatest(opacity / 256.0, 0.0), 1.0) * (mask / 255.0)")
    return out.add(**{c: byte(f"d{c} / 255.0 * (1.0 - strength) + m_{c} * strength") for c in RGB}, a="da")


def _bound(recipe: Recipe, tables: list[list[int]] | None, spark: bool) -> Recipe:
    """Puts the tables in as literal arrays."""
    import re

    def array(m) -> str:  # noqa: ANN001
        values = ", ".join(map(str, tables[int(m[1])]))
        return f"element_at(array({values}), CAST({m[2]} AS INT) + 1)" if spark else f"[{values}][{m[2]} + 1]"

    return Recipe([{k: re.sub(r"\{get:(\d):(\w+)\}", array, v) for k, v in step.items()} for step in recipe.steps])


def apply_lut(pixels: DataFrame, tables: list[list[int]], index: str = "channel") -> DataFrame:
    done = _bound(lut_recipe(tables, index), tables, True).apply(pixels)
    return done.select(*KEYS, *(F.col(c).cast("bigint").alias(c) for c in OUT))


def apply_hsl(pixels: DataFrame, hue_turns: float, saturation: float, luminosity: float) -> DataFrame:
    """L4: HSL without a table."""
    done = lut_recipe(None).apply(filters.hsl(hue_turns, saturation, luminosity).apply(pixels))
    return done.select(*KEYS, *(F.col(c).cast("bigint").alias(c) for c in OUT))


CURVES = [[(0, 0), (20000, 30000), (45000, 40000), (65535, 65535)], [(0, 0), (65535, 60000)]]
STOPS = [(0.0, (10, 20, 30)), (0.4, (200, 30, 90)), (1.0, (255, 250, 240))]
LUTS = {
    "l1_brightness_contrast": ([filters.brightness_contrast(20, -10)] * 3, "channel"),
    "l2_levels": ([filters.levels(0, 20000, 65535, 0, 65535)] * 3, "channel"),
    "l3_tone_curve": (filters.tone_curve(CURVES), "channel"),
    "l5_color_balance": (filters.color_balance(1, (0, 0, 0), (43, -48, 48), (0, 0, 0)), "channel"),
    "l5_color_balance_normal": (filters.color_balance(0, (-20, 10, 35), (40, -30, 15), (25, 0, -50)), "channel"),
    "l6_invert": ([filters.invert()] * 3, "channel"),
    "l7_posterize": ([filters.posterize(4)] * 3, "channel"),
    "l8_threshold": ([filters.threshold(128)] * 3, "threshold"),
    "l9_gradient_map": (filters.gradient_map(STOPS), "gradient"),
}
for _name, (_tables, _index) in LUTS.items():
    query(_name, f"WITH {PIXELS_SQL} " + _tail(_bound(lut_recipe(_tables, _index), _tables, False).sql("SELECT * FROM pixels")))(lambda t, a=_tables, i=_index: apply_lut(t.model.pixels, a, i))
query("l4_hsl", f"WITH {PIXELS_SQL} " + _tail(lut_recipe(None).sql(filters.hsl(30 / 360, -0.25, 0.25).sql("SELECT * FROM pixels"))))(lambda t: apply_hsl(t.model.pixels, 30 / 360, -0.25, 0.25))


@query(
    "j14_lut_join",
    f"WITH {PIXELS_SQL}, lut AS (SELECT v, 255 - v AS inv FROM range(256) r(v)) SELECT px, ord, r.inv AS r, g.inv AS g, b.inv AS b FROM pixels JOIN lut r ON dr = r.v JOIN lut g ON dg = g.v JOIN lut b ON db = b.v",
)
def lut_join(t: Tables) -> DataFrame:
    """The lookup table as a table of 256 rows, broadcast."""
    lut = F.broadcast(t.spark.range(256).withColumn("inv", 255 - F.col("id")))
    out = t.model.pixels
    for c in RGB:
        out = out.join(lut.select(F.col("id").alias(f"id_{c}"), F.col("inv").alias(c)), F.col(f"d{c}") == F.col(f"id_{c}"))
    return out.select(*KEYS, *RGB)


@query(
    "j15_mask_join",
    f"WITH {PIXELS_SQL}, masks AS (SELECT px, max(mask) AS value FROM pixels WHERE px % 3 <> 0 GROUP BY px) SELECT p.px, ord, (sa * coalesce(value, 255)) // 255 AS a FROM pixels p LEFT JOIN masks m ON p.px = m.px",
)
def mask_join(t: Tables) -> DataFrame:
    """Masks by position, with the fill where a mask has no pixel."""
    p = t.model.pixels
    masks = p.filter("px % 3 <> 0").groupBy("px").agg(F.max("mask").alias("value"))
    return p.join(masks, "px", "left").select("px", "ord", F.expr("(sa * coalesce(value, 255)) div 255").alias("a"))


def compare_images(pairs: DataFrame) -> DataFrame:
    """A2, A3: differences of sr..sa and dr..da over all channels, raw and premultiplied, and where the largest is first."""
    raw = F.array(*(F.abs(F.col(f"s{c}") - F.col(f"d{c}")) for c in "rgba"))
    pre = lambda p, c: F.expr(f"({p}{c} * {p}a + 127) div 255")
    mul = F.array(*(F.abs(pre("s", c) - pre("d", c)) for c in RGB), F.abs(F.col("sa") - F.col("da")))
    rows = pairs.select("px", "ord", raw.alias("raw"), mul.alias("mul"))
    worst = rows.select("px", "ord", "raw", "mul", F.array_max("raw").alias("top")).withColumn("channel", F.array_position("raw", F.col("top")) - 1)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y)
    over = lambda c, n: F.size(F.filter(c, lambda x: x > n)).cast("bigint")
    first = F.min_by(F.struct("px", "ord", "channel"), F.struct(-F.col("top"), F.col("px"), F.col("ord"), F.col("channel")))
    out = worst.agg(
        F.max("top").alias("raw_max"), F.sum(add("raw")).alias("raw_sum"), F.sum(over("raw", 0)).alias("raw_over_0"), F.sum(over("raw", 1)).alias("raw_over_1"),
        F.max(F.array_max("mul")).alias("premul_max"), F.sum(add("mul")).alias("premul_sum"), F.sum(over("mul", 1)).alias("premul_over_1"), F.count(F.lit(1)).alias("pixels"), first.alias("at"),
    )
    return out.select("*", "at.*").drop("at").withColumn("raw_mean", F.col("raw_sum") / (4 * F.col("pixels")))


_PRE = ", ".join(f"abs((s{c} * sa + 127) // 255 - (d{c} * da + 127) // 255)" for c in RGB)


@query(
    "a2_image_diff",
    f"""WITH {PIXELS_SQL}, d AS (SELECT px, ord, [abs(sr - dr), abs(sg - dg), abs(sb - db), abs(sa - da)] AS raw, [{_PRE}, abs(sa - da)] AS mul FROM pixels),
w AS (SELECT *, list_max(raw) AS top, list_position(raw, list_max(raw)) - 1 AS channel FROM d),
f AS (SELECT px, ord, channel FROM w ORDER BY top DESC, px, ord, channel LIMIT 1)
SELECT max(top) AS raw_max, CAST(sum(list_sum(raw)) AS BIGINT) AS raw_sum, CAST(sum(len(list_filter(raw, lambda x: x > 0))) AS BIGINT) AS raw_over_0, CAST(sum(len(list_filter(raw, lambda x: x > 1))) AS BIGINT) AS raw_over_1,
max(list_max(mul)) AS premul_max, CAST(sum(list_sum(mul)) AS BIGINT) AS premul_sum, CAST(sum(len(list_filter(mul, lambda x: x > 1))) AS BIGINT) AS premul_over_1, count(*) AS pixels,
(SELECT px FROM f) AS px, (SELECT ord FROM f) AS ord, CAST((SELECT channel FROM f) AS BIGINT) AS channel, CAST(sum(list_sum(raw)) AS DOUBLE) / (4 * count(*)) AS raw_mean FROM w""",
)
def image_diff(t: Tables) -> DataFrame:
    return compare_images(t.model.pixels)


@query(
    "a4_byte_diff",
    f"WITH {PIXELS_SQL} SELECT px, sum(CAST(sr <> dr AS BIGINT) + CAST(sg <> dg AS BIGINT) + CAST(sb <> db AS BIGINT) + CAST(sa <> da AS BIGINT))::BIGINT AS differing, max(ord) - count(*) AS length_gap FROM pixels GROUP BY px",
)
def byte_diff(t: Tables) -> DataFrame:
    """A4: bytes that differ, and how far the lengths do."""
    n = sum((F.col(f"s{c}") != F.col(f"d{c}")).cast("bigint") for c in "rgba")
    return t.model.pixels.groupBy("px").agg(F.sum(n).alias("differing"), (F.max("ord") - F.count(F.lit(1))).alias("length_gap"))


_CHANNELS = " UNION ALL ".join(f"SELECT '{c}' AS channel, s{c} AS v FROM pixels" for c in "rgba")


@query("a9_channel_summary", f"WITH {PIXELS_SQL}, c AS ({_CHANNELS}) SELECT channel, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, count(*) FILTER (v <> 0) AS nonzero FROM c GROUP BY channel")
def channel_summary(t: Tables) -> DataFrame:
    """Each channel's range, mean and count of nonzero values, in one scan."""
    long = t.model.pixels.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"s{c}").alias("v")) for c in "rgba"))).alias("x")).select("x.*")
    return long.groupBy("channel").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"), F.count_if(F.col("v") != 0).alias("nonzero"))


@query("a12_fully_opaque", f"WITH {PIXELS_SQL} SELECT px, bool_and(sa >= 128) AS opaque FROM pixels GROUP BY px")
def fully_opaque(t: Tables) -> DataFrame:
    return t.model.pixels.groupBy("px").agg(F.bool_and(F.col("sa") >= 128).alias("opaque"))


@query("x13_premultiply", f"WITH {PIXELS_SQL} SELECT px, ord, (sr * sa + 127) // 255 AS r, (sg * sa + 127) // 255 AS g, (sb * sa + 127) // 255 AS b, sa AS a FROM pixels")
def premultiply(t: Tables) -> DataFrame:
    return t.model.pixels.select("px", "ord", *(F.expr(f"(s{c} * sa + 127) div 255").alias(c) for c in RGB), F.col("sa").alias("a"))


@query("k4_upload_floats", f"WITH {PIXELS_SQL}, h AS (SELECT max(ord) AS h FROM pixels) SELECT px AS x, h.h - ord AS y, sr / 255e0 AS r, sg / 255e0 AS g, sb / 255e0 AS b, sa / 255e0 AS a FROM pixels, h")
def upload_floats(t: Tables) -> DataFrame:
    """K4: rows upside down and channels as fractions."""
    p = t.model.pixels
    height = F.broadcast(p.agg(F.max("ord").alias("h")))  # one row
    return p.join(height).select(F.col("px").alias("x"), (F.col("h") - F.col("ord")).alias("y"), *((F.col(f"s{c}") / 255.0).alias(c) for c in "rgba"))


@query("k5_apply_patches", f"WITH {PIXELS_SQL}, patch AS (SELECT px, ord, max(sr) AS r FROM pixels WHERE px % 4 = 1 GROUP BY px, ord) SELECT p.px, p.ord, coalesce(r, dr) AS r FROM pixels p LEFT JOIN patch USING (px, ord)")
def apply_patches(t: Tables) -> DataFrame:
    """K5: patch values where there are any, else the image's."""
    p = t.model.pixels
    patch = p.filter("px % 4 = 1").groupBy("px", "ord").agg(F.max("sr").alias("r"))
    return p.join(patch, ["px", "ord"], "left").select("px", "ord", F.coalesce("r", "dr").alias("r"))


@query("k7_scanline", f"WITH {PIXELS_SQL} SELECT px AS x, sr, sg, sb, sa FROM pixels WHERE ord = 3")
def scanline(t: Tables) -> DataFrame:
    return t.model.pixels.filter("ord = 3").select(F.col("px").alias("x"), "sr", "sg", "sb", "sa")


@query("k8_layer_window", f"WITH {PIXELS_SQL} SELECT px, ord, sr, sg, sb, sa FROM pixels WHERE px BETWEEN 100 - 8 AND 100 + 8 AND ord BETWEEN 2 AND 4")
def layer_window(t: Tables) -> DataFrame:
    """K8: pixels within a radius of a point; the predicate reaches the scan as a range of the key."""
    return t.model.pixels.filter(F.col("px").between(100 - 8, 100 + 8) & F.col("ord").between(2, 4)).select("px", "ord", "sr", "sg", "sb", "sa")
