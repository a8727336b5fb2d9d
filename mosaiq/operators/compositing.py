"""Compositing as an ordered fold per pixel (C1 to C13), on rows (pixel, events in order).

A pixel's events are folded by one aggregate expression over a sorted array,
so a pixel's rows meet once and nothing leaves the JVM. Groups are pixels and
so are as long as the stack of layers, whatever the size of the image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.model import PIXELS_SQL

EVENT = "struct<ord:bigint,sr:bigint,sg:bigint,sb:bigint,sa:bigint,mask:bigint,opacity:bigint>"
FIELDS = ("ord", "sr", "sg", "sb", "sa", "mask", "opacity")
WHITE = {"r": 255, "g": 255, "b": 255, "a": 0}


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division of numbers that aren't negative, exact up to 2**52."""
    return F.floor(a / b).cast("bigint")


def _min(a: Column, b: int | Column) -> Column:
    return F.least(a, F.lit(b) if isinstance(b, int) else b)


def normal_over(acc: Column, x: Column, alpha: Column) -> Column:
    """B0 on an accumulator struct r, g, b, a."""
    carry = idiv(acc["a"] * (255 - alpha), 255)
    oa = _min(carry + alpha, 255)
    channel = lambda c: _min(idiv(x[f"s{c}"] * alpha + acc[c] * carry + F.greatest(idiv(oa - 1, 2), F.lit(0)), F.greatest(oa, F.lit(1))), 255)
    done = F.struct(*(channel(c).cast("bigint").alias(c) for c in "rgb"), oa.cast("bigint").alias("a"))
    return F.when(alpha == 0, acc).otherwise(done)


def event_alpha(x: Column) -> Column:
    return idiv(idiv(x["sa"] * x["mask"], 255) * x["opacity"], 256)


def start(**extra: Column) -> Column:
    return F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in WHITE.items()), *(v.alias(k) for k, v in extra.items()))


def ordered_events(pixels: DataFrame) -> DataFrame:
    """(px, events): each pixel's events in order; equal ordinals go by all values."""
    return pixels.groupBy("px").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("events"))


def fold(stacks: DataFrame, init: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    return stacks.select("px", F.aggregate("events", init, merge).alias("out"))


def composite_normal(pixels: DataFrame) -> DataFrame:
    """Normal over, from transparent white."""
    done = fold(ordered_events(pixels), start(), lambda acc, x: normal_over(acc, x, event_alpha(x)))
    return done.select("px", "out.r", "out.g", "out.b", "out.a")


_EVENTS = "list({'ord': ord, 'sr': sr, 'sg': sg, 'sb': sb, 'sa': sa, 'mask': mask, 'opacity': opacity} ORDER BY ord, sr, sg, sb, sa, mask, opacity)"
_INIT = "{'r': 255::BIGINT, 'g': 255::BIGINT, 'b': 255::BIGINT, 'a': 0::BIGINT}"
_ALPHA = "((x.sa * x.mask // 255) * x.opacity // 256)"


def _over_sql(alpha: str, acc: str = "acc") -> str:
    carry = f"({acc}.a * (255 - {alpha}) // 255)"
    oa = f"least({carry} + {alpha}, 255)"
    channels = ", ".join(f"'{c}': least((x.s{c} * {alpha} + {acc}.{c} * {carry} + greatest(({oa} - 1) // 2, 0)) // greatest({oa}, 1), 255)" for c in "rgb")
    return f"CASE WHEN {alpha} = 0 THEN {acc} ELSE {{{channels}, 'a': {oa}}} END"


def _fold_sql(where: str = "", init: str = _INIT, step: str | None = None) -> str:
    return f"SELECT px, list_reduce({_EVENTS}, lambda acc, x: {step or _over_sql(_ALPHA)}, {init}) AS o FROM pixels {where} GROUP BY px"


_RGBA = "SELECT px, o.r AS r, o.g AS g, o.b AS b, o.a AS a FROM"


@query("c1_composite_normal", f"WITH {PIXELS_SQL} {_RGBA} ({_fold_sql()})")
def c1(t: Tables) -> DataFrame:
    return composite_normal(t.model.pixels)


@query("c2_solid_color", f"WITH {PIXELS_SQL} {_RGBA} (SELECT px, list_reduce({_EVENTS}, lambda acc, x: {_over_sql(_ALPHA)}, {{'r': 20::BIGINT, 'g': 40::BIGINT, 'b': 60::BIGINT, 'a': 255::BIGINT}}) AS o FROM pixels GROUP BY px)")
def c2(t: Tables) -> DataFrame:
    """A paper of one opaque colour under the stack."""
    paper = F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in zip("rgba", (20, 40, 60, 255), strict=True)))
    return fold(ordered_events(t.model.pixels), paper, lambda acc, x: normal_over(acc, x, event_alpha(x))).select("px", "out.*")


def _filtered(acc: Column, x: Column) -> Column:
    inverted = F.struct(*((255 - acc[c]).cast("bigint").alias(c) for c in "rgb"), acc["a"].alias("a"))
    return F.when(x["ord"] % 3 == 0, inverted).otherwise(normal_over(acc, x, event_alpha(x)))


@query("c3_point_filter", f"WITH {PIXELS_SQL} {_RGBA} ({_fold_sql(step='CASE WHEN x.ord % 3 = 0 THEN {' + ', '.join(f''''{c}': 255 - acc.{c}''' for c in 'rgb') + ', ' + chr(39) + 'a' + chr(39) + ': acc.a} ELSE ' + _over_sql(_ALPHA) + ' END')})")
def c3(t: Tables) -> DataFrame:
    """A filter among the events replaces the accumulator's colour."""
    return fold(ordered_events(t.model.pixels), start(), _filtered).select("px", "out.*")


def container(pixels: DataFrame, inside: Column, opacity: int) -> DataFrame:
    """C4: events where inside holds are folded apart from transparent white, then drawn as one with opacity over the fold of those before."""
    isolated = composite_normal(pixels.filter(inside)).select("px", *(F.col(c).alias(f"s{c}") for c in "rgba"))
    outside = composite_normal(pixels.filter(~inside)).select("px", F.struct("r", "g", "b", "a").alias("acc"))
    joined = outside.join(isolated, "px", "full").select("px", F.coalesce("acc", start()).alias("acc"), F.struct(*(F.coalesce(f"s{c}", F.lit(0)).alias(f"s{c}") for c in "rgba")).alias("x"))
    return joined.select("px", normal_over(F.col("acc"), F.col("x"), idiv(F.col("x.sa") * opacity, 256)).alias("out")).select("px", "out.*")


@query(
    "c4_container",
    f"""WITH {PIXELS_SQL}, i AS ({_fold_sql('WHERE ord > 3')}), o AS ({_fold_sql('WHERE ord <= 3')}),
j AS (SELECT coalesce(i.px, o.px) AS px, coalesce(o.o, {_INIT}) AS acc, {{'sr': coalesce(i.o.r, 0), 'sg': coalesce(i.o.g, 0), 'sb': coalesce(i.o.b, 0), 'sa': coalesce(i.o.a, 0)}} AS x FROM i FULL JOIN o ON i.px = o.px)
{_RGBA} (SELECT px, {_over_sql('(x.sa * 200 // 256)')} AS o FROM j)""",
)
def c4(t: Tables) -> DataFrame:
    return container(t.model.pixels, F.col("ord") > 3, 200)


def clip_step(acc: Column, x: Column) -> Column:
    """A clipped sibling: normal by the source's alpha, the base's alpha stays."""
    alpha = event_alpha(x)
    return F.struct(*(idiv(acc[c] * (255 - alpha) + x[f"s{c}"] * alpha + 127, 255).alias(c) for c in "rgb"), acc["a"].alias("a"))


@query(
    "c5_clipping_run",
    f"WITH {PIXELS_SQL} {_RGBA} ({_fold_sql(step='CASE WHEN x.ord = 1 THEN ' + _over_sql(_ALPHA) + ' ELSE {' + ', '.join(f''''{c}': (acc.{c} * (255 - {_ALPHA}) + x.s{c} * {_ALPHA} + 127) // 255''' for c in 'rgb') + ', ' + chr(39) + 'a' + chr(39) + ': acc.a} END')})",
)
def c5(t: Tables) -> DataFrame:
    """The first event is an isolated base, the others are clipped to it."""
    return fold(ordered_events(t.model.pixels), start(), lambda acc, x: F.when(x["ord"] == 1, normal_over(acc, x, event_alpha(x))).otherwise(clip_step(acc, x))).select("px", "out.*")


def through(before: Column, after: Column, strength: float) -> Column:
    """Between what was there before a group and after it, mixed premultiplied; nothing left is transparent white."""
    mix = lambda f: f(before) * (1.0 - strength) + f(after) * strength
    alpha = mix(lambda p: p["a"] / 255.0)
    rounded = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("bigint")
    safe = F.when(alpha > 0, alpha).otherwise(1.0)
    return F.struct(*(F.when(alpha > 0, rounded(mix(lambda p, c=c: p[c] / 255.0 * (p["a"] / 255.0)) / safe)).otherwise(255).cast("bigint").alias(c) for c in "rgb"), rounded(alpha).alias("a"))


def _through_sql(before: str, after: str, s: float) -> str:
    alpha = f"({before}.a / 255e0 * {1 - s!r}e0 + {after}.a / 255e0 * {s!r}e0)"
    rounded = lambda v: f"CAST(floor(least(greatest({v}, 0e0), 1e0) * 255e0 + 5e-1) AS BIGINT)"
    part = lambda c: f"({before}.{c} / 255e0 * ({before}.a / 255e0) * {1 - s!r}e0 + {after}.{c} / 255e0 * ({after}.a / 255e0) * {s!r}e0) / CASE WHEN {alpha} > 0 THEN {alpha} ELSE 1e0 END"
    return ", ".join(f"CASE WHEN {alpha} > 0 THEN {rounded(part(c))} ELSE 255 END AS {c}" for c in "rgb") + f", {rounded(alpha)} AS a"


@query("c6_through_group", f"WITH {PIXELS_SQL}, w AS ({_fold_sql()}), b AS (SELECT px, list_reduce(coalesce(list({_EVENTS[5:_EVENTS.index(' ORDER')]} ORDER BY ord, sr, sg, sb, sa, mask, opacity) FILTER (ord <= 3), []), lambda acc, x: {_over_sql(_ALPHA)}, {_INIT}) AS o FROM pixels GROUP BY px) SELECT w.px, {_through_sql('b.o', 'w.o', 0.5)} FROM w JOIN b ON w.px = b.px")
def c6(t: Tables) -> DataFrame:
    """One pass: the fold keeps the state before the group's first event."""
    state = lambda acc: F.struct(acc["r"].alias("r"), acc["g"].alias("g"), acc["b"].alias("b"), acc["a"].alias("a"))

    def step(acc: Column, x: Column) -> Column:
        now = normal_over(acc["now"], x, event_alpha(x))
        return F.struct(now.alias("now"), F.when(x["ord"] <= 3, now).otherwise(acc["before"]).alias("before"))

    done = fold(ordered_events(t.model.pixels), F.struct(start().alias("now"), start().alias("before")), step)
    return done.select("px", through(state(F.col("out.before")), state(F.col("out.now")), 0.5).alias("out")).select("px", "out.*")


@query("c8_region", f"WITH {PIXELS_SQL} {_RGBA} ({_fold_sql('WHERE px BETWEEN 200 AND 800')})")
def c8(t: Tables) -> DataFrame:
    """A region; the predicate on pixels is pushed below the fold into the scan."""
    return composite_normal(t.model.pixels).filter(F.col("px").between(200, 800))


@query("c10_resume_checkpoint", f"WITH {PIXELS_SQL} {_RGBA} ({_fold_sql()})")
def c10(t: Tables) -> DataFrame:
    """The fold goes on from the state that a prefix of the events left."""
    p = t.model.pixels
    prefix = composite_normal(p.filter("ord <= 2")).select("px", F.struct("r", "g", "b", "a").alias("init"))
    rest = ordered_events(p.filter("ord > 2"))
    both = prefix.join(rest, "px", "full").select("px", F.coalesce("init", start()).alias("init"), F.coalesce("events", F.array().cast(f"array<{EVENT}>")).alias("events"))
    return both.select("px", F.aggregate("events", F.col("init"), lambda acc, x: normal_over(acc, x, event_alpha(x))).alias("out")).select("px", "out.*")


def trace(pixels: DataFrame) -> DataFrame:
    """C11: the accumulator after each event."""
    init = F.struct(start().alias("now"), F.array().cast("array<struct<r:bigint,g:bigint,b:bigint,a:bigint>>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = normal_over(acc["now"], x, event_alpha(x))
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    return fold(ordered_events(pixels), init, step).select("px", F.posexplode("out.all").alias("step", "s")).select("px", F.col("step").cast("bigint").alias("step"), "s.*")


@query("c11_pixel_trace", f"WITH {PIXELS_SQL}, e AS (SELECT px, {_EVENTS} AS ev FROM pixels GROUP BY px), s AS (SELECT px, ev, unnest(range(1, len(ev) + 1)) AS n FROM e) SELECT px, n - 1 AS step, o.r AS r, o.g AS g, o.b AS b, o.a AS a FROM (SELECT px, n, list_reduce(ev[1:n], lambda acc, x: {_over_sql(_ALPHA)}, {_INIT}) AS o FROM s)")
def c11(t: Tables) -> DataFrame:
    return trace(t.model.pixels)


@query("c12_direct_copy", f"WITH {PIXELS_SQL} SELECT px, arg_max(sr, [ord, sr, sg, sb]) AS r, arg_max(sg, [ord, sr, sg, sb]) AS g, arg_max(sb, [ord, sr, sg, sb]) AS b FROM pixels WHERE sa >= 128 GROUP BY px")
def c12(t: Tables) -> DataFrame:
    """Where sources are opaque the last writer wins: a partial aggregate, no list."""
    last = F.max(F.struct("ord", "sr", "sg", "sb"))
    return t.model.pixels.filter("sa >= 128").groupBy("px").agg(last.alias("x")).select("px", F.col("x.sr").alias("r"), F.col("x.sg").alias("g"), F.col("x.sb").alias("b"))


@query("k2_patch_payload", f"WITH {PIXELS_SQL}, f AS ({_fold_sql()}) SELECT px // 64 AS rect, string_agg(lpad(to_hex(o.r), 2, '0') || lpad(to_hex(o.g), 2, '0') || lpad(to_hex(o.b), 2, '0') || lpad(to_hex(o.a), 2, '0'), '' ORDER BY px) AS payload, 4 * count(*) AS bytes FROM f GROUP BY px // 64")
def k2(t: Tables) -> DataFrame:
    """K2: the rows of each rectangle as one payload, in order."""
    hexed = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgba"))
    rows = composite_normal(t.model.pixels).select(F.expr("px div 64").alias("rect"), F.struct("px", hexed.alias("h")).alias("x"))
    ordered = rows.groupBy("rect").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return ordered.select("rect", F.array_join(F.transform("xs", lambda x: x["h"]), "").alias("payload"), (4 * F.size("xs")).cast("bigint").alias("bytes"))
