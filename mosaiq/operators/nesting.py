"""Nested scopes as they stand in the layer tree (E3, E4, E10, B30, C4, C6, C7, C13): one fold whose state is a stack of accumulators.

The tree's preorder gives each layer a place and the place where its subtree
ends. A pixel's events are the draws of its leaves, and for each scope around
one of them a begin at the scope's place and an end at its subtree's end, so
nesting of any depth comes from the tree. A begin pushes an accumulator: an
empty one for a container or a clipping run, a copy of the one below for a
group that is drawn through. An end pops it and lays it over the one below.
The pixels of a batch are folded side by side, an event of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.model import PIXELS
from mosaiq.operators.compositing import WHITE, event_alpha
from mosaiq.operators.hierarchy import SCOPE, WALK_SQL, along_ancestors, preorder
from mosaiq.registry import Tables, query

#: What an event does; events at one place go by these numbers, ends of inner scopes before those of outer ones.
END, BEGIN, DRAW = 0, 1, 2
#: Kinds of scopes: drawn apart, drawn through, and a base with the siblings that are clipped to it.
CONTAINER, THROUGH, CLIP_RUN = 0, 1, 2
START = np.array([[WHITE[c]] for c in "rgba"], float)


def scopes_of(plan: DataFrame, layers: DataFrame) -> DataFrame:
    """(node_id, place, until, level, kind, strength, clipped, up) of the scopes of a tree, where place and until are the events' places.

    plan is the preorder (node_id, layer_id, parent, tree_depth, subtree_end).
    A layer that opens a scope and has something below it is one; a base and
    the clipped siblings right after it are another around them. Scopes of one
    place nest by level.
    """
    facts = layers.select("layer_id", "clip", "opacity", F.expr(SCOPE).alias("scope"))
    rows = plan.join(facts, "layer_id")
    siblings = Window.partitionBy("parent").orderBy("node_id")
    runs = rows.filter("parent is not null").withColumn("run", F.sum(1 - F.col("clip")).over(siblings)).filter("run > 0")
    based = runs.groupBy("parent", "run").agg(F.min("node_id").alias("place"), F.max("subtree_end").alias("until"), F.count(F.lit(1)).alias("n"), F.min(F.struct("node_id", "tree_depth"))["tree_depth"].alias("tree_depth")).filter("n > 1")
    own = rows.filter("scope in ('container', 'through') and subtree_end > node_id + 1").select(F.col("node_id").alias("place"), F.col("subtree_end").alias("until"), (2 * F.col("tree_depth") + 1).alias("level"), F.when(F.col("scope") == "through", THROUGH).otherwise(CONTAINER).alias("kind"), F.col("opacity").alias("strength"), F.col("clip").alias("clipped"))
    return own.union(based.select("place", "until", 2 * F.col("tree_depth"), F.lit(CLIP_RUN), F.lit(256).cast("bigint"), F.lit(0).cast("bigint")))


def scope_paths(plan: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer_id, node_id, clip, scopes) of the nodes of a tree: the scopes around each, found along the links to its ancestors."""
    scopes = scopes_of(plan, layers)
    kind = "struct<place:bigint,until:bigint,level:bigint,kind:bigint,strength:bigint,clipped:bigint>"
    packed = F.struct("place", "until", "level", F.col("kind").cast("bigint").alias("kind"), F.col("strength").cast("bigint").alias("strength"), F.col("clipped").cast("bigint").alias("clipped"))
    own = scopes.filter(F.col("kind") != CLIP_RUN).select(F.col("place").alias("node_id"), F.array(packed).alias("own"))
    siblings = Window.partitionBy("parent").orderBy("node_id")
    clips = layers.select("layer_id", "clip")
    placed = plan.join(clips, "layer_id").withColumn("head", F.when(F.col("parent").isNotNull(), F.max(F.when(F.col("clip") == 0, F.col("node_id"))).over(siblings)))
    runs = scopes.filter(F.col("kind") == CLIP_RUN).select(F.col("place").alias("head"), F.array(packed).alias("run"))
    none = F.array().cast(f"array<{kind}>")
    with_own = placed.join(own, "node_id", "left").join(runs, "head", "left")
    nodes = with_own.select("layer_id", F.col("parent").alias("up"), F.concat(F.coalesce("own", none), F.coalesce("run", none)).alias("scopes"))
    paths = along_ancestors(nodes, {"scopes": lambda a, b: F.concat(a, b)})
    return placed.select("layer_id", "node_id", "clip").join(paths, "layer_id")


def pixel_events(draws: DataFrame, paths: DataFrame) -> DataFrame:
    """(px, events) of draws(px, layer_id, ord, sr, sg, sb, alpha): a pixel's draws and the begins and ends around them, in order.

    Draws are dealt out by pixel once, each with the scopes around it; begins
    and ends are made where a pixel's draws have met.
    """
    drawn = draws.join(paths, "layer_id")
    zero = F.lit(0).cast("bigint")

    def event(place: Column, what: int, tie: Column, **v: Column) -> Column:
        at = F.struct(place.alias("place"), F.lit(what).alias("what"), tie.cast("bigint").alias("tie"))
        return F.struct(at.alias("at"), *(v.get(k, zero).cast("bigint").alias(k) for k in ("sr", "sg", "sb", "alpha", "kind", "strength", "clipped")))

    draw = event(F.col("node_id"), DRAW, F.col("ord"), sr=F.col("sr"), sg=F.col("sg"), sb=F.col("sb"), alpha=F.col("alpha"), clipped=F.col("clip"))
    # dealt out before they are gathered: few draws of a pixel stand in one task by then
    stacks = drawn.select("px", draw.alias("draw"), "scopes").repartition("px").groupBy("px").agg(F.collect_list("draw").alias("draws"), F.sort_array(F.flatten(F.collect_list("scopes"))).alias("around"))
    once = stacks.select("px", "draws", F.filter("around", lambda s, k: (k == 0) | (s != F.get("around", k - 1))).alias("around"))
    begin = F.transform("around", lambda s: event(s["place"], BEGIN, s["level"], kind=s["kind"]))
    end = F.transform("around", lambda s: event(s["until"], END, -(s["place"] * 100_000 + s["level"]), kind=s["kind"], strength=s["strength"], clipped=s["clipped"]))
    return once.select("px", F.sort_array(F.concat("draws", begin, end)).alias("events"))


def floored(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return np.floor(a / b)


def clipped_over(acc: np.ndarray, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """A sibling clipped to acc: normal by alpha, while acc's own alpha stays."""
    return np.vstack([floored(acc[:3] * (255 - alpha) + x * alpha + 127, 255), acc[3:]])


def normal_over(acc: np.ndarray, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """B0, as in compositing."""
    carry = floored(acc[3] * (255 - alpha), 255)
    oa = np.fmin(carry + alpha, 255)
    over = floored(x * alpha + acc[:3] * carry + np.fmax(floored(oa - 1, 2), 0), np.fmax(oa, 1))
    return np.where(alpha == 0, acc, np.vstack([np.fmin(over, 255), oa]))


def lay(acc: np.ndarray, x: np.ndarray, alpha: np.ndarray, clipped: np.ndarray) -> np.ndarray:
    return np.where(clipped == 1, clipped_over(acc, x, alpha), normal_over(acc, x, alpha))


def through(before: np.ndarray, after: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """C6, as in compositing: what was there before a group and after it, mixed premultiplied."""
    mix = lambda v, w: v * (1.0 - strength) + w * strength
    alpha = mix(before[3] / 255.0, after[3] / 255.0)
    rounded = lambda v: np.floor(np.fmin(np.fmax(v, 0.0), 1.0) * 255.0 + 0.5)
    mixed = mix(before[:3] / 255.0 * (before[3] / 255.0), after[:3] / 255.0 * (after[3] / 255.0))
    return np.vstack([np.where(alpha > 0, rounded(mixed / np.where(alpha > 0, alpha, 1.0)), 255.0), rounded(alpha)])


#: Accumulators that are held for the pixels of a batch at a time, about.
HELD = 1 << 20
VALUES = ("sr", "sg", "sb", "alpha", "kind", "strength", "clipped")


def fold_stacks(counts: np.ndarray, what: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last accumulator (r, g, b, a by pixel) of pixels with so many events each, all pixels' first events together, then all second ones and so on.

    Numbers are doubles, exact up to 2 ** 52, and nulls are not-a-numbers,
    which fmin and fmax pass over as least and greatest do.
    """
    starts = np.cumsum(counts) - counts
    nest = np.cumsum((what == BEGIN).astype(np.int64) - (what == END))
    depth = int(nest.max(initial=0)) + 1
    done = np.empty((4, len(counts)))
    for part in np.array_split(np.argsort(-counts, kind="stable"), len(counts) * depth // HELD + 1):
        stack, level, first, n = np.empty((depth, 4, len(part))), np.zeros(len(part), np.int64), starts[part], counts[part]
        stack[0] = START
        for k in range(int(n.max(initial=0))):
            at = first[: np.searchsorted(-n, -k)] + k
            does = what[at]
            for step in (BEGIN, END, DRAW):
                p = np.flatnonzero(does == step)
                if not len(p):
                    continue
                v, top = dict(zip(VALUES, values[:, at[p]])), stack[level[p], :, p].T  # noqa: B905
                if step == BEGIN:
                    level[p] += 1
                    stack[level[p], :, p] = np.where(v["kind"] == THROUGH, top, START).T
                elif step == END:
                    level[p] -= 1
                    below = stack[level[p], :, p].T
                    laid = lay(below, top[:3], floored(top[3] * v["strength"], 256), v["clipped"])
                    stack[level[p], :, p] = np.where(v["kind"] == THROUGH, through(below, top, v["strength"] / 256.0), laid).T
                else:
                    stack[level[p], :, p] = lay(top, np.stack([v[c] for c in VALUES[:3]]), v["alpha"], v["clipped"]).T
        done[:, part] = stack[0]
    return done


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(px, r, g, b, a) of batches (px, events)."""
    for batch in batches:
        events = batch.column("events")
        fields = events.flatten()
        values = np.stack([fields.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in VALUES])
        what = fields.field("at").field("what").to_numpy(zero_copy_only=False)
        counts = events.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = fold_stacks(counts, what, values)
        yield pa.RecordBatch.from_arrays([batch.column("px"), *(pa.array(v, from_pandas=True).cast(pa.int64()) for v in out)], ["px", "r", "g", "b", "a"])


def nested(draws: DataFrame, layers: DataFrame, root: int = 1) -> DataFrame:
    """(px, r, g, b, a) of draws(px, layer_id, ord, sr, sg, sb, alpha) on the visible leaves of a tree of any depth."""
    events = pixel_events(draws, scope_paths(preorder(layers, root), layers))
    kind = events.schema["px"].dataType.simpleString()
    return events.mapInArrow(folded, f"px {kind}, r bigint, g bigint, b bigint, a bigint")


_INIT = "{'r': 255::BIGINT, 'g': 255::BIGINT, 'b': 255::BIGINT, 'a': 0::BIGINT}"


def _laid_sql(acc: str, source: str, alpha: str, clipped: str) -> str:
    carry = f"({acc}.a * (255 - {alpha}) // 255)"
    oa = f"least({carry} + {alpha}, 255)"
    over = ", ".join(f"'{c}': least(({source}{c} * {alpha} + {acc}.{c} * {carry} + greatest(({oa} - 1) // 2, 0)) // greatest({oa}, 1), 255)" for c in "rgb")
    within = ", ".join(f"'{c}': ({acc}.{c} * (255 - {alpha}) + {source}{c} * {alpha} + 127) // 255" for c in "rgb")
    return f"CASE WHEN {clipped} = 1 THEN {{{within}, 'a': {acc}.a}} WHEN {alpha} = 0 THEN {acc} ELSE {{{over}, 'a': {oa}}} END"


def _mixed_sql(before: str, after: str, s: str) -> str:
    mix = lambda c: f"({before}.{c} / 255e0 * ({before}.a / 255e0) * (1e0 - {s}) + {after}.{c} / 255e0 * ({after}.a / 255e0) * {s})"
    alpha = f"({before}.a / 255e0 * (1e0 - {s}) + {after}.a / 255e0 * {s})"
    rounded = lambda v: f"CAST(floor(least(greatest({v}, 0e0), 1e0) * 255e0 + 5e-1) AS BIGINT)"
    parts = ", ".join(f"'{c}': CASE WHEN {alpha} > 0 THEN {rounded(f'{mix(c)} / {alpha}')} ELSE 255 END" for c in "rgb")
    return f"{{{parts}, 'a': {rounded(alpha)}}}"


_PIXEL = ", ".join(f"{PIXELS[c]} AS {c}" for c in ("px", "ord", "sr", "sg", "sb", "sa", "mask", "opacity"))
NESTED_SQL = f"""{WALK_SQL},
facts AS (SELECT p.*, l.clip, l.opacity, {SCOPE} AS scope FROM plan p JOIN layers l USING (layer_id)),
runs AS (SELECT *, sum(1 - clip) OVER (PARTITION BY parent ORDER BY node_id) AS run FROM facts WHERE parent IS NOT NULL),
scopes AS (
  SELECT node_id AS place, subtree_end AS until, 2 * tree_depth + 1 AS level, CASE WHEN scope = 'through' THEN 1 ELSE 0 END AS kind, opacity AS strength, clip AS clipped FROM facts WHERE scope IN ('container', 'through') AND subtree_end > node_id + 1
  UNION ALL SELECT min(node_id), max(subtree_end), 2 * min(tree_depth), 2, 256, 0 FROM runs WHERE run > 0 GROUP BY parent, run HAVING count(*) > 1),
draws AS (SELECT d.*, (sa * mask // 255) * d.opacity // 256 AS alpha, f.node_id, f.clip FROM (SELECT {_PIXEL}, 1000 + l_partkey AS layer_id FROM lineitem) d JOIN facts f USING (layer_id)),
around AS (SELECT DISTINCT d.px, s.* FROM draws d JOIN scopes s ON s.place <= d.node_id AND d.node_id < s.until),
events AS (
  SELECT px, node_id AS place, 2 AS what, ord AS t1, 0 AS t2, sr, sg, sb, alpha, 0 AS kind, 0 AS strength, clip AS clipped FROM draws
  UNION ALL SELECT px, place, 1, level, 0, 0, 0, 0, 0, kind, 0, 0 FROM around
  UNION ALL SELECT px, until, 0, -place, -level, 0, 0, 0, 0, kind, strength, clipped FROM around),
ranked AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY place, what, t1, t2, sr, sg, sb, alpha) AS n FROM events),
run AS (
  SELECT DISTINCT px, CAST(0 AS BIGINT) AS n, [{_INIT}] AS stack FROM draws
  UNION ALL SELECT r.px, r.n + 1, CASE x.what
    WHEN 1 THEN list_concat([CASE WHEN x.kind = 1 THEN r.stack[1] ELSE {_INIT} END], r.stack)
    WHEN 0 THEN list_concat([CASE WHEN x.kind = 1 THEN {_mixed_sql('r.stack[2]', 'r.stack[1]', '(x.strength / 256e0)')} ELSE {_laid_sql('r.stack[2]', 'r.stack[1].', '(r.stack[1].a * x.strength // 256)', 'x.clipped')} END], r.stack[3:])
    ELSE list_concat([{_laid_sql('r.stack[1]', 'x.s', 'x.alpha', 'x.clipped')}], r.stack[2:]) END
  FROM run r JOIN ranked x ON x.px = r.px AND x.n = r.n + 1)
SELECT px, s.r AS r, s.g AS g, s.b AS b, s.a AS a FROM (SELECT px, arg_max(stack, n)[1] AS s FROM run GROUP BY px)"""


@query("e3_nested_scopes", NESTED_SQL)
def e3(t: Tables) -> DataFrame:
    """Containers, groups drawn through and clipping runs, nested three deep as the tree has them."""
    columns = [F.expr(PIXELS[c]).alias(c) for c in ("px", "ord", "sr", "sg", "sb", "sa", "mask", "opacity")]
    pixels = t["lineitem"].select(*columns, (1000 + F.col("l_partkey")).alias("layer_id"))
    draws = pixels.select("px", "layer_id", "ord", "sr", "sg", "sb", event_alpha(pixels).alias("alpha"))
    return nested(draws, t.model.tree)
