"""Hierarchy operators (H1 to H7, W4, W12, P7, P16): layer trees stored as sibling and child links."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.checkpoints import cut
from mosaiq.registry import Tables, query
from mosaiq.model import LAYERS_SQL


#: Doublings along siblings or levels after which links must go in circles.
MOST_DOUBLINGS = 40


def linked(layers: DataFrame) -> DataFrame:
    """layers(layer_id, next_id, first_child, ...) with parent and rank among siblings, found from the stored links alone.

    A first child's parent is known, and its siblings follow by next_id:
    each layer looks ahead twice as far in each round, so that a list of n
    siblings takes about log2(n) joins, each written to the checkpoint folder
    so that plans stay short. Links in circles raise an error. The
    root, and what no link leads to, has a null parent and rank 0.
    """
    before = layers.filter("next_id <> 0").select(F.col("next_id").alias("of"), F.col("layer_id").alias("prev"))
    up = layers.filter("first_child <> 0").select(F.col("first_child").alias("child"), F.col("layer_id").alias("parent"))
    first = layers.select("layer_id").join(before, F.col("layer_id") == F.col("of"), "left")
    back = cut(first.select("layer_id", F.coalesce("prev", "layer_id").alias("head"), F.col("prev").isNotNull().cast("bigint").alias("rank"), F.col("prev").isNotNull().alias("open")))
    parts = back.rdd.getNumPartitions()
    for _ in range(MOST_DOUBLINGS):
        if back.filter("open").isEmpty():
            break
        # those that have met the first one wait, so no key is that of many rows
        far = back.select(F.col("layer_id").alias("at"), F.col("head").alias("further"), F.col("rank").alias("more"), F.col("open").alias("on"))
        ahead = back.filter("open").join(far, F.col("head") == F.col("at")).select("layer_id", F.col("further").alias("head"), (F.col("rank") + F.col("more")).alias("rank"), F.col("on").alias("open"))
        back = cut(back.filter("not open").union(ahead).coalesce(parts))
    else:
        raise ValueError("links between siblings go in circles")
    back = back.drop("open")
    heads = back.join(up, F.col("head") == F.col("child"), "left").select(F.col("layer_id").alias("id"), "parent", "rank")
    return layers.drop("parent", "rank").join(heads, F.col("layer_id") == F.col("id")).drop("id")


def along_ancestors(nodes: DataFrame, merges: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """nodes(layer_id, up, values) with each value merged with those of all nodes above, whatever up leads to.

    Pointers double: in each round a node takes what the node it points to has
    gathered, and its pointer. The number of joins is the logarithm of the
    depth. A link that leads nowhere ends there; links in circles are an error.
    """
    now = cut(nodes.select("layer_id", "up", *merges))
    parts = now.rdd.getNumPartitions()
    n, left = now.agg(F.count(F.lit(1)), F.count("up")).first()
    for _ in range(n.bit_length() + 1):
        if not left:
            return now.drop("up")
        far = now.select(F.col("layer_id").alias("at"), F.col("up").alias("further"), *(F.col(v).alias(f"far_{v}") for v in merges))
        deep = now.filter("up is not null").join(far, F.col("up") == F.col("at"), "left")
        merged = (F.when(F.col("at").isNull(), F.col(v)).otherwise(merge(F.col(v), F.col(f"far_{v}"))).alias(v) for v, merge in merges.items())
        now = cut(now.filter("up is null").union(deep.select("layer_id", F.col("further").alias("up"), *merged)).coalesce(parts))
        left = now.filter("up is not null").count()
    raise ValueError("links between levels go in circles")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(layer_id, size) of nodes(layer_id, parent, tree_depth), in a round for each bit of the depth.

    After a round a node has counted what lies up to twice as deep below it:
    its own, and what the nodes have that point to it over that distance.
    """
    active = nodes.filter("tree_depth > 0").select("layer_id", "tree_depth", F.lit(1).cast("bigint").alias("size"), F.col("parent").alias("up"))
    found, step = [nodes.select("layer_id", F.lit(1).cast("bigint").alias("size"))], 1
    deepest = nodes.agg(F.max("tree_depth")).first()[0] or 0
    while step <= deepest:
        got = cut(active.groupBy(F.col("up").alias("layer_id")).agg(F.sum("size").alias("size")))
        found.append(got)
        if 2 * step <= deepest:
            more = got.select("layer_id", F.col("size").alias("more"))
            deep = active.filter(F.col("tree_depth") >= 2 * step).join(more, "layer_id", "left").select("layer_id", "tree_depth", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "up")
            active = cut(deep.join(active.select(F.col("layer_id").alias("up"), F.col("up").alias("onward")), "up").select("layer_id", "tree_depth", "size", F.col("onward").alias("up")))
        step *= 2
    return reduce(DataFrame.union, found).groupBy("layer_id").agg(F.sum("size").alias("size"))


def visible(layers: DataFrame, root: int, rank: str = "layer_id") -> DataFrame:
    """(layer_id, parent, rank, tree_depth) of root and the visible layers below it. A hidden layer hides what is below it, not its siblings."""
    at_root = F.col("layer_id") == root
    nodes = layers.select("layer_id", F.when(~at_root, F.col("parent")).alias("up"), (at_root | (F.col("visibility").bitwiseAND(1) != 0)).alias("shown"), F.when(at_root, 0).otherwise(1).cast("bigint").alias("tree_depth"), F.col("layer_id").alias("top"))
    walked = along_ancestors(nodes, {"shown": lambda a, b: a & b, "tree_depth": lambda a, b: a + b, "top": lambda _, b: b})
    shown = walked.filter(F.col("shown") & (F.col("top") == root)).select("layer_id", "tree_depth")
    return layers.select("layer_id", F.when(~at_root, F.col("parent")).alias("parent"), F.when(at_root, 0).otherwise(F.col(rank)).cast("bigint").alias("rank")).join(shown, "layer_id")


def preorder(layers: DataFrame, root: int = 1, rank: str = "layer_id") -> DataFrame:
    """H1: (node_id, layer_id, parent, tree_depth, subtree_end) of the visible layers, depth first, siblings in order of rank.

    No global sort and no join for each level: subtree sizes are counted over
    doubling distances, and a node's place is the sum, over it and its
    ancestors, of the sizes of the siblings before, and one for each level.
    """
    nodes = cut(visible(layers, root, rank))
    sized = nodes.join(subtree_sizes(nodes), "layer_id")
    before = Window.partitionBy("parent").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    steps = cut(sized.withColumn("node_id", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(1 + F.coalesce(F.sum("size").over(before), F.lit(0)))))
    placed = along_ancestors(steps.select("layer_id", F.col("parent").alias("up"), "node_id"), {"node_id": lambda a, b: a + b})
    return steps.drop("node_id").join(placed, "layer_id").select("node_id", "layer_id", "parent", "tree_depth", (F.col("node_id") + F.col("size")).alias("subtree_end"))


WALK_SQL = f"""WITH RECURSIVE {LAYERS_SQL},
walk AS (SELECT layer_id, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS tree_depth, [layer_id] AS path FROM layers WHERE layer_id = 1
  UNION ALL SELECT l.layer_id, l.parent, w.tree_depth + 1, list_append(w.path, l.layer_id) FROM layers l JOIN walk w ON l.parent = w.layer_id WHERE (l.visibility & 1) <> 0),
seq AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS node_id FROM walk),
plan AS (SELECT s.node_id, s.layer_id, s.parent, s.tree_depth, s.node_id + (SELECT count(*) FROM walk w WHERE w.path[1:len(s.path)] = s.path) AS subtree_end FROM seq s)"""


@query("h1_preorder", f"{WALK_SQL} SELECT node_id, layer_id, parent, tree_depth FROM plan")
def h1(t: Tables) -> DataFrame:
    return preorder(t.model.tree).drop("subtree_end")


@query("h1_preorder_by_links", f"{WALK_SQL} SELECT node_id, layer_id, parent, tree_depth FROM plan")
def h1_links(t: Tables) -> DataFrame:
    """H1: the same when parents and order are found from first children and next siblings."""
    return preorder(linked(t.model.layers.drop("parent")), rank="rank").drop("subtree_end")


@query("h3_subtree_range", f"{WALK_SQL} SELECT layer_id, node_id, subtree_end, subtree_end - node_id AS nodes FROM plan")
def h3(t: Tables) -> DataFrame:
    return preorder(t.model.tree).select("layer_id", "node_id", "subtree_end", (F.col("subtree_end") - F.col("node_id")).alias("nodes"))


@query("w4_subtree_end", f"{WALK_SQL} SELECT a.node_id, coalesce(min(b.node_id), (SELECT count(*) FROM plan)) AS subtree_end FROM plan a LEFT JOIN plan b ON b.node_id > a.node_id AND b.tree_depth <= a.tree_depth GROUP BY a.node_id")
def w4(t: Tables) -> DataFrame:
    """The next row at the same depth or above; the subtree's size gives it without a range join."""
    return preorder(t.model.tree).select("node_id", "subtree_end")


@query(
    "h2_link_errors",
    f"""WITH {LAYERS_SQL}, links AS (SELECT layer_id, next_id AS target, 'next' AS link FROM layers WHERE next_id <> 0 UNION ALL SELECT layer_id, first_child + CASE WHEN layer_id % 50 = 0 THEN 7000000 ELSE 0 END, 'child' FROM layers WHERE first_child <> 0),
many AS (SELECT target FROM links GROUP BY target HAVING count(*) > 1)
SELECT link, count(*) AS links, count(*) FILTER (target NOT IN (SELECT layer_id FROM layers)) AS dangling, count(*) FILTER (target IN (SELECT target FROM many)) AS repeated, count(*) FILTER (target = layer_id) AS loops FROM links GROUP BY link""",
)
def h2(t: Tables) -> DataFrame:
    """H2: links that lead nowhere, that meet, or that return."""
    layers = t.model.layers
    nexts = layers.filter("next_id <> 0").select("layer_id", F.col("next_id").alias("target"), F.lit("next").alias("link"))
    children = layers.filter("first_child <> 0").select("layer_id", F.expr("first_child + CASE WHEN layer_id % 50 = 0 THEN 7000000 ELSE 0 END").alias("target"), F.lit("child").alias("link"))
    links = nexts.union(children)
    known = layers.select(F.col("layer_id").alias("id"), F.lit(True).alias("known"))
    many = links.groupBy("target").agg((F.count(F.lit(1)) > 1).alias("many")).withColumnRenamed("target", "mt")
    marked = links.join(known, F.col("target") == F.col("id"), "left").join(many, F.col("target") == F.col("mt"))
    return marked.groupBy("link").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("known").isNull()).alias("dangling"), F.count_if("many").alias("repeated"), F.count_if(F.col("target") == F.col("layer_id")).alias("loops"))


CLIP_RUNS_SQL = f"WITH {LAYERS_SQL}, s AS (SELECT parent, layer_id, clip, sum(1 - clip) OVER (PARTITION BY parent ORDER BY layer_id) AS run FROM layers WHERE parent IS NOT NULL)"


@query("h4_clip_runs", f"{CLIP_RUNS_SQL} SELECT parent, CAST(run AS BIGINT) AS run, min(layer_id) AS base, count(*) - 1 AS clipped FROM s WHERE run > 0 GROUP BY parent, run HAVING count(*) > 1")
def h4(t: Tables) -> DataFrame:
    """H4: a base and the clipped siblings right after it, as islands."""
    siblings = Window.partitionBy("parent").orderBy("layer_id")
    runs = t.model.layers.filter("parent is not null").withColumn("run", F.sum(1 - F.col("clip")).over(siblings)).filter("run > 0")
    return runs.groupBy("parent", "run").agg(F.min("layer_id").alias("base"), (F.count(F.lit(1)) - 1).alias("clipped")).filter("clipped > 0")


SCOPE = "CASE WHEN type_code NOT IN (0, 2, 256) THEN 'leaf' WHEN composite = 0 AND opacity = 256 AND clip = 0 AND mask_mipmap = 0 THEN 'elided' WHEN composite = 36 AND clip = 0 THEN 'through' ELSE 'container' END"


@query("h5_scope_kind", f"WITH {LAYERS_SQL} SELECT layer_id, {SCOPE} AS scope FROM layers")
def h5(t: Tables) -> DataFrame:
    """H5: what kind of scope a layer opens; a plain one needs none."""
    return t.model.layers.select("layer_id", F.expr(SCOPE).alias("scope"))


@query("h6_nested_ordinals", f"{WALK_SQL} SELECT layer_id, row_number() OVER (PARTITION BY parent ORDER BY node_id) - 1 AS place, node_id AS ordinal FROM plan")
def h6(t: Tables) -> DataFrame:
    """H6: depth-first ordinals, and the place within the parent."""
    plan = preorder(t.model.tree)
    return plan.select("layer_id", (F.row_number().over(Window.partitionBy("parent").orderBy("node_id")) - 1).cast("bigint").alias("place"), F.col("node_id").alias("ordinal"))


@query("h7_leaf_flattening", f"{WALK_SQL} SELECT layer_id, node_id FROM plan WHERE subtree_end = node_id + 1")
def h7(t: Tables) -> DataFrame:
    return preorder(t.model.tree).filter("subtree_end = node_id + 1").select("layer_id", "node_id")


@query(
    "p7_visible_subtree",
    f"{WALK_SQL} SELECT l.tree_depth AS depth, count(*) AS visible FROM plan l GROUP BY l.tree_depth",
)
def p7(t: Tables) -> DataFrame:
    """Visibility prunes whole subtrees."""
    return visible(t.model.tree, 1).groupBy(F.col("tree_depth").alias("depth")).agg(F.count(F.lit(1)).alias("visible"))


@query(
    "p16_unsupported_subtree",
    f"""{WALK_SQL}, bad AS (SELECT p.node_id, p.subtree_end FROM plan p JOIN layers l USING (layer_id) WHERE l.depth = 2 AND l.layer_id % 3 = 0)
SELECT p.layer_id, CASE WHEN b.node_id = p.node_id THEN 'UnsupportedGroup' ELSE 'InsideUnsupportedContainer' END AS reason FROM plan p JOIN bad b ON p.node_id >= b.node_id AND p.node_id < b.subtree_end""",
)
def p16(t: Tables) -> DataFrame:
    """An unsupported node marks what is below it, along doubling pointers instead of a range join."""
    nodes = visible(t.model.tree, 1).withColumn("bad", F.expr("tree_depth = 2 AND layer_id % 3 = 0"))
    marked = along_ancestors(nodes.select("layer_id", F.col("parent").alias("up"), "bad"), {"bad": lambda a, b: a | b}).withColumnRenamed("bad", "within")
    reason = F.when(F.col("bad"), "UnsupportedGroup").otherwise("InsideUnsupportedContainer")
    return nodes.select("layer_id", "bad").join(marked.filter("within"), "layer_id").select("layer_id", reason.alias("reason"))


OUTCOME = "CASE WHEN type_code NOT IN (0, 1, 2, 3, 256, 1584, 4098) THEN 'Blocked' WHEN type_code = 4098 THEN 'Cleared' ELSE 'Available' END"


@query(
    "w12_clip_base_state",
    f"""WITH {LAYERS_SQL}, s AS (SELECT parent, layer_id, clip, CASE WHEN clip = 0 THEN {OUTCOME} END AS outcome FROM layers WHERE parent IS NOT NULL)
SELECT layer_id, coalesce(last_value(outcome IGNORE NULLS) OVER (PARTITION BY parent ORDER BY layer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Cleared') AS base_state FROM s""",
)
def w12(t: Tables) -> DataFrame:
    """The state of the clip base before each sibling: the outcome of the last one that isn't clipped."""
    before = Window.partitionBy("parent").orderBy("layer_id").rowsBetween(Window.unboundedPreceding, -1)
    s = t.model.layers.filter("parent is not null").withColumn("outcome", F.expr(f"CASE WHEN clip = 0 THEN {OUTCOME} END"))
    return s.select("layer_id", F.coalesce(F.last("outcome", ignorenulls=True).over(before), F.lit("Cleared")).alias("base_state"))
