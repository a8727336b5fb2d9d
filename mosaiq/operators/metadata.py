"""Metadata reads, projections, predicates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.model import LAYERS_SQL

# Type codes and what they stand for.
KINDS = {0: "Folder", 256: "Folder", 1: "Raster", 2: "Group", 3: "MaskedRaster", 1584: "Paper", 4098: "Filter"}
KIND_SQL = "CASE WHEN text_blob IS NOT NULL THEN 'Text' " + " ".join(f"WHEN type_code = {k} THEN '{v}'" for k, v in KINDS.items()) + " ELSE 'Unsupported' END"
NODE_SQL = "CASE WHEN kind IN ('Folder', 'Group') THEN 'Container' WHEN kind IN ('Raster', 'MaskedRaster', 'Text') THEN 'Raster' WHEN kind = 'Paper' THEN 'Solid' WHEN kind = 'Filter' THEN 'Filter' ELSE 'Skip' END"


def with_optional_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds the columns that a schema lacks, with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def none_if_zero(c: str) -> Column:
    """Links store 0 for none."""
    return F.nullif(F.col(c), F.lit(0).cast("bigint"))


def chain_tables(t: Tables) -> dict[str, DataFrame]:
    """The tables a layer's pixels are found through: mipmaps, their infos, blocks, thumbnails."""
    layers = t.model.layers
    used = layers.select(F.col("render_mipmap").alias("id")).union(layers.select("mask_mipmap")).filter("id <> 0")
    return {
        "mipmap": used.select(F.col("id").alias("mipmap_id"), (F.col("id") + 1000000).alias("base_info")),
        "info": used.select((F.col("id") + 1000000).alias("info_id"), (F.col("id") + 2000000).alias("offscreen")).filter("info_id % 9 <> 0"),
        "offscreen": used.select((F.col("id") + 2000000).alias("offscreen_id"), F.concat(F.lit("extrnlid"), F.col("id").cast("string")).alias("external_id"), F.expr("CASE WHEN id % 3 = 0 THEN id % 700 END").alias("attribute_width")),
        "thumbnail": layers.filter("layer_id % 2 = 0").select(F.col("layer_id").alias("thumb_layer"), (F.col("layer_id") % 900).alias("thumb_width"), (F.col("layer_id") % 3).alias("thumb_red")),
    }


CHAIN_SQL = f"""WITH {LAYERS_SQL}, used AS (SELECT render_mipmap AS id FROM layers WHERE render_mipmap <> 0 UNION ALL SELECT mask_mipmap FROM layers WHERE mask_mipmap <> 0),
mipmap AS (SELECT id AS mipmap_id, id + 1000000 AS base_info FROM used), info AS (SELECT id + 1000000 AS info_id, id + 2000000 AS offscreen FROM used WHERE (id + 1000000) % 9 <> 0),
offscreens AS (SELECT id + 2000000 AS offscreen_id, 'extrnlid' || id AS external_id, CASE WHEN id % 3 = 0 THEN id % 700 END AS attribute_width FROM used),
thumbnail AS (SELECT layer_id AS thumb_layer, layer_id % 900 AS thumb_width, layer_id % 3 AS thumb_red FROM layers WHERE layer_id % 2 = 0)"""


def resolve_sources(layers: DataFrame, chain: dict[str, DataFrame], link: str) -> DataFrame:
    """Layers with their blocks through three inner joins on the links."""
    return (
        layers.filter(F.col(link) != 0)
        .join(chain["mipmap"], F.col(link) == F.col("mipmap_id"))
        .join(chain["info"], F.col("base_info") == F.col("info_id"))
        .join(chain["offscreen"], F.col("offscreen") == F.col("offscreen_id"))
    )


_JOINS = "FROM layers JOIN mipmap ON {0} = mipmap_id JOIN info ON base_info = info_id JOIN offscreens ON offscreen = offscreen_id"


@query("s9_canvas_summary", "SELECT CAST(2048 AS BIGINT) AS width, CAST(2048 AS BIGINT) AS height, count(*) AS layers FROM customer")
def s9(t: Tables) -> DataFrame:
    return t["customer"].agg(F.count(F.lit(1)).alias("layers")).select(F.lit(2048).cast("bigint").alias("width"), F.lit(2048).cast("bigint").alias("height"), "layers")


@query("s10_layer_graph", f"WITH {LAYERS_SQL} SELECT layer_id, nullif(next_id, 0) AS next_id, nullif(first_child, 0) AS first_child, nullif(render_mipmap, 0) AS render_mipmap, nullif(mask_mipmap, 0) AS mask_mipmap, opacity, composite FROM layers ORDER BY layer_id")
def s10(t: Tables) -> DataFrame:
    """The layer graph in order of id, 0 as null."""
    links = ("next_id", "first_child", "render_mipmap", "mask_mipmap")
    return t.model.layers.select("layer_id", *(none_if_zero(c).alias(c) for c in links), "opacity", "composite").orderBy("layer_id")


_WIDTH = "coalesce(attribute_width, thumb_width, 2048)"


@query("j1_raster_sources", f"{CHAIN_SQL} SELECT layer_id, external_id, CAST({_WIDTH} AS BIGINT) AS width, thumb_red {_JOINS.format('render_mipmap')} LEFT JOIN thumbnail ON thumb_layer = layer_id")
def j1(t: Tables) -> DataFrame:
    """Raster sources, with the size from the first place that has one."""
    chain = chain_tables(t)
    found = resolve_sources(t.model.layers, chain, "render_mipmap").join(chain["thumbnail"], F.col("thumb_layer") == F.col("layer_id"), "left")
    return found.select("layer_id", "external_id", F.expr(_WIDTH).cast("bigint").alias("width"), "thumb_red")


@query("j2_mask_sources", f"{CHAIN_SQL} SELECT layer_id, external_id {_JOINS.format('mask_mipmap')} WHERE mask_mipmap <> 0")
def j2(t: Tables) -> DataFrame:
    """J2, S12, P6."""
    return resolve_sources(t.model.layers, chain_tables(t), "mask_mipmap").select("layer_id", "external_id")


@query("j3_dangling_links", f"{CHAIN_SQL} SELECT layer_id, render_mipmap FROM layers WHERE render_mipmap <> 0 AND render_mipmap + 1000000 NOT IN (SELECT info_id FROM info)")
def j3(t: Tables) -> DataFrame:
    """Links whose target is missing, by an anti join."""
    return t.model.layers.filter("render_mipmap <> 0").join(chain_tables(t)["info"], F.col("render_mipmap") + 1000000 == F.col("info_id"), "left_anti").select("layer_id", "render_mipmap")


@query("j5_segment_resources", f"WITH {LAYERS_SQL}, res AS (SELECT o_orderkey AS segment, o_custkey + 1000 AS layer_id FROM orders) SELECT segment, r.layer_id, coalesce(opacity, 0) AS signature FROM res r LEFT JOIN (SELECT layer_id, opacity FROM layers WHERE layer_id % 5 <> 0) l ON r.layer_id = l.layer_id")
def j5(t: Tables) -> DataFrame:
    """Resources with their source's signature, 0 for a miss."""
    res = t["orders"].select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") + 1000).alias("layer_id"))
    return res.join(t.model.layers.filter("layer_id % 5 <> 0").select("layer_id", "opacity"), "layer_id", "left").select("segment", "layer_id", F.coalesce("opacity", F.lit(0)).alias("signature"))


@query("p1_optional_columns", "SELECT c_custkey, c_name, 0 AS color_red, '' AS label FROM customer")
def p1(t: Tables) -> DataFrame:
    return with_optional_columns(t["customer"], {"c_name": "none", "color_red": 0, "label": ""}).select("c_custkey", "c_name", "color_red", "label")


@query("p3_layer_kind", f"WITH {LAYERS_SQL}, k AS (SELECT layer_id, CAST(text_blob IS NOT NULL AS INT) AS has_text, {KIND_SQL} AS kind FROM layers) SELECT *, {NODE_SQL} AS node FROM k")
def p3(t: Tables) -> DataFrame:
    """Type codes to kinds, which text overrides, to kinds of render nodes."""
    kinds = t.model.layers.select("layer_id", F.when(F.col("text_blob").isNotNull(), 1).otherwise(0).alias("has_text"), F.expr(KIND_SQL).alias("kind"))
    return kinds.withColumn("node", F.expr(NODE_SQL))


@query("p5_point_filter", f"WITH {LAYERS_SQL} SELECT layer_id, opacity, composite FROM layers WHERE layer_id = 1042")
def p5(t: Tables) -> DataFrame:
    return t.model.layers.filter("layer_id = 1042").select("layer_id", "opacity", "composite")


_COMPONENT = "CASE WHEN {0} < 0 THEN ({0} + 4294967296) // 16777216 WHEN {0} > 255 THEN least({0} // 16777216, 255) ELSE {0} END"
_PAPER = "CASE WHEN c_custkey % 3 = 0 THEN raw WHEN thumb <> 0 THEN thumb ELSE palette END"
_PAPER_FROM = "(SELECT c_custkey, CAST(floor(c_acctbal * 100e0) AS BIGINT) AS raw, c_custkey % 4 AS thumb, CAST(77 AS BIGINT) AS palette FROM customer)"


@query("p9_paper_color", f"SELECT c_custkey, CASE WHEN p < 0 THEN (p + 4294967296) // 16777216 WHEN p > 255 THEN least(p // 16777216, 255) ELSE p END AS red FROM (SELECT c_custkey, {_PAPER} AS p FROM {_PAPER_FROM})")
def p9(t: Tables) -> DataFrame:
    """Paper colours from the first place that has one; 32-bit components give their top byte."""
    c = t["customer"].select("c_custkey", F.expr("CAST(floor(c_acctbal * 100e0) AS BIGINT)").alias("raw"), (F.col("c_custkey") % 4).alias("thumb"), F.lit(77).cast("bigint").alias("palette"))
    return c.withColumn("p", F.expr(_PAPER)).select("c_custkey", F.expr("CASE WHEN p < 0 THEN (p + 4294967296) div 16777216 WHEN p > 255 THEN least(p div 16777216, 255) ELSE p END").alias("red"))


_DEAD = "opacity > 0 AND render_mipmap <> 0"


@query("p12_dead_sources", f"WITH {LAYERS_SQL} SELECT depth, count(*) AS live FROM layers WHERE {_DEAD} GROUP BY depth")
def p12(t: Tables) -> DataFrame:
    return t.model.layers.filter(_DEAD).groupBy("depth").agg(F.count(F.lit(1)).alias("live"))


_FOLD_OPACITY = "CASE WHEN mask_mipmap <> 0 AND layer_id % 256 < 100 THEN 0 ELSE opacity END"
_FOLD_MASK = "CASE WHEN mask_mipmap = 0 THEN 'none' WHEN layer_id % 256 < 100 THEN 'folded' WHEN layer_id % 256 > 200 THEN 'dropped' ELSE 'kept' END"


@query("p13_mask_folding", f"WITH {LAYERS_SQL} SELECT layer_id, {_FOLD_OPACITY} AS opacity, {_FOLD_MASK} AS mask FROM layers")
def p13(t: Tables) -> DataFrame:
    """A mask off the canvas is its fill: nothing, everything, or kept."""
    return t.model.layers.select("layer_id", F.expr(_FOLD_OPACITY).alias("opacity"), F.expr(_FOLD_MASK).alias("mask"))


@query("p14_opaque_masks", f"WITH {LAYERS_SQL} SELECT layer_id FROM layers l WHERE mask_mipmap <> 0 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey + 1000 = l.layer_id)")
def p14(t: Tables) -> DataFrame:
    """Masks without any stored tile, known from metadata alone."""
    return t.model.layers.filter("mask_mipmap <> 0").join(t["orders"].select((F.col("o_custkey") + 1000).alias("id")), F.col("layer_id") == F.col("id"), "left_anti").select("layer_id")


REASON = (
    "CASE WHEN (visibility & 1) = 0 THEN NULL WHEN opacity > 256 THEN 'OpacityRange' WHEN type_code NOT IN (0, 1, 2, 3, 256, 1584, 4098) THEN 'UnsupportedKind' WHEN type_code = 4098 AND clip = 1 THEN 'ClippedFilter' "
    "WHEN composite = 30 AND clip = 1 THEN 'ClippedThrough' WHEN composite NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 30, 36) THEN 'Blend' "
    "WHEN type_code IN (1, 3) AND render_mipmap = 0 THEN 'MissingResource' WHEN type_code = 3 AND mask_mipmap = 0 THEN 'MissingMask' END"
)


@query("p15_support_reasons", f"WITH {LAYERS_SQL}, r AS (SELECT layer_id, {REASON} AS reason FROM layers) SELECT layer_id, reason FROM r WHERE reason IS NOT NULL")
def p15(t: Tables) -> DataFrame:
    """What can't be drawn, with the first reason."""
    return t.model.layers.select("layer_id", F.expr(REASON).alias("reason")).filter("reason is not null")


@query("q4_support_report", f"WITH {LAYERS_SQL}, r AS (SELECT {REASON} AS reason FROM layers) SELECT coalesce(reason, 'Supported') AS reason, count(*) AS layers FROM r GROUP BY 1")
def q4(t: Tables) -> DataFrame:
    return t.model.layers.groupBy(F.coalesce(F.expr(REASON), F.lit("Supported")).alias("reason")).agg(F.count(F.lit(1)).alias("layers"))


@query("a1_layer_count", f"WITH {LAYERS_SQL} SELECT count(*) AS layers FROM layers")
def a1(t: Tables) -> DataFrame:
    return t.model.layers.agg(F.count(F.lit(1)).alias("layers"))


@query("s3_external_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def s3(t: Tables) -> DataFrame:
    """S3: bodies by their id."""
    return t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("s20_last_id_wins", "SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS body FROM orders GROUP BY o_custkey")
def s20(t: Tables) -> DataFrame:
    """Of bodies with the same id the last one counts."""
    return t["orders"].groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_totalprice", "o_orderkey").alias("body"))


@query("s1_first_id_wins", "SELECT o_custkey AS id, arg_min(o_totalprice, o_orderkey) AS body FROM orders GROUP BY o_custkey")
def s1(t: Tables) -> DataFrame:
    """In the strict reader the first one does."""
    return t["orders"].groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_totalprice", "o_orderkey").alias("body"))


_WIDTH_FROM = "CASE WHEN attribute_width IS NOT NULL THEN 'attribute' WHEN thumb_width IS NOT NULL THEN 'thumbnail' ELSE 'canvas' END"


@query("p8_size_fallback", f"{CHAIN_SQL} SELECT layer_id, {_WIDTH_FROM} AS size_from, CAST({_WIDTH} AS BIGINT) AS width {_JOINS.format('render_mipmap')} LEFT JOIN thumbnail ON thumb_layer = layer_id")
def p8(t: Tables) -> DataFrame:
    """Which place a raster's size is from, and the size."""
    chain = chain_tables(t)
    found = resolve_sources(t.model.layers, chain, "render_mipmap").join(chain["thumbnail"], F.col("thumb_layer") == F.col("layer_id"), "left")
    return found.select("layer_id", F.expr(_WIDTH_FROM).alias("size_from"), F.expr(_WIDTH).cast("bigint").alias("width"))


@query("s11_raster_scan", f"{CHAIN_SQL} SELECT layer_id, external_id, composite, coalesce(attribute_width, thumb_width, 2048) > 300 AS wide {_JOINS.format('render_mipmap')} LEFT JOIN thumbnail ON thumb_layer = layer_id WHERE type_code IN (1, 3)")
def s11(t: Tables) -> DataFrame:
    """Sources of layers that are rasters."""
    chain = chain_tables(t)
    found = resolve_sources(t.model.layers.filter("type_code IN (1, 3)"), chain, "render_mipmap").join(chain["thumbnail"], F.col("thumb_layer") == F.col("layer_id"), "left")
    return found.select("layer_id", "external_id", "composite", (F.expr(_WIDTH) > 300).alias("wide"))


@query("s12_mask_scan", f"{CHAIN_SQL} SELECT layer_id, external_id, attribute_width IS NULL AS whole_canvas {_JOINS.format('mask_mipmap')} WHERE mask_mipmap <> 0 AND type_code <> 1584")
def s12(t: Tables) -> DataFrame:
    """Masks of layers that can have one, and whether they are as large as the canvas."""
    found = resolve_sources(t.model.layers.filter("type_code <> 1584"), chain_tables(t), "mask_mipmap")
    return found.select("layer_id", "external_id", F.col("attribute_width").isNull().alias("whole_canvas"))


@query("p2_text_flag", f"WITH {LAYERS_SQL} SELECT CASE WHEN text_blob IS NOT NULL OR layer_id % 13 = 0 THEN 1 ELSE 0 END AS has_text, count(*) AS layers FROM layers GROUP BY 1")
def p2(t: Tables) -> DataFrame:
    """A layer has text if either of its columns does."""
    array = F.when(F.col("layer_id") % 13 == 0, F.lit("array"))
    flagged = t.model.layers.select(F.when(F.col("text_blob").isNotNull() | array.isNotNull(), 1).otherwise(0).alias("has_text"))
    return flagged.groupBy("has_text").agg(F.count(F.lit(1)).alias("layers"))


@query("p4_node_kind", f"WITH {LAYERS_SQL}, k AS (SELECT layer_id, {KIND_SQL} AS kind FROM layers) SELECT kind, {NODE_SQL} AS node, count(*) AS layers FROM k GROUP BY ALL")
def p4(t: Tables) -> DataFrame:
    """Kinds of layers and of the nodes that draw them."""
    return t.model.layers.select(F.expr(KIND_SQL).alias("kind")).withColumn("node", F.expr(NODE_SQL)).groupBy("kind", "node").agg(F.count(F.lit(1)).alias("layers"))


@query("p6_masked_layers", f"WITH {LAYERS_SQL} SELECT layer_id, mask_mipmap FROM layers WHERE mask_mipmap <> 0")
def p6(t: Tables) -> DataFrame:
    return t.model.layers.filter("mask_mipmap <> 0").select("layer_id", "mask_mipmap")


@query("p10_color_component", "SELECT c_custkey, CASE WHEN v < 0 THEN (v + 4294967296) >> 24 WHEN v > 255 THEN least(v >> 24, 255) ELSE v END AS component FROM (SELECT c_custkey, c_custkey * 7919 % 600 - 200 + CASE WHEN c_custkey % 3 = 0 THEN 2000000000 ELSE 0 END AS v FROM customer)")
def p10(t: Tables) -> DataFrame:
    """P10: components of 32 bits: a negative one is read without its sign, and of a large one the highest byte counts."""
    v = F.expr("c_custkey * 7919 % 600 - 200 + CASE WHEN c_custkey % 3 = 0 THEN 2000000000 ELSE 0 END")
    return t["customer"].select("c_custkey", v.alias("v")).select("c_custkey", F.when(F.col("v") < 0, F.shiftright(F.col("v") + 4294967296, 24)).when(F.col("v") > 255, F.least(F.shiftright("v", 24), F.lit(255))).otherwise(F.col("v")).alias("component"))


@query("j4_missing_sources", f"{CHAIN_SQL}, found AS (SELECT layer_id AS id {_JOINS.format('render_mipmap')}) SELECT layer_id, type_code FROM layers WHERE type_code IN (1, 3) AND layer_id NOT IN (SELECT id FROM found)")
def j4(t: Tables) -> DataFrame:
    """Raster nodes without a source, by an anti join."""
    found = resolve_sources(t.model.layers, chain_tables(t), "render_mipmap").select(F.col("layer_id").alias("id"))
    return t.model.layers.filter("type_code IN (1, 3)").join(found, F.col("layer_id") == F.col("id"), "left_anti").select("layer_id", "type_code")


@query("o1_order_by_id", f"WITH {LAYERS_SQL} SELECT layer_id, depth, opacity FROM layers ORDER BY layer_id")
def o1(t: Tables) -> DataFrame:
    return t.model.layers.select("layer_id", "depth", "opacity").orderBy("layer_id")


@query("o2_limit_one", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1")
def o2(t: Tables) -> DataFrame:
    """O2: the one canvas: the limit is the feature."""
    return t["customer"].select("c_custkey", "c_name").orderBy("c_custkey").limit(1)


STRICT = f"CASE WHEN ({REASON}) IS NULL AND type_code IN (1, 3) AND (visibility & 1) <> 0 AND offscreen IS NULL THEN 'UndecodedResource' ELSE {REASON} END"


@query("e29_strict_support", f"{CHAIN_SQL}, j AS (SELECT layers.*, info.offscreen FROM layers LEFT JOIN info ON render_mipmap + 1000000 = info_id) SELECT layer_id, {STRICT} AS strict, {REASON} AS plain FROM j WHERE ({STRICT}) IS NOT NULL")
def e29(t: Tables) -> DataFrame:
    """Support with a look at the resources, beside that from the metadata alone."""
    joined = t.model.layers.join(chain_tables(t)["info"], F.col("render_mipmap") + 1000000 == F.col("info_id"), "left")
    return joined.select("layer_id", F.expr(STRICT).alias("strict"), F.expr(REASON).alias("plain")).filter("strict is not null")
