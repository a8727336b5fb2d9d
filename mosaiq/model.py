"""The model's tables, mapped deterministically from the driver's, and the same mappings as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = {
    "px": "l_orderkey", "ord": "CAST(l_linenumber AS BIGINT)", "sr": "l_partkey % 256", "sg": "(l_suppkey * 37) % 256", "sb": "(CAST(l_quantity AS BIGINT) * 5) % 256",
    "sa": "CAST(floor(l_extendedprice) AS BIGINT) % 256", "dr": "(l_partkey * 7) % 256", "dg": "(l_suppkey * 11 + 3) % 256", "db": "(l_linenumber * CAST(31 AS BIGINT)) % 256",
    "da": "CAST(floor(l_tax * 10000e0) AS BIGINT) % 256", "mask": "(l_orderkey * 13) % 256", "opacity": "least(l_linenumber * CAST(48 AS BIGINT), 256)",
}
#: Types of layers by their rank among siblings.
KIND_CODES = (0, 1, 2, 3, 1584, 4098, 256, 7)
MODE_CODES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 36)


def _choose(values: tuple[int, ...], by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


LAYERS = {
    "type_code": f"CAST(CASE WHEN depth < 3 THEN 0 ELSE {_choose(KIND_CODES, 'layer_id')} END AS BIGINT)", "visibility": "CAST(CASE WHEN layer_id % 7 = 3 THEN 2 ELSE 1 END AS BIGINT)",
    "clip": "CAST(CASE WHEN depth = 3 AND layer_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT)", "opacity": "layer_id % 257", "composite": f"CAST({_choose(MODE_CODES, 'layer_id')} AS BIGINT)",
    "render_mipmap": "CASE WHEN layer_id % 5 = 0 THEN 0 ELSE 100000 + layer_id END", "mask_mipmap": "CASE WHEN layer_id % 4 = 0 THEN 200000 + layer_id ELSE 0 END",
    "text_blob": "CASE WHEN layer_id % 11 = 0 THEN 'text' || CAST(layer_id AS VARCHAR(20)) END",
}
RECTS = {
    "rect_id": "p_partkey", "x": "(p_partkey * 37) % 1900", "y": "(p_partkey * 61) % 1800", "w": "1 + p_partkey % 300", "h": "1 + (p_partkey * 3) % 200", "fill": "(p_partkey * 5) % 256",
}
SEGMENTS = {
    "ordinal": "event_id", "kind": "CASE event_type WHEN 'view' THEN 'RasterRun' WHEN 'click' THEN 'FilterRun' WHEN 'purchase' THEN 'ClipRun' ELSE 'RasterRun' END",
    "depth": "user_id % 3", "passes": "1 + user_id % 4", "tile_events": "CAST(floor(abs(value)) AS BIGINT) % 50", "legacy": "event_id % 2", "span": "1 + event_id % 6", "session": "user_id",
    "reason": "CASE event_id % 6 WHEN 0 THEN 'MissingResource' WHEN 1 THEN 'UnsupportedBlend' WHEN 2 THEN 'ClippedFilter' ELSE NULL END",
}
TILES = {
    "kind": "CASE WHEN o_custkey % 2 = 0 THEN 'raster' ELSE 'mask' END", "layer_id": "o_custkey", "tile_x": "o_orderkey % 8", "tile_y": "(o_orderkey DIV 8) % 8",
    "bytes": "CAST(floor(o_totalprice) AS BIGINT) % 5000", "hash": "CAST(floor(o_totalprice * 100e0) AS BIGINT)", "key": "o_orderkey",
}


def _columns(mapping: dict[str, str]) -> list:
    return [F.expr(v.replace(" DIV ", " div ")).alias(k) for k, v in mapping.items()]


def _sql(mapping: dict[str, str], table: str, first: str = "") -> str:
    return "SELECT " + first + ", ".join(f"{v.replace(' DIV ', ' // ')} AS {k}" for k, v in mapping.items()) + f" FROM {table}"


NODES_SQL = """SELECT CAST(1 AS BIGINT) AS layer_id, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth
UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), 1, 1 FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), 2 FROM nation
UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), 3 FROM customer"""
LAYERS_SQL = f"""SELECT *, {', '.join(f'{v} AS {k}' for k, v in LAYERS.items())},
coalesce(lead(layer_id) OVER (PARTITION BY parent ORDER BY layer_id), 0) AS next_id,
coalesce((SELECT min(c.layer_id) FROM nodes c WHERE c.parent = n.layer_id), 0) AS first_child FROM nodes n"""
LAYERS_SQL = f"nodes AS ({NODES_SQL}), layers AS ({LAYERS_SQL})"
PIXELS_SQL = f"pixels AS ({_sql(PIXELS, 'lineitem')})"
RECTS_SQL = f"rects AS ({_sql(RECTS, 'part')})"
SEGMENTS_SQL = f"segments AS ({_sql(SEGMENTS, 'events')})"
# two snapshots: in the second some tiles changed, some are gone and some are new
OLD = "key % 17 <> 0"
NEW = "key % 13 <> 0"
NEW_HASH = "CASE WHEN key % 11 = 0 THEN hash + 1 ELSE hash END"
SNAPSHOTS_SQL = f"""tiles AS ({_sql(TILES, 'orders')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, layer_id, tile_x, tile_y ORDER BY key) AS nth FROM tiles),
old_tiles AS (SELECT kind, layer_id, tile_x, tile_y, bytes, hash FROM ranked WHERE nth = 1 AND {OLD}),
new_tiles AS (SELECT kind, layer_id, tile_x, tile_y, bytes, {NEW_HASH} AS hash FROM ranked WHERE nth = 1 AND {NEW})"""


class Model:
    def __init__(self, tables) -> None:  # noqa: ANN001
        self.t = tables

    @property
    def pixels(self) -> DataFrame:
        return self.t["lineitem"].select(*_columns(PIXELS))

    @property
    def rects(self) -> DataFrame:
        return self.t["part"].select(*_columns(RECTS))

    @property
    def segments(self) -> DataFrame:
        return self.t["events"].select(*_columns(SEGMENTS))

    @property
    def nodes(self) -> DataFrame:
        root = self.t.spark.range(1, 2).selectExpr("id AS layer_id", "CAST(NULL AS BIGINT) AS parent", "CAST(0 AS BIGINT) AS depth")
        levels = (("region", "r_regionkey", 10, "CAST(1 AS BIGINT)", 1), ("nation", "n_nationkey", 100, "CAST(10 + n_regionkey AS BIGINT)", 2), ("customer", "c_custkey", 1000, "CAST(100 + c_nationkey AS BIGINT)", 3))
        for table, key, base, parent, depth in levels:
            root = root.unionAll(self.t[table].selectExpr(f"CAST({base} + {key} AS BIGINT)", parent, f"CAST({depth} AS BIGINT)"))
        return root

    @property
    def layers(self) -> DataFrame:
        """Layers as they are stored: links to the next sibling and the first child, 0 for none."""
        from pyspark.sql import Window

        nodes = self.nodes
        children = nodes.filter("parent is not null").groupBy("parent").agg(F.min("layer_id").alias("first_child")).withColumnRenamed("parent", "of")
        siblings = Window.partitionBy("parent").orderBy("layer_id")
        linked = nodes.withColumn("next_id", F.coalesce(F.lead("layer_id").over(siblings), F.lit(0))).join(children, F.col("layer_id") == F.col("of"), "left").drop("of")
        return linked.withColumn("first_child", F.coalesce("first_child", F.lit(0))).select("layer_id", "parent", "depth", *_columns(LAYERS), "next_id", "first_child")

    @property
    def tree(self) -> DataFrame:
        """Layers with their parents and without the stored links, for walks from parent to child."""
        return self.nodes.select("layer_id", "parent", "depth", *_columns(LAYERS))

    @property
    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Tiles of two versions, one row per (kind, layer, tile)."""
        from pyspark.sql import Window

        tiles = self.t["orders"].select(*_columns(TILES))
        one = tiles.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "layer_id", "tile_x", "tile_y").orderBy("key"))).filter("nth = 1")
        keep = ["kind", "layer_id", "tile_x", "tile_y", "bytes"]
        return one.filter(OLD).select(*keep, "hash"), one.filter(NEW).select(*keep, F.expr(NEW_HASH).alias("hash"))
