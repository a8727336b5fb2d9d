"""Plans and their reports (Q1 to Q5, P17, E5 to E38): which parts run tile by tile, and why others don't."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query
from mosaiq.model import LAYERS_SQL, RECTS_SQL, SEGMENTS_SQL
from mosaiq.operators.statistics import _TILED, COST, explode_tiles

#: What a source can be, by its kind and whether something bars it: the letter that the run rules read.
CODE = "CASE WHEN reason IS NOT NULL THEN 'X' WHEN kind = 'RasterRun' THEN 'R' WHEN kind = 'FilterRun' THEN 'F' WHEN kind = 'ClipRun' THEN 'C' ELSE 'R' END"
BARRIER = "CASE WHEN reason IS NOT NULL THEN reason WHEN depth > 1 AND kind = 'FilterRun' THEN 'FilterInScope' WHEN tile_events > 40 THEN 'TooManyEvents' WHEN tile_events = 0 THEN 'EmptyTarget' END"


@query("p17_segment_eligibility", f"WITH {SEGMENTS_SQL} SELECT ordinal, {BARRIER} AS barrier FROM segments WHERE {BARRIER} IS NOT NULL")
def p17(t: Tables) -> DataFrame:
    return t.model.segments.select("ordinal", F.expr(BARRIER).alias("barrier")).filter("barrier is not null")


def lower_runs(sources: DataFrame) -> DataFrame:
    """Q1, Q2: cuts each session's sources greedily into segments, first rule that fits.

    A clip run is a segment of its own, then come runs of rasters and filters
    mixed (2 at least, both kinds), of filters, of rasters, and barriers one by
    one. Clips and barriers end runs, so a run is what stands between them:
    running sums find it and no fold is needed.
    """
    order = Window.partitionBy("session").orderBy("ordinal")
    coded = sources.withColumn("code", F.expr(CODE))
    alone = F.col("code").isin("X", "C")
    cut = (alone | F.coalesce(F.lag(alone).over(order), F.lit(True))).cast("int")
    runs = coded.withColumn("alone", alone).withColumn("cut", cut).withColumn("run", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.groupBy("session", "run").agg(F.min("ordinal").alias("start"), F.count(F.lit(1)).alias("sources"), F.bool_or(F.col("code") == "R").alias("r"), F.bool_or(F.col("code") == "F").alias("f"), F.min("code").alias("code"))
    kind = F.when(F.col("code") == "C", "ClippingRun").when(F.col("code") == "X", "Barrier").when(F.col("r") & F.col("f"), "RasterFilterRun").when(F.col("f"), "PointFilterRun").otherwise("RasterRun")
    return counted.select("session", "start", "sources", kind.alias("kind"))


_RUNS = f"""WITH {SEGMENTS_SQL}, c AS (SELECT *, {CODE} AS code FROM segments), k AS (SELECT *, CASE WHEN code IN ('X', 'C') OR coalesce(lag(code) OVER (PARTITION BY session ORDER BY ordinal), 'X') IN ('X', 'C') THEN 1 ELSE 0 END AS cut FROM c),
r AS (SELECT *, sum(cut) OVER (PARTITION BY session ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM k),
plan AS (SELECT session, min(ordinal) AS start, count(*) AS sources, CASE WHEN min(code) = 'C' THEN 'ClippingRun' WHEN min(code) = 'X' THEN 'Barrier' WHEN bool_or(code = 'R') AND bool_or(code = 'F') THEN 'RasterFilterRun' WHEN bool_or(code = 'F') THEN 'PointFilterRun' ELSE 'RasterRun' END AS kind FROM r GROUP BY session, run)"""


@query("q1_lowered_runs", f"{_RUNS} SELECT * FROM plan")
def q1(t: Tables) -> DataFrame:
    return lower_runs(t.model.segments)


@query("q3_plan_report", f"{_RUNS} SELECT session, count(*) AS segments, count(*) FILTER (kind <> 'Barrier') AS tile_local, count(*) FILTER (kind = 'Barrier') AS barriers, count(*) FILTER (kind <> 'Barrier') / CAST(count(*) AS DOUBLE) AS share FROM plan GROUP BY session")
def q3(t: Tables) -> DataFrame:
    local = F.count_if(F.col("kind") != "Barrier")
    return lower_runs(t.model.segments).groupBy("session").agg(F.count(F.lit(1)).alias("segments"), local.alias("tile_local"), F.count_if(F.col("kind") == "Barrier").alias("barriers"), (local / F.count(F.lit(1)).cast("double")).alias("share"))


@query("q5_task_graph", f"{_RUNS} SELECT kind, count(*) AS tasks, CAST(sum(sources) AS BIGINT) AS sources, max(sources) AS longest FROM plan GROUP BY kind")
def q5(t: Tables) -> DataFrame:
    return lower_runs(t.model.segments).groupBy("kind").agg(F.count(F.lit(1)).alias("tasks"), F.sum("sources").alias("sources"), F.max("sources").alias("longest"))


@query("q1_lowered_runs_by_fold")
def q1_fold(t: Tables) -> DataFrame:
    """The same plan by a fold over each session's sources: the independent engine that the tests hold against q1."""

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group, out, k = group.sort_values("ordinal"), [], 0
        code = group["code"].tolist()
        while k < len(code):
            n = 1
            if code[k] in "RF":
                while k + n < len(code) and code[k + n] in "RF":
                    n += 1
            part = set(code[k : k + n])
            kind = {"C": "ClippingRun", "X": "Barrier"}.get(code[k]) or ("RasterFilterRun" if len(part) == 2 else "PointFilterRun" if part == {"F"} else "RasterRun")
            out.append((group["session"].iloc[0], group["ordinal"].iloc[k], n, kind))
            k += n
        return pd.DataFrame(out, columns=["session", "start", "sources", "kind"])

    return t.model.segments.withColumn("code", F.expr(CODE)).select("session", "ordinal", "code").groupBy("session").applyInPandas(plan, "session bigint, start bigint, sources bigint, kind string")


@query("e10_scope_events", f"WITH {LAYERS_SQL}, s AS (SELECT layer_id, parent, type_code IN (0, 2, 256) AS scope FROM layers) SELECT layer_id, event FROM (SELECT layer_id, CASE WHEN scope THEN 'begin' ELSE 'draw' END AS event FROM s UNION ALL SELECT layer_id, 'end' FROM s WHERE scope)")
def e10(t: Tables) -> DataFrame:
    """A tree as a stream of events; scopes give two."""
    scope = F.col("type_code").isin(0, 2, 256)
    return t.model.layers.select("layer_id", F.explode(F.when(scope, F.array(F.lit("begin"), F.lit("end"))).otherwise(F.array(F.lit("draw")))).alias("event"))


@query("e13_source_validation", f"WITH {LAYERS_SQL} SELECT layer_id, opacity NOT BETWEEN 0 AND 256 AS bad_opacity, type_code IN (1, 3) AND render_mipmap = 0 AS no_resource, type_code = 3 AND mask_mipmap = 0 AS no_mask FROM layers")
def e13(t: Tables) -> DataFrame:
    return t.model.layers.selectExpr("layer_id", "opacity NOT BETWEEN 0 AND 256 AS bad_opacity", "type_code IN (1, 3) AND render_mipmap = 0 AS no_resource", "type_code = 3 AND mask_mipmap = 0 AS no_mask")


@query("e20_segment_profile", f"WITH {SEGMENTS_SQL} SELECT session, kind, count(*) AS nodes, count(*) FILTER (depth > 0) AS scopes, max({COST}) AS dearest, arg_min(ordinal, [-({COST}), ordinal]) AS ordinal FROM segments GROUP BY session, kind")
def e20(t: Tables) -> DataFrame:
    s = t.model.segments.withColumn("cost", F.expr(COST))
    return s.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("depth") > 0).alias("scopes"), F.max("cost").alias("dearest"), F.min_by("ordinal", F.struct(-F.col("cost"), F.col("ordinal"))).alias("ordinal"))


@query("e22_common_key", f"WITH {SEGMENTS_SQL} SELECT session, count(DISTINCT kind) = 1 AS common, min(kind) AS kind FROM segments GROUP BY session")
def e22(t: Tables) -> DataFrame:
    return t.model.segments.groupBy("session").agg((F.count_distinct("kind") == 1).alias("common"), F.min("kind").alias("kind"))


_GUARD = "CASE WHEN count(*) > 32 THEN 'TooManySources' WHEN sum(tile_events) > 640 THEN 'TooManyEvents' ELSE 'Resident' END"


@query("e24_resident_guard", f"WITH {SEGMENTS_SQL} SELECT session, {_GUARD} AS decision FROM segments GROUP BY session")
def e24(t: Tables) -> DataFrame:
    """Fails closed beyond its limits."""
    return t.model.segments.groupBy("session").agg(F.when(F.count(F.lit(1)) > 32, "TooManySources").when(F.sum("tile_events") > 640, "TooManyEvents").otherwise("Resident").alias("decision"))


_SKIP = "CASE WHEN kind = 'ClipRun' THEN 'ClippedSource' WHEN kind = 'FilterRun' AND depth > 0 THEN 'NestedFilter' WHEN legacy = 1 THEN 'LegacySource' WHEN tile_events = 0 THEN 'NoTiles' ELSE 'Lowered' END"


@query("e25_skip_reasons", f"WITH {SEGMENTS_SQL} SELECT {_SKIP} AS outcome, count(*) AS n FROM segments GROUP BY 1")
def e25(t: Tables) -> DataFrame:
    return t.model.segments.groupBy(F.expr(_SKIP).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("e26_mask_coverage", f"WITH {RECTS_SQL}, tl AS ({_TILED}) SELECT rect_id, CAST(sum((least(x + w, tile_x * 256 + 256) - greatest(x, tile_x * 256)) * (least(y + h, tile_y * 256 + 256) - greatest(y, tile_y * 256))) AS BIGINT) = max(w * h) AS covered FROM tl WHERE tile_x < 7 GROUP BY rect_id")
def e26(t: Tables) -> DataFrame:
    """Whether the parts in stored tiles make up the whole."""
    part = F.expr("(least(x + w, tile_x * 256 + 256) - greatest(x, tile_x * 256)) * (least(y + h, tile_y * 256 + 256) - greatest(y, tile_y * 256))")
    return explode_tiles(t.model.rects).filter("tile_x < 7").groupBy("rect_id").agg((F.sum(part) == F.max(F.col("w") * F.col("h"))).alias("covered"))


@query("e35_report_json", f"WITH {SEGMENTS_SQL}, a AS (SELECT session, count(*) AS n, count(*) FILTER (reason IS NOT NULL) AS barriers FROM segments GROUP BY session) SELECT session, '{{\"session\":' || session || ',\"segments\":' || n || ',\"barriers\":' || barriers || '}}' AS report FROM a")
def e35(t: Tables) -> DataFrame:
    """A report line as JSON."""
    a = t.model.segments.groupBy("session").agg(F.count(F.lit(1)).alias("segments"), F.count("reason").alias("barriers"))
    return a.select("session", F.to_json(F.struct("session", "segments", "barriers")).alias("report"))
