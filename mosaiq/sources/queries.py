"""Queries of the container source: bodies are made from the tables, so nothing but them is read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.checkpoints import spread
from mosaiq.registry import Tables, query
from mosaiq.sources import container


def bodies(t: Tables) -> DataFrame:
    """A body for each customer, one block for each order in order of key; every third one is empty.

    A task reads its customers' orders as a sorted stream, so that it holds no more than one body and a batch.
    """
    schema = pa.schema([("path", pa.string()), ("external_id", pa.string()), ("body", pa.binary())])

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for batch in batches:
            yield from zip(batch.column("o_custkey").to_pylist(), batch.column("o_orderkey").to_pylist(), strict=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for customer, group in groupby(orders(batches), key=itemgetter(0)):
            name = f"extrnlid{customer}"
            body = container.build_body(name, [None if k % 3 == 0 else k.to_bytes(8, "big") * 4 for _, k in group])
            yield ("mem", name, body), len(body)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return container.gathered(made(batches), schema)

    keys = spread(t["orders"].select("o_custkey", "o_orderkey"), "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")
    return keys.mapInArrow(build, "path string, external_id string, body binary")


_B = "WITH b AS (SELECT 'extrnlid' || o_custkey AS external_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS block FROM orders)"


@query("s4_block_scan", f"{_B} SELECT external_id, CAST(block AS INTEGER) AS block, o_orderkey % 3 = 0 AS is_empty FROM b")
def s4(t: Tables) -> DataFrame:
    return container.scan_blocks(bodies(t)).select("external_id", "block", "is_empty")


@query("s5_selected_tiles", f"{_B} SELECT external_id, CAST(block AS INTEGER) AS block FROM b WHERE block IN (1, 3)")
def s5(t: Tables) -> DataFrame:
    return container.scan_blocks(bodies(t), (1, 3)).select("external_id", "block")


@query("s7_tile_inflate", f"{_B} SELECT external_id, CAST(block AS INTEGER) AS block, CASE WHEN o_orderkey % 3 = 0 THEN repeat('FF', 32) ELSE repeat(lpad(to_hex(o_orderkey), 16, '0'), 4) END AS raw FROM b")
def s7(t: Tables) -> DataFrame:
    """Inflated in the tasks; ordinals, not arrival, keep the order."""
    raw = container.inflate_tile(F.col("payload"), F.lit(255), F.lit(32))
    return container.scan_blocks(bodies(t)).select("external_id", "block", F.hex(raw).alias("raw"))


@query("s8_tile_inspection", f"{_B} SELECT external_id, count(*) AS blocks, count(*) FILTER (o_orderkey % 3 <> 0) AS stored, min(block % 4) FILTER (o_orderkey % 3 <> 0) AS x0, max(block // 4) FILTER (o_orderkey % 3 <> 0) AS y1 FROM b GROUP BY external_id")
def s8(t: Tables) -> DataFrame:
    seen = container.inspect_tiles(container.scan_blocks(bodies(t)), 4)
    return seen.select("external_id", "blocks", "stored", F.col("x0").cast("bigint").alias("x0"), F.col("y1").cast("bigint").alias("y1"))
