"""Small tables that are much work are dealt out, and only what is needed is made."""

from pyspark.sql import functions as F

from mosaiq.registry import Tables
from mosaiq.sources import container, queries, readers, regions


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_bodies_are_made_in_many_tasks(spark, sf):
    bodies = queries.bodies(Tables(spark, sf))
    assert tasks_of(bodies) > 8
    assert bodies.select("external_id").distinct().count() == bodies.count() == spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()


def test_blocks_of_many_bodies_come_in_few_batches():
    rows = ((("mem", f"x{k}", k, 5, False, b"abcde"), 105) for k in range(1000))
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("external_id", pa.string()), ("block", pa.int32()), ("raw_bytes", pa.int64()), ("is_empty", pa.bool_()), ("payload", pa.binary())])
    batches = list(container.gathered(rows, schema))
    assert [b.num_rows for b in batches] == [1000]
    assert list(container.gathered(iter([]), schema)) == []


def test_only_tiles_of_the_region_are_made(spark, sf):
    t = Tables(spark, sf)
    tiles = regions.made_tiles(t, "rgba", (257, 3, 1, 1))
    assert {r.block for r in tiles.select("block").distinct().collect()} == {1}
    whole = (0, 0, regions.WIDTH, regions.HEIGHT)
    every = regions.made_tiles(t, "mask", whole)
    assert {r.block for r in every.select("block").distinct().collect()} == {0, 1, 2, 3}
    assert tasks_of(every.drop("raw")) > 2


def test_sums_of_a_region_are_those_of_its_pixels(spark, sf):
    t, region = Tables(spark, sf), (200, 240, 90, 40)
    tiles = regions.made_tiles(t, "gray", region)
    size = (regions.WIDTH, regions.HEIGHT)
    want = regions.read_region(tiles, "gray", size, region).groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), *(F.sum(c).alias(c) for c in "rgba"))
    got = regions.sum_region(tiles, "gray", size, region)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pngs_are_read_in_many_tasks(spark, sf):
    assert tasks_of(readers.s17(Tables(spark, sf))) > 8
