"""Anchors, formats, caches and folds that SQL doesn't check."""

import struct
import zlib

import pytest

from mosaiq import catalog
from mosaiq.functions import filters
from mosaiq.operators.planning import lower_runs
from mosaiq.operators.tiling import coalesce_rects, pack_shelves
from mosaiq.registry import Tables
from mosaiq.sources import container
from mosaiq.streaming import sessions


def picks(table, *at):
    return [table[v] for v in at]


def test_filter_anchors():
    assert picks(filters.brightness_contrast(20, -10), 0, 20, 64, 128, 200, 255) == [10, 10, 51, 110, 176, 227]
    assert picks(filters.levels(0, 20000, 65535, 0, 65535), 0, 25, 64, 128, 192, 230, 255) == [0, 5, 24, 78, 157, 214, 255]
    assert picks(filters.posterize(4), 63, 64, 127, 128, 191, 192) == [0, 85, 85, 170, 170, 255]
    assert picks(filters.threshold(128), 127, 128) == [0, 255] and picks(filters.invert(), 0, 64, 255) == [255, 191, 0]
    r, g, b = filters.color_balance(1, (0, 0, 0), (43, -48, 48), (0, 0, 0))
    assert [[t[v] for t in (r, g, b)] for v in (64, 128, 192, 226)] == [[81, 30, 84], [144, 88, 146], [201, 164, 203], [231, 212, 231]]
    r, g, b = filters.color_balance(0, (-20, 10, 35), (40, -30, 15), (25, 0, -50))
    assert [[t[v] for t in (r, g, b)] for v in (32, 64, 128, 192, 226)] == [[29, 23, 36], [76, 52, 70], [152, 115, 133], [218, 184, 195], [250, 222, 228]]
    assert filters.tables(1, b"\0") is None and filters.tables(99, bytes(64)) is None and filters.tables(2, bytes(10)) is None
    assert filters.tables(6, b"")[0] == filters.invert() and filters.tables(8, struct.pack(">i", 128))[0][128] == 255
    line = filters.curve_table([(0, 0), (65535, 65535)])
    assert line[0] == 0 and line[-1] == 65535 and all(abs(line[k] - k) <= 1 for k in range(0, 65536, 999))


def test_container_reads_back(spark, tmp_path):
    raw = bytes(range(256)) * 256 * 5
    body = container.build_body("extrnlidA", [raw, None, (b"\0\1\2\3", len(raw))])
    (tmp_path / "a.bin").write_bytes(container.build_container([body, container.build_body("extrnlidA", [None])]))
    chunks = container.scan_chunks(spark, str(tmp_path))
    assert sorted((r.kind, r.external_id) for r in chunks.collect()) == [("CHNKExta", "extrnlidA"), ("CHNKExta", "extrnlidA"), ("CHNKSQLi", None)]
    blocks = container.scan_blocks(container.first_bodies(chunks))
    assert [(r.block, r.raw_bytes, r.is_empty) for r in blocks.orderBy("block").collect()] == [(0, len(raw), False), (1, len(raw), True), (2, len(raw), False)]
    seen = container.inspect_tiles(blocks, 2).collect()[0]
    assert (seen.blocks, seen.stored, seen.stored_bytes, seen.x0, seen.x1, seen.y1) == (3, 2, len(zlib.compress(raw, 1)) + 4, 0, 0, 1)
    from pyspark.sql import functions as F

    tiles = blocks.withColumn("raw", container.inflate_tile(F.col("payload"), F.lit(0), F.col("raw_bytes"))).collect()
    assert [None if r.raw is None else bytes(r.raw) for r in sorted(tiles, key=lambda r: r.block)] == [raw, bytes(len(raw)), None]


@pytest.mark.parametrize(("data", "why"), [(b"x" * 30, "InvalidMagic"), (container.MAGIC + bytes(16), "MissingDatabase"), (container.MAGIC + bytes(16) + b"abc", "TruncatedHeader"), (container.build_container([])[:-1], "TruncatedBody")])
def test_container_errors(data, why):
    with pytest.raises(container.ContainerError, match=why):
        container.read_chunks(data)


def test_tile_layouts():
    n = container.TILE**2
    rgba = container.decode_tile(bytes([7]) * n + bytes([1, 2, 3, 0]) * n, "rgba")
    assert rgba[5, 6].tolist() == [3, 2, 1, 7]
    assert container.decode_tile(bytes([9]) * n + bytes([4]) * n, "gray")[0, 0].tolist() == [4, 4, 4, 9]
    assert container.decode_tile(b"\x80" + bytes(n // 4 - 1), "mono")[0, :2].tolist() == [[0, 0, 0, 255], [0, 0, 0, 0]]
    assert container.decode_tile(bytes([5]) * n, "mask").shape == (256, 256)
    assert container.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128]), 8) == bytes([1, 2, 3, 9, 9, 9, 0, 0])


def test_fnv():
    assert container.fnv1a([]) == 0xCBF29CE484222325
    assert container.fnv1a([b"a", 1]) != container.fnv1a([b"a", None])


def test_packing_and_coalescing():
    assert pack_shelves([(10, 5), (10, 8), (10, 3)]) == [(0, 0), (0, 5), (0, 13)]
    assert pack_shelves([]) is None and pack_shelves([(9000, 1)]) is None
    assert coalesce_rects({(0, 0, 10, 10), (10, 0, 20, 10), (40, 40, 50, 50), (20, 10, 22, 12)}) == [(0, 0, 22, 12), (40, 40, 50, 50)]


def test_slot_cache():
    cache = sessions.SlotCache()
    assert cache.plan([("a", 1), ("b", 1), ("a", 9)]) == [("a", 0, "inserted"), ("b", 1, "inserted")]
    assert cache.plan([("a", 2)]) == [("a", 0, "changed")]
    assert cache.plan([("a", 2), ("c", 1)]) == [("a", 0, "reuse"), ("c", 1, "inserted")]


def test_checkpoint_cache():
    cache = sessions.CheckpointCache(budget=100)
    assert cache.store("a", 5, 40) and cache.store("b", 3, 40) and not cache.store("c", 1, 40)
    assert cache.store("d", 4, 40) and cache.get("a") and not cache.get("b") and not cache.store("e", 9, 101)
    assert [r["hit"] for r in sessions.answer_requests(iter([[{"key": "a", "priority": 1, "bytes": 1}]]), cache)] == [True]


def test_lowering_matches_fold(spark, sf):
    t = Tables(spark, sf)
    fold = catalog.QUERIES["q1_lowered_runs_by_fold"](spark, sf)
    key = lambda df: sorted((r.session, r.start, r.sources, r.kind) for r in df.collect())
    assert key(lower_runs(t.model.segments)) == key(fold)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.limit(300).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 300


def test_links_give_parents_and_order(spark):
    from mosaiq.operators import hierarchy

    tree = spark.createDataFrame([(1, 0, 2), (2, 3, 0), (3, 4, 5), (4, 0, 0), (5, 6, 0), (6, 0, 0)], "layer_id bigint, next_id bigint, first_child bigint")
    assert sorted((r.layer_id, r.parent, r.rank) for r in hierarchy.linked(tree).collect() if r.parent) == [(2, 1, 0), (3, 1, 1), (4, 1, 2), (5, 3, 0), (6, 3, 1)]


def test_png_filters():
    import struct
    import zlib

    import numpy as np

    from mosaiq.sources import readers

    px = np.random.default_rng(1).integers(0, 256, (4, 5, 4)).astype(np.uint8)
    assert (readers.read_png(readers.write_png(px, [0, 1, 2, 1])) == px).all()
    # average and Paeth rows by their definition, one channel value at a time
    rows, raw = [], px.astype(int)
    for y, how in enumerate([3, 4, 4, 3]):
        row = [how]
        for x in range(5):
            for c in range(4):
                a, b, d = (raw[y, x - 1, c] if x else 0), (raw[y - 1, x, c] if y else 0), (raw[y - 1, x - 1, c] if x and y else 0)
                p = a + b - d
                guess = (a + b) // 2 if how == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row.append((raw[y, x, c] - guess) % 256)
        rows.append(bytes(int(v) for v in row))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    made = readers.PNG_MAGIC + chunk(b"IHDR", struct.pack(">2I5B", 5, 4, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (readers.read_png(made) == px).all()


def test_gray_png():
    """Gray, with and without alpha, in rows of every filter that sums along a row."""
    import struct
    import zlib

    import numpy as np

    from mosaiq.sources import readers

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    made = lambda color, rows: readers.PNG_MAGIC + chunk(b"IHDR", struct.pack(">2I5B", 3, 2, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    gray = readers.read_png(made(0, bytes([0, 10, 20, 250, 1, 250, 5, 3])))
    assert gray.tolist() == [[[v, v, v, 255] for v in row] for row in ([10, 20, 250], [250, 255, 2])]
    both = readers.read_png(made(4, bytes([0, 1, 100, 2, 200, 3, 255, 2, 1, 1, 1, 100, 1, 1])))
    assert both.tolist() == [[[v, v, v, a] for v, a in row] for row in ([(1, 100), (2, 200), (3, 255)], [(2, 101), (3, 44), (4, 0)])]
    assert both.dtype == np.uint8
