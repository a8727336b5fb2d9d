"""Reads of parts of tiled images: only the tiles that a region touches are decoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.checkpoints import spread
from mosaiq.model import RECTS_SQL
from mosaiq.registry import Tables, query
from mosaiq.sources import container

#: Width and height of the images of the queries below, one for each supplier, over two by two tiles.
WIDTH, HEIGHT = 300, 260
#: A region that crosses the edges of all four tiles.
REGION = (250, 254, 12, 5)
#: Pixels, and tiles, that a task gathers before they leave it.
BATCH_PIXELS, TILES_A_BATCH = 100_000, 16
PIXEL = "image bigint, x bigint, y bigint, r int, g int, b int, a int"


def touched(tiles: DataFrame, size: tuple[int, int], region: tuple[int, int, int, int]) -> DataFrame:
    """Those of tiles(block) that a region (x, y, w, h) of an image of that size touches."""
    columns, rows = (-(-n // container.TILE) for n in size)
    x0, y0, x1, y1 = cut_region(size, region)
    tx, ty = F.col("block") % columns, F.floor(F.col("block") / columns)
    return tiles.filter((F.col("block") < columns * rows) & ((tx + 1) * container.TILE > x0) & (tx * container.TILE < x1) & ((ty + 1) * container.TILE > y0) & (ty * container.TILE < y1))


def cut_region(size: tuple[int, int], region: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The bounds (x0, y0, x1, y1) of a region (x, y, w, h), cut to the image."""
    x, y, w, h = region
    return max(x, 0), max(y, 0), min(x + w, size[0]), min(y + h, size[1])


def decoded(batch: pa.RecordBatch, layout: str, size: tuple[int, int], region: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(image, x, y, pixels) of what each tile of a batch(image, block, raw) has of a region; x and y are of the first pixel."""
    columns = -(-size[0] // container.TILE)
    x0, y0, x1, y1 = cut_region(size, region)
    for image, block, raw in zip(batch.column("image").to_pylist(), batch.column("block").to_pylist(), batch.column("raw"), strict=True):
        left, top = block % columns * container.TILE, block // columns * container.TILE
        a, b, c, d = max(x0 - left, 0), min(x1 - left, container.TILE), max(y0 - top, 0), min(y1 - top, container.TILE)
        if raw.is_valid:
            px = container.decode_tile(raw.as_buffer(), layout)[c:d, a:b]
            px = np.repeat(px[..., None], 4, -1) if px.ndim == 2 else px
        else:
            px = np.zeros((d - c, b - a, 4), np.uint8)
        yield image, left + a, top + c, px


def read_region(tiles: DataFrame, layout: str, size: tuple[int, int], region: tuple[int, int, int, int]) -> DataFrame:
    """Pixels (image, x, y, r, g, b, a) of a region (x, y, w, h) from tiles(image, block, raw); null raw is transparent.

    Tiles outside the region go before any is decoded, and what a tile has
    outside of it doesn't leave the task. A region is cut to the image.
    """

    def batch_of(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = [px.shape[0] * px.shape[1] for *_, px in parts]
        x = np.concatenate([np.tile(np.arange(left, left + px.shape[1]), px.shape[0]) for _, left, _, px in parts])
        y = np.concatenate([np.repeat(np.arange(top, top + px.shape[0]), px.shape[1]) for _, _, top, px in parts])
        rgba = np.concatenate([px.reshape(-1, 4) for *_, px in parts]).astype(np.int32)
        image = np.repeat(np.array([i for i, *_ in parts], np.int64), sizes)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (image, x, y, *(np.ascontiguousarray(rgba[:, k]) for k in range(4)))], ["image", "x", "y", *"rgba"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in decoded(batch, layout, size, region):
                held.append((*part[:3], part[3].copy()))
                n += part[3].shape[0] * part[3].shape[1]
                if n >= BATCH_PIXELS:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    return touched(tiles, size, region).select("image", "block", "raw").mapInArrow(run, PIXEL)


def sum_region(tiles: DataFrame, layout: str, size: tuple[int, int], region: tuple[int, int, int, int]) -> DataFrame:
    """(image, pixels, r, g, b, a) of a region: how many pixels, and the sums of their channels; each tile is added up where it is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(image, px.shape[0] * px.shape[1], *px.sum(axis=(0, 1), dtype=np.int64).tolist()) for image, _, _, px in decoded(batch, layout, size, region)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["image", "pixels", *"rgba"])  # noqa: B905

    parts = touched(tiles, size, region).select("image", "block", "raw").mapInArrow(run, "image bigint, pixels bigint, r bigint, g bigint, b bigint, a bigint")
    return parts.groupBy("image").agg(*(F.sum(c).alias(c) for c in ("pixels", *"rgba")))


def encode_tile(r: np.ndarray, g: np.ndarray, b: np.ndarray, a: np.ndarray, layout: str) -> bytes:
    """A tile's bytes from its channels, modulo 256: planes as decode_tile reads them."""
    byte = lambda v: v.astype(np.uint8)
    if layout == "rgba":
        return byte(a).tobytes() + np.stack([byte(b), byte(g), byte(r), byte(a) * 0], -1).tobytes()
    if layout == "gray":
        return byte(a).tobytes() + byte(r).tobytes()
    if layout == "mono":
        return np.packbits(byte(a).ravel() > 127).tobytes() + np.packbits(byte(r).ravel() > 127).tobytes()
    return byte(a).tobytes()


def made_tiles(t: Tables, layout: str, region: tuple[int, int, int, int]) -> DataFrame:
    """The tiles that a region touches, of four for each supplier, by the formulas of the SQL below; of every third supplier the last one isn't stored.

    Images and numbers of tiles are rows that are dealt out before any tile is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[: container.TILE, : container.TILE]
        # what doesn't depend on the image, modulo 256 like all that follows
        planes = [[v.astype(np.uint8) for v in (px, px * 3 + py, py, px + py * 7)] for px, py in ((x + block % 2 * container.TILE, y + block // 2 * container.TILE) for block in range(4))]
        for batch in batches:
            for at in range(0, batch.num_rows, TILES_A_BATCH):
                part = batch.slice(at, TILES_A_BATCH)
                raws = []
                for key, block in zip(part.column("image").to_pylist(), part.column("block").to_pylist(), strict=True):
                    r, g, b, a = planes[block]
                    raws.append(None if key % 3 == 0 and block == 3 else encode_tile(r + np.uint8(key * 5 % 256), g, b + np.uint8(key % 256), a + np.uint8(key % 256), layout))
                yield pa.RecordBatch.from_arrays([part.column("image"), part.column("block"), pa.array(raws, pa.binary())], ["image", "block", "raw"])

    every = t["supplier"].select(F.col("s_suppkey").alias("image"), F.explode(F.expr("sequence(0, 3)")).alias("block"))
    return spread(touched(every, (WIDTH, HEIGHT), region), "image", "block").mapInArrow(run, "image bigint, block int, raw binary")


def made_region(t: Tables, layout: str, region: tuple[int, int, int, int]) -> DataFrame:
    return read_region(made_tiles(t, layout, region), layout, (WIDTH, HEIGHT), region)


def _region_sql(region: tuple[int, int, int, int], r: str, g: str, b: str, a: str) -> str:
    """SQL for the pixels of a region; k is the supplier, x and y the place."""
    x0, y0, w, h = region
    gone = "(s_suppkey % 3 = 0 AND x >= 256 AND y >= 256)"
    part = ", ".join(f"CAST(CASE WHEN {gone} THEN 0 ELSE {v} END AS INTEGER) AS {c}" for v, c in zip((r, g, b, a), "rgba", strict=True))
    return f"SELECT s_suppkey AS image, x, y, {part} FROM supplier, range({max(x0, 0)}, {min(x0 + w, WIDTH)}) p(x), range({max(y0, 0)}, {min(y0 + h, HEIGHT)}) q(y)"


_R, _G, _B, _A = "(s_suppkey * 5 + x) % 256", "(x * 3 + y) % 256", "(y + s_suppkey) % 256", "(x + y * 7 + s_suppkey) % 256"
_ON = lambda v: f"CASE WHEN {v} > 127 THEN 255 ELSE 0 END"
LAYOUTS = {"rgba": (_R, _G, _B, _A), "gray": (_R, _R, _R, _A), "mono": (_ON(_R), _ON(_R), _ON(_R), _ON(_A)), "mask": (_A, _A, _A, _A)}
for _layout, _parts in LAYOUTS.items():
    query(f"t1_tiles_{_layout}", _region_sql(REGION, *_parts))(lambda t, k=_layout: made_region(t, k, REGION))


@query("s15_image_region", _region_sql((-5, 250, 12, 30), *LAYOUTS["rgba"]))
def s15(t: Tables) -> DataFrame:
    """A region that lies partly outside of the image."""
    return made_region(t, "rgba", (-5, 250, 12, 30))


@query("c9_image_summary", f"SELECT image, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS r, CAST(sum(a) AS BIGINT) AS a FROM ({_region_sql((0, 0, WIDTH, HEIGHT), *LAYOUTS['rgba'])}) GROUP BY image")
def c9(t: Tables) -> DataFrame:
    """Whole images, added up where their tiles are decoded."""
    whole = (0, 0, WIDTH, HEIGHT)
    return sum_region(made_tiles(t, "rgba", whole), "rgba", (WIDTH, HEIGHT), whole).select("image", "pixels", "r", "a")


@query("e31_pixel_sample", _region_sql((257, 3, 1, 1), *LAYOUTS["rgba"]))
def e31(t: Tables) -> DataFrame:
    """The sources' pixel at one place, from one tile each."""
    return made_region(t, "rgba", (257, 3, 1, 1))


@query("e33_decode_counters", f"SELECT image, count(DISTINCT (x // 256, y // 256)) AS tiles, count(*) AS pixels FROM ({_region_sql(REGION, *LAYOUTS['mask'])}) GROUP BY image")
def e33(t: Tables) -> DataFrame:
    """How many tiles and pixels a region took."""
    px = made_region(t, "mask", REGION)
    return px.groupBy("image").agg(F.count_distinct(F.floor(F.col("x") / 256), F.floor(F.col("y") / 256)).alias("tiles"), F.count(F.lit(1)).alias("pixels"))


#: Bounds to which events are cut.
BOUNDS = (300, 200, 900, 700)


@query(
    "t9_clipped_events",
    f"""WITH {RECTS_SQL}, c AS (SELECT rect_id, x, y, greatest(x, 300) AS cx, greatest(y, 200) AS cy, least(x + w, 1200) AS ex, least(y + h, 900) AS ey FROM rects)
SELECT rect_id, cx - 300 AS x, cy - 200 AS y, ex - cx AS w, ey - cy AS h, (cx - x) // 64 AS first_tile_x, (cy - y) // 64 AS first_tile_y, (cx - x) % 64 AS in_x, (cy - y) % 64 AS in_y FROM c WHERE ex > cx AND ey > cy""",
)
def t9(t: Tables) -> DataFrame:
    """Events cut to bounds; what is cut off on the left and above moves on in the source's tiles of 64."""
    bx, by, bw, bh = BOUNDS
    cut = t.model.rects.selectExpr("rect_id", "x", "y", f"greatest(x, {bx}) AS cx", f"greatest(y, {by}) AS cy", f"least(x + w, {bx + bw}) AS ex", f"least(y + h, {by + bh}) AS ey").filter("ex > cx AND ey > cy")
    return cut.selectExpr("rect_id", f"cx - {bx} AS x", f"cy - {by} AS y", "ex - cx AS w", "ey - cy AS h", "(cx - x) div 64 AS first_tile_x", "(cy - y) div 64 AS first_tile_y", "(cx - x) % 64 AS in_x", "(cy - y) % 64 AS in_y")


@query("e18_row_padding", f"WITH {RECTS_SQL} SELECT rect_id, (w * 4 + 255) // 256 * 256 AS stride, (w * 4 + 255) // 256 * 256 * h AS padded, w * 4 * h AS bytes FROM rects")
def e18(t: Tables) -> DataFrame:
    """Bytes of a region whose rows are padded to 256, and without."""
    return t.model.rects.selectExpr("rect_id", "(w * 4 + 255) div 256 * 256 AS stride", "(w * 4 + 255) div 256 * 256 * h AS padded", "w * 4 * h AS bytes")
