"""Layered-document containers as a Spark data source, and their tile blobs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: magic, chunk kinds, block names, tile side.
MAGIC, DATABASE, EXTERNAL = b"CSFCHUNK", b"CHNKSQLi", b"CHNKExta"
BEGIN, STATUS, SUMS, END = "BlockDataBeginChunk", "BlockStatus", "BlockCheckSum", "BlockDataEndChunk"
NAME_MARK, TILE = 0x0042006C, 256

#: Bytes that a task gathers before they leave it.
BATCH_BYTES = 4 << 20

CHUNKS = "path string, pos bigint, kind string, external_id string, body binary"
BLOCKS = "path string, external_id string, block int, raw_bytes bigint, is_empty boolean, payload binary"


class ContainerError(ValueError):
    """A container that can't be read; the first word says why."""


def read_chunks(data: bytes) -> list[tuple[int, str, str | None, bytes]]:
    """(place, kind, external id, body) of each chunk; a container needs a database."""
    if len(data) < 24 or data[:8] != MAGIC:
        raise ContainerError("InvalidMagic")
    out, pos = [], 24
    while pos < len(data):
        if pos + 16 > len(data):
            raise ContainerError(f"TruncatedHeader at {pos}")
        kind, size = struct.unpack_from(">8sQ", data, pos)
        body = data[pos + 16 : pos + 16 + size]
        if len(body) < size:
            raise ContainerError(f"TruncatedBody at {pos}: {size} declared, {len(body)} there")
        out.append((pos, kind.decode("latin-1"), external_id(body) if kind == EXTERNAL else None, body))
        pos += 16 + size
    if not any(k == DATABASE.decode() for _, k, _, _ in out):
        raise ContainerError("MissingDatabase")
    return out


def external_id(body: bytes) -> str:
    try:
        (n,) = struct.unpack_from(">Q", body)
        if 8 + n > len(body):
            raise ContainerError("InvalidExternalHeader")
        return body[8 : 8 + n].decode()
    except (struct.error, UnicodeDecodeError) as e:
        raise ContainerError("InvalidExternalHeader") from e


def read_blocks(body: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(index, size when inflated, payload or None) of each data block, lazily, so that a reader can stop early."""
    pos, index = 16 + len(external_id(body).encode()), 0
    try:
        while pos + 8 <= len(body):
            first, second = struct.unpack_from(">2I", body, pos)
            # a block either begins with its length, or right away with the length of its name
            at, name_units, outer = (pos + 4, first, 0) if second == NAME_MARK else (pos + 8, second, first)
            if not 0 < name_units < 256:
                raise ContainerError("InvalidBlockName")
            inner = at + 2 * name_units
            name = body[at:inner].decode("utf-16-be")
            end = inner + outer
            if name == BEGIN:
                size, exists = struct.unpack_from(">I", body, inner + 4)[0], struct.unpack_from(">I", body, inner + 16)[0]
                payload, end = None, inner + 20
                if exists:
                    length, packed = struct.unpack_from(">I", body, inner + 20)[0], struct.unpack_from("<I", body, inner + 24)[0]
                    payload, end = body[inner + 28 : inner + 28 + packed], inner + 24 + length
                    if len(payload) < packed:
                        raise ContainerError("TruncatedBlock")
                yield index, size, payload
                index += 1
            elif name in (STATUS, SUMS):
                end = inner + 24
                if inner + 12 <= len(body):
                    _, count, size = struct.unpack_from(">3I", body, inner)
                    if size <= 64 and inner + 12 + count * size <= len(body):
                        end = inner + 12 + count * size
            elif name != END:
                raise ContainerError(f"UnsupportedBlock {name}")
            if end > len(body):
                raise ContainerError("InvalidBlock ends beyond the body")
            pos = end
    except struct.error as e:
        raise ContainerError("TruncatedBlock") from e


def scan_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of the containers under path. Spark lists and reads the files, so any store works that it can read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in read_chunks(data)], columns=["path", "pos", "kind", "external_id", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CHUNKS)


def first_bodies(chunks: DataFrame) -> DataFrame:
    """S3: one body per path and external id, the first."""
    return chunks.filter(F.col("kind") == EXTERNAL.decode()).groupBy("path", "external_id").agg(F.min_by("body", "pos").alias("body"))


def scan_blocks(bodies: DataFrame, tiles: tuple[int, ...] | None = None) -> DataFrame:
    """Blocks of bodies(path, external_id, body); with tiles only those, and nothing is read after the last of them."""
    wanted = None if tiles is None else set(tiles)
    schema = pa.schema([("path", pa.string()), ("external_id", pa.string()), ("block", pa.int32()), ("raw_bytes", pa.int64()), ("is_empty", pa.bool_()), ("payload", pa.binary())])

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int]]:
        for path, name, body in zip(*(batch.column(c) for c in ("path", "external_id", "body")), strict=True):
            path, name, body = path.as_py(), name.as_py(), body.as_py()
            for index, size, payload in read_blocks(body):
                if wanted is None or index in wanted:
                    yield (path, name, index, size, payload is None, payload), 100 + len(payload or b"")
                if wanted is not None and index >= max(wanted, default=-1):
                    break

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered((x for batch in batches for x in rows_of(batch)), schema)

    return bodies.select("path", "external_id", "body").mapInArrow(read, BLOCKS)


def gathered(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES from rows and their sizes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)  # noqa: B905
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)  # noqa: B905


def inspect_tiles(blocks: DataFrame, columns: int) -> DataFrame:
    """Counts, bytes and bounds of stored tiles, and a fingerprint over them; nothing is inflated."""
    stored = F.when(~F.col("is_empty"), F.col("block"))
    prints = F.array_sort(F.collect_list(F.when(~F.col("is_empty"), F.struct("block", F.sha2("payload", 256).alias("h")))))
    return blocks.groupBy("path", "external_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count(stored).alias("stored"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("stored_bytes"),
        F.min(stored % columns).alias("x0"), F.max(stored % columns).alias("x1"), F.min(F.floor(stored / columns)).alias("y0"), F.max(F.floor(stored / columns)).alias("y1"),
        F.sha2(F.array_join(F.transform(prints, lambda p: F.concat_ws(":", p["block"], p["h"])), ","), 256).alias("fingerprint"),
    )


def inflate(data: bytes | None, fill: int, size: int) -> bytes | None:
    """A tile's bytes: inflated, or the fill where nothing is stored; None if it is damaged or of another size."""
    if data is None:
        return bytes([fill]) * size
    try:
        out = zlib.decompress(data)
    except zlib.error:
        return None
    return out if len(out) == size else None


def inflate_tile(payload: Column, fill: Column, size: Column) -> Column:
    """inflate() of each row, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(payload: pd.Series, fill: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([inflate(*x) for x in zip(payload, fill, size, strict=True)])

    return run(payload, fill, size)


def decode_tile(raw: bytes, layout: str) -> np.ndarray:
    """A tile's pixels as (256, 256, 4), or (256, 256) for a mask.

    rgba: a plane of alpha, then blue, green, red and padding for each pixel;
    gray: alpha, then gray; mono: two planes of bits, the highest first; mask: alpha.
    """
    n = TILE * TILE
    data = np.frombuffer(raw, np.uint8)
    if layout == "mask":
        return data[:n].reshape(TILE, TILE)
    out = np.empty((n, 4), np.uint8)
    if layout == "rgba":
        out[:, 3], out[:, :3] = data[:n], data[n : 5 * n].reshape(n, 4)[:, 2::-1]
    elif layout == "gray":
        out[:, 3], out[:, :3] = data[:n], data[n : 2 * n, None]
    elif layout == "mono":
        bits = np.unpackbits(data[: n // 4]) * 255
        out[:, 3], out[:, :3] = bits[:n], bits[n : 2 * n, None]
    else:
        raise ValueError(f"no such layout: {layout}")
    return out.reshape(TILE, TILE, 4)


def tile_pixels(tiles: DataFrame, layout: str, columns: int) -> DataFrame:
    """Rows (external_id, x, y, r, g, b, a) of tiles(external_id, block, raw) for what isn't transparent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                px = decode_tile(row.raw, layout)
                y, x = np.nonzero(px[..., 3])
                rgba = px[y, x]
                yield pd.DataFrame({"external_id": row.external_id, "x": row.block % columns * TILE + x, "y": row.block // columns * TILE + y, **{c: rgba[:, k].astype(np.int32) for k, c in enumerate("rgba")}})

    return tiles.select("external_id", "block", "raw").mapInPandas(run, "external_id string, x bigint, y bigint, r int, g int, b int, a int")


def unpack_bits(data: bytes, expected: int) -> bytes:
    """PackBits; short data is filled up with zeros."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < expected:
        n = data[i] - 256 if data[i] > 127 else data[i]
        if n >= 0:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (1 - n) if n > -128 else b""
            i += 2 if n > -128 else 1
    return bytes(out[:expected]).ljust(expected, b"\0")


def fnv1a(fields: list[bytes | int | None]) -> int:
    """A 64-bit FNV-1a over tagged fields: strings end with 0xff, numbers are eight bytes, none is a zero tag."""
    h = 0xCBF29CE484222325
    for f in fields:
        raw = b"\0" if f is None else f + b"\xff" if isinstance(f, bytes) else struct.pack("<Q", f)
        for b in raw:
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def build_body(name: str, tiles: list[bytes | None | tuple[bytes, int]]) -> bytes:
    """A body of data blocks: bytes are deflated, None is empty, (payload, size) is stored as it is."""
    out, begin = [struct.pack(">Q", len(name)) + name.encode() + bytes(8)], BEGIN.encode("utf-16-be")
    for tile in tiles:
        payload, size = (None, TILE * TILE * 5) if tile is None else tile if isinstance(tile, tuple) else (zlib.compress(tile, 1), len(tile))
        inner = bytes(4) + struct.pack(">I", size) + bytes(8) + struct.pack(">I", payload is not None)
        if payload is not None:
            inner += struct.pack(">I", len(payload) + 4) + struct.pack("<I", len(payload)) + payload
        out.append(struct.pack(">2I", len(inner), len(BEGIN)) + begin + inner)
    return b"".join(out)


def build_container(bodies: list[bytes], database: bytes = b"db") -> bytes:
    chunk = lambda kind, body: kind + struct.pack(">Q", len(body)) + body
    return MAGIC + bytes(16) + chunk(DATABASE, database) + b"".join(chunk(EXTERNAL, b) for b in bodies)


