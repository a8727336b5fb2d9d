"""Readers of records inside blobs, images and containers with errors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.checkpoints import spread
from mosaiq.model import LAYERS_SQL, RECTS_SQL
from mosaiq.registry import Tables, query
from mosaiq.sources import container
from mosaiq.sources.queries import bodies


def unsigned(blob: Column, at: int, size: int, little: bool = False) -> Column:
    """A number of size bytes at a place; null where the blob ends before."""
    part = F.substring(blob, at + 1, size)
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return F.when(F.octet_length(blob) >= at + size, F.conv(digits, 16, 10).cast("bigint"))


def signed(blob: Column, at: int, size: int, little: bool = False) -> Column:
    """The same in two's complement, up to seven bytes."""
    n = unsigned(blob, at, size, little)
    return F.when(n >= 1 << (8 * size - 1), n - (1 << 8 * size)).otherwise(n)


def as_bytes(value: str, size: int) -> str:
    """SQL for a number as size bytes, the highest first, in hex."""
    return f"right(lpad(hex({value}), 16, '0'), {2 * size})"


@query(
    "x1_integers",
    "SELECT o_orderkey, o_orderkey % 65536 AS be16, (o_orderkey % 256) * 256 + (o_orderkey // 256) % 256 AS le16, o_orderkey - o_custkey * 1000 AS s32, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 256 END AS last FROM orders",
)
def x1(t: Tables) -> DataFrame:
    """Integers of both byte orders from a blob; what lies beyond its end is null."""
    blob = F.expr(f"unhex(concat({as_bytes('o_orderkey % 65536', 2)}, {as_bytes('o_orderkey - o_custkey * 1000', 4)}, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {as_bytes('o_custkey % 256', 1)} END))")
    b = t["orders"].select("o_orderkey", blob.alias("b"))
    c = F.col("b")
    return b.select("o_orderkey", unsigned(c, 0, 2).alias("be16"), unsigned(c, 0, 2, little=True).alias("le16"), signed(c, 2, 4).alias("s32"), unsigned(c, 6, 1).alias("last"))


@query(
    "s13_filter_source",
    "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN 1 + p_partkey % 9 END AS kind, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS BIGINT) - 25 END AS first, CASE WHEN p_partkey % 10 <> 0 THEN 10 - p_partkey % 21 END AS second, p_partkey % 10 = 0 AS malformed FROM part",
)
def s13(t: Tables) -> DataFrame:
    """A filter's payload behind a header of its kind and size; one whose payload is shorter than its header says is malformed."""
    blob = F.expr(f"unhex(concat({as_bytes('1 + p_partkey % 9', 4)}, '00000008', {as_bytes('CAST(p_size AS BIGINT) - 25', 4)}, CASE WHEN p_partkey % 10 = 0 THEN '00' ELSE {as_bytes('10 - p_partkey % 21', 4)} END))")
    b = t["part"].select("p_partkey", blob.alias("b"))
    c = F.col("b")
    whole = F.octet_length(c) >= 8 + unsigned(c, 4, 4)
    return b.select("p_partkey", F.when(whole, unsigned(c, 0, 4)).alias("kind"), F.when(whole, signed(c, 8, 4)).alias("first"), F.when(whole, signed(c, 12, 4)).alias("second"), (~whole).alias("malformed"))


def split_records(blob: Column) -> Column:
    """Array of (id, value) of a blob of records, each a number, a length (both four bytes, the lowest first) and so many bytes; null if one is cut off."""

    @F.pandas_udf("array<struct<id:bigint,value:binary>>")
    def run(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            found, at = [], 0
            while found is not None and b is not None and len(b) - at >= 8:
                id_, size = struct.unpack_from("<2I", b, at)
                value, at = b[at + 8 : at + 8 + size], at + 8 + size
                found = [*found, (id_, value)] if len(value) == size else None
            out.append(found)
        return pd.Series(out)

    return run(blob)


#: Fixed value: the record that holds the alignment of each stretch of text.
ALIGNMENT = 12


@query(
    "s14_text_source",
    """SELECT o_custkey AS layer_id, CAST(count(*) AS BIGINT) AS stretches, arg_max(align, total * 10 - align) AS align FROM (SELECT o_custkey, o_orderkey % 3 AS align, sum(1 + o_orderkey % 7) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS total FROM orders) GROUP BY o_custkey""",
)
def s14(t: Tables) -> DataFrame:
    """The alignment record of a text layer: stretches of 14 bytes with a length and an alignment; the one that most letters have counts."""
    entry = f"concat('00000000', {as_bytes('(1 + o_orderkey % 7) * 16777216', 4)}, '00000000', {as_bytes('o_orderkey % 3', 1)}, '00')"
    le = lambda n: f"concat({as_bytes(f'({n}) % 256', 1)}, {as_bytes(f'({n}) div 256', 1)}, '0000')"
    texts = t["orders"].select("o_custkey", "o_orderkey", F.expr(entry).alias("e")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "e"))), lambda x: x["e"]), "").alias("all"), F.count(F.lit(1)).alias("n"))
    blob = F.expr(f"unhex(concat('1E000000', '02000000', 'ABCD', '0C000000', {le('4 + 14 * n')}, {le('n')}, all))")
    of = F.get(F.filter(F.col("records"), lambda r: r["id"] == ALIGNMENT), 0)["value"]
    value = texts.select("o_custkey", split_records(blob).alias("records")).select("o_custkey", of.alias("v"))
    n = unsigned(F.col("v"), 0, 4, little=True).cast("int")
    one = lambda k, at, size: F.conv(F.hex(F.expr(f"substring(v, 4 + 14 * k + {at} + 1, {size})")), 16, 10).cast("bigint")
    spread = value.select("o_custkey", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), "v").select("o_custkey", one("k", 4, 1).alias("length"), one("k", 12, 1).alias("align"))
    totals = spread.groupBy("o_custkey", "align").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n"))
    return totals.groupBy(F.col("o_custkey").alias("layer_id")).agg(F.sum("n").alias("stretches"), F.max_by("align", F.struct("total", -F.col("align"))).alias("align"))


@query(
    "x5_records",
    "SELECT p_partkey, k.id, CASE k.id WHEN 11 THEN p_name ELSE p_brand END AS value FROM part, (VALUES (11::BIGINT), (29::BIGINT)) k(id) WHERE p_partkey % 6 <> 0",
)
def x5(t: Tables) -> DataFrame:
    """Records of several ids; a blob that is cut off gives none."""
    record = lambda id_, c: f"{id_:02X}000000', {as_bytes(f'octet_length({c})', 1)}, '000000', hex({c})"
    blob = F.expr(f"unhex(concat('{record(11, 'p_name')}, '{record(29, 'p_brand')}, CASE WHEN p_partkey % 6 = 0 THEN '0100000005000000AA' ELSE '' END))")
    return t["part"].select("p_partkey", F.inline(split_records(blob))).select("p_partkey", "id", F.col("value").cast("string").alias("value"))


def unpacked_bits(data: Column, size: Column) -> Column:
    """PackBits of each row, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([container.unpack_bits(d, int(n)) for d, n in zip(data, size, strict=True)])

    return run(data, size)


@query("x14_packbits", "SELECT p_partkey, repeat(lpad(to_hex(p_partkey % 256), 2, '0'), p_size + 1) || 'ABCDEF' || repeat('00', p_partkey % 3) AS raw FROM part")
def x14(t: Tables) -> DataFrame:
    """A run, then three bytes as they are; what is missing is filled up with zeros."""
    data = F.expr(f"unhex(concat({as_bytes('256 - p_size', 1)}, {as_bytes('p_partkey % 256', 1)}, '02ABCDEF'))")
    return t["part"].select("p_partkey", F.hex(unpacked_bits(data, F.expr("p_size + 4 + p_partkey % 3"))).alias("raw"))


@query(
    "x15_fnv1a",
    """SELECT c_custkey, CAST(list_reduce([14695981039346656037::HUGEINT] || list_transform(range(0, 8), lambda k: ((c_custkey >> CAST(8 * k AS INTEGER)) & 255)::HUGEINT) || list_transform(string_split(c_mktsegment, ''), lambda c: ascii(c)::HUGEINT) || [255::HUGEINT] || CASE WHEN c_custkey % 2 = 0 THEN [0::HUGEINT] ELSE [] END,
lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR) AS signature FROM customer""",
)
def x15(t: Tables) -> DataFrame:
    """A signature over a number, a string and, for some, a missing value."""

    @F.pandas_udf("string")
    def run(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([str(container.fnv1a([k, n.encode(), *([None] if k % 2 == 0 else [])])) for k, n in zip(key.tolist(), name, strict=True)])

    return t["customer"].select("c_custkey", run("c_custkey", "c_mktsegment").alias("signature"))


#: What is wrong with a container, by customer.
FAULTS = ["none", "InvalidMagic", "TruncatedHeader", "TruncatedBody", "MissingDatabase"]


@query("s2_container_errors", "SELECT c_custkey, CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FAULTS)) + " END AS error, CASE WHEN c_custkey % 5 = 0 THEN CAST(2 + c_nationkey % 3 AS BIGINT) ELSE 0 END AS chunks FROM customer")
def s2(t: Tables) -> DataFrame:
    """Containers with their first error; a damaged one doesn't stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, nation in zip(batch["c_custkey"].tolist(), batch["c_nationkey"].tolist(), strict=True):
                whole = container.build_container([container.build_body(f"x{k}", [b"abc"]) for k in range(1 + nation % 3)])
                without = whole[:24] + whole[24 + 16 + 2 :]
                data = [whole, b"x" + whole[1:], whole + b"CHNK", whole[:-1], without][key % 5]
                try:
                    out.append((key, "none", len(container.read_chunks(data))))
                except container.ContainerError as e:
                    out.append((key, str(e).split()[0], 0))
            yield pd.DataFrame(out, columns=["c_custkey", "error", "chunks"])

    return t["customer"].select("c_custkey", "c_nationkey").mapInPandas(run, "c_custkey bigint, error string, chunks bigint")


@query("s6_parallel_inflate", "WITH b AS (SELECT 'extrnlid' || o_custkey AS external_id, o_orderkey FROM orders) SELECT external_id, count(*) AS blocks, CAST(32 * count(*) FILTER (o_orderkey % 3 <> 0) AS BIGINT) AS inflated FROM b GROUP BY external_id")
def s6(t: Tables) -> DataFrame:
    """Blocks are inflated wherever they are, and counted."""
    raw = container.scan_blocks(bodies(t)).select("external_id", F.octet_length(container.inflate_tile(F.col("payload"), F.lit(0), F.lit(32))).alias("n"), "is_empty")
    return raw.groupBy("external_id").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.when(~F.col("is_empty"), F.col("n"))), F.lit(0)).cast("bigint").alias("inflated"))


@query("o8_order_restored", "SELECT 'extrnlid' || o_custkey AS external_id, string_agg(CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def o8(t: Tables) -> DataFrame:
    """Blocks inflated in any order come back in that of their numbers."""
    raw = container.scan_blocks(bodies(t)).select("external_id", "block", container.inflate_tile(F.col("payload"), F.lit(0), F.lit(32)).alias("raw"), "is_empty")
    key = F.when(F.col("is_empty"), "-").otherwise(unsigned(F.col("raw"), 0, 8).cast("string"))
    rows = raw.repartition("external_id", "block").groupBy("external_id").agg(F.array_sort(F.collect_list(F.struct("block", key.alias("k")))).alias("all"))
    return rows.select("external_id", F.array_join(F.transform("all", lambda x: x["k"]), ",").alias("keys"))


PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def read_png(data: bytes) -> np.ndarray:
    """The pixels (height, width, 4) of a PNG of eight bits a channel, gray or colour, with or without alpha, not interlaced."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        head = struct.unpack(">2I5B", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("unsupported PNG")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    above, out = np.zeros((width, channels), np.int64), np.empty((height, width, channels), np.uint8)
    for y, (how, row) in enumerate(zip(rows[:, 0].tolist(), rows[:, 1:].reshape(height, width, channels).astype(np.int64), strict=True)):
        now = np.zeros((width, channels), np.int64)
        if how in (0, 2):
            now = row + above * (how == 2)
        elif how == 1:
            now = np.cumsum(row, axis=0)
        else:
            left = corner = np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
                left, corner = (row[x] + ((left + up) // 2 if how == 3 else paeth)) % 256, up
                now[x] = left
        above = now % 256
        out[y] = above
    alpha = out[..., -1:] if channels in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    colors = out[..., :3] if channels > 2 else np.repeat(out[..., :1], 3, axis=2)
    return np.concatenate([colors, alpha], axis=2)


def write_png(pixels: np.ndarray, filters: list[int]) -> bytes:
    """A PNG of pixels (height, width, 4) whose rows are filtered as told: 0 not, 1 by the left, 2 by the upper pixel."""
    rows = []
    for y, how in enumerate(filters):
        row = pixels[y].astype(np.int64)
        before = np.vstack([np.zeros((1, 4), np.int64), row[:-1]]) if how == 1 else pixels[y - 1] if how == 2 and y else np.zeros_like(row)
        rows.append(bytes([how]) + ((row - (before if how else 0)) % 256).astype(np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">2I5B", pixels.shape[1], pixels.shape[0], 8, 6, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@query("s17_png_pixels", "SELECT c_custkey, x.x AS x, y.y AS y, (c_custkey + 7 * x.x + 31 * y.y) % 256 AS r, (c_custkey * 3 + x.x) % 256 AS g, (x.x * y.y) % 256 AS b, 255 - x.x AS a FROM customer, range(4) x(x), range(3) y(y)")
def s17(t: Tables) -> DataFrame:
    """An image for each customer, written and read again, as rows of pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:3, :4]
        for batch in batches:
            out = []
            for key in batch["c_custkey"].tolist():
                made = np.stack([(key + 7 * x + 31 * y) % 256, (key * 3 + x) % 256, x * y % 256, 255 - x], -1)
                out.append(read_png(write_png(made, [key % 3, 1, 2])).reshape(-1, 4))
            px, n = np.concatenate([np.zeros((0, 4), np.uint8), *out]).astype(np.int64), len(out)
            yield pd.DataFrame({"c_custkey": np.repeat(batch["c_custkey"].to_numpy(), x.size), "x": np.tile(x.ravel(), n), "y": np.tile(y.ravel(), n), **{c: px[:, k] for k, c in enumerate("rgba")}})

    return spread(t["customer"].select("c_custkey"), "c_custkey").mapInPandas(run, "c_custkey bigint, x bigint, y bigint, r bigint, g bigint, b bigint, a bigint")


@query("s19_layer_dump", f"WITH {LAYERS_SQL} SELECT layer_id, type_code, visibility, opacity, composite, next_id, first_child FROM layers ORDER BY layer_id")
def s19(t: Tables) -> DataFrame:
    """The layer table in order of id."""
    return t.model.layers.select("layer_id", "type_code", "visibility", "opacity", "composite", "next_id", "first_child").orderBy("layer_id")


@query("k1_metadata_sink", f"""WITH {RECTS_SQL} SELECT rect_id, '{{"h":' || h || ',"rect_id":' || rect_id || ',"w":' || w || ',"x":' || x || ',"y":' || y || '}}' AS metadata, w * h * 4 AS bytes FROM rects""")
def k1(t: Tables) -> DataFrame:
    """K1: what stands beside an image's bytes, as JSON with its keys in order."""
    return t.model.rects.select("rect_id", F.to_json(F.struct("h", "rect_id", "w", "x", "y")).alias("metadata"), F.expr("w * h * 4").alias("bytes"))


_LENGTH = "CASE rect_id % 3 WHEN 0 THEN w * h * 4 WHEN 1 THEN (w * h + 10) * 4 ELSE 0 END"
_MODE = "CASE rect_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'patch' ELSE 'no_change' END"


@query("k3_result_lengths", f"WITH {RECTS_SQL}, r AS (SELECT rect_id, {_MODE} AS mode, {_LENGTH} AS wanted, {_LENGTH} + CASE WHEN rect_id % 7 = 0 THEN 4 ELSE 0 END AS bytes FROM rects) SELECT mode, count(*) AS results, count(*) FILTER (bytes <> wanted) AS wrong FROM r GROUP BY mode")
def k3(t: Tables) -> DataFrame:
    """K3: results whose bytes aren't as many as their mode says: an image, its patches, or none."""
    r = t.model.rects.select(F.expr(_MODE).alias("mode"), "w", "h", F.expr(f"{_LENGTH} + CASE WHEN rect_id % 7 = 0 THEN 4 ELSE 0 END").alias("bytes"))
    patches = F.array(F.struct(F.col("w").alias("w"), F.col("h").alias("h")), F.struct(F.lit(5).cast("bigint").alias("w"), F.lit(2).cast("bigint").alias("h")))
    wanted = F.when(F.col("mode") == "full", F.expr("w * h * 4")).when(F.col("mode") == "patch", F.aggregate(patches, F.lit(0).cast("bigint"), lambda n, p: n + p["w"] * p["h"] * 4)).otherwise(0)
    return r.groupBy("mode").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("bytes") != wanted).alias("wrong"))
