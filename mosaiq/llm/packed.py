"""Blocks of documents, and an exchange of packed fingerprints.

Operators that look at every byte or shingle of a corpus can't send a row for
each. Here a task reads a block (some megabytes of whole documents) and sends
its fingerprints as one array for each bucket of the fingerprint range. One
task sorts one bucket at a time, so memory is bounded by the size of a bucket,
and sends back an array of one byte for each fingerprint, in the order they
came, so positions are never sent at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from mosaiq.llm import workers

FLAGS = "block bigint, round int, bucket int, flags binary"
SENT = "round int, bucket int, block bigint, data binary"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 1_000_000
#: Fingerprints that a bucket should have.
BUCKET_ROWS = 800_000


def named(column: str) -> Column:
    """The column of this very name, whatever stands in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def pack_blocks(docs: DataFrame, carry: bool = False, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, kind: str = "") -> DataFrame:
    """Blocks of docs(doc_id, text): block, ids and known (packed, see ids_of), lens, data; null texts count as empty ones.

    doc_id is read as a whole number; what isn't one counts as null. With
    carry, rest is an array of structs of all columns of docs but text, by
    place (c0, c1 and so on, of their own types), and of whether text is null
    (none). A block's number is its task and its place there. A task that
    runs again must read the same rows in the same order, as from files.

    With run, what it makes (of kind) of the blocks without rest: it gets them
    one at a time in the worker that packs them, so a task needs no second one.
    carry must be the same whenever the same numbers are meant.
    """
    kept = [c for c in docs.columns if c != "text"]
    known = F.col("doc_id").try_cast("bigint").isNotNull()
    rest = F.struct(F.col("text").isNull().alias("none"), *(named(c).alias(f"c{k}") for k, c in enumerate(kept)))
    rows = docs.select(F.coalesce(F.col("doc_id").try_cast("bigint"), F.lit(0)).alias("doc_id"), known.alias("known"), F.coalesce("text", F.lit("")).alias("text"), *([rest.alias("rest")] if carry else []))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("blocks")
        task, k, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            text, ids, is_known = batch.column("text").cast(pa.large_binary()), batch.column("doc_id").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw, a = memoryview(text.buffers()[2] or b""), 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_BYTES, side="right")) - 1)
                lens = np.diff(ends[a : b + 1]).astype(np.int32)
                columns = [pa.array([(task << 32) + k], pa.int64()), pa.array([ids[a:b].tobytes()], pa.binary()), pa.array([is_known[a:b].tobytes()], pa.binary()), pa.array([lens], pa.list_(pa.int32())), pa.array([press.compress(raw[ends[a] : ends[b]])], pa.binary())]
                if carry and not run:
                    columns.append(one_list(batch.column("rest").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "known", "lens", "data", "rest"][: len(columns)])
                a, k = b, k + 1

    if run:
        return rows.mapInArrow(lambda batches: run(pack(batches)), kind)
    packed = StructType().add("block", "long").add("ids", "binary").add("known", "binary").add("lens", ArrayType(IntegerType())).add("data", "binary")
    return rows.mapInArrow(pack, packed.add("rest", ArrayType(rows.schema["rest"].dataType)) if carry else packed)


def unpack_rest(done: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of docs from done(text, rest), and then more columns of done; texts that were null are null again."""
    kept = [c for c in docs.columns if c != "text"]
    text = F.when(~F.col("rest.none"), F.col("text"))
    return done.select(*(text.alias("text") if c == "text" else F.col(f"rest.c{kept.index(c)}").alias(c) for c in docs.columns), *more)


def one_list(values: pa.Array) -> pa.Array:
    """An array of one list, which holds values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def ids_of(row: Mapping) -> pd.api.extensions.ExtensionArray:
    """The ids of a block's documents, null where they are unknown."""
    return pd.arrays.IntegerArray(np.frombuffer(row["ids"], np.int64).copy(), ~np.frombuffer(row["known"], bool))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(fingerprints: float) -> int:
    return max(1, int(fingerprints / BUCKET_ROWS) + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit numbers over all their bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def narrow(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def by_bucket(choice: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, ties as they come, and each bucket's end; choice is any 64-bit hash."""
    bucket = ((choice >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))


def send(block: int, round_: int, values: np.ndarray, choice: np.ndarray, buckets: int, width: int) -> list[tuple]:
    """Rows of SENT for a block's fingerprints."""
    order, ends = by_bucket(choice, buckets)
    values = values[order]
    return [(round_, b, block, narrow(values[a:e], width)) for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > a]  # noqa: B905


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SENT as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["round", "bucket", "block", "data"])


def received(flags: pd.DataFrame, round_: int, choice: np.ndarray, buckets: int) -> np.ndarray:
    """The flags that came back, in the order of the fingerprints."""
    out = np.zeros(len(choice), np.uint8)
    of = flags[flags["round"] == round_].sort_values("bucket")
    if len(of):
        out[by_bucket(choice, buckets)[0]] = np.frombuffer(b"".join(unpack(x) for x in of["flags"]), np.uint8)
    return out


def repeated_or_first(order: np.ndarray, new: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0: the only one of its value; 1: repeated; 2: the first of those repeated."""
    out = np.zeros(len(order), np.uint8)
    out[order] = np.repeat(counts > 1, counts)
    out[order[new]] *= 2
    return out


class Distinct:
    """The distinct values of a block's fingerprints, which are sent once each, and the flags of all of them."""

    def __init__(self, values: np.ndarray, choice: np.ndarray) -> None:
        self.values, self.at, self.of, self.times = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        self.choice = choice[self.at]

    def flags(self, flags: pd.DataFrame, round_: int, buckets: int) -> np.ndarray:
        """What repeated_or_first says of each fingerprint, counting those of other blocks and of this one."""
        found = received(flags, round_, self.choice, buckets)
        alone = (found == 0) & (self.times > 1)
        out = ((found > 0) | alone)[self.of].astype(np.uint8)
        out[self.at[(found == 2) | alone]] = 2
        return out


Verdict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def judged(rows: pd.DataFrame, width: int, verdict: Verdict) -> pd.DataFrame:
    """FLAGS for the rows of one bucket: it is sorted, and verdict gives a byte to each fingerprint.

    verdict gets the order that sorts the bucket (equal ones by block and
    place), whether each sorted one begins a new value, and how often each
    value occurs. width is the bytes of a fingerprint.
    """
    workers.enter("blocks")
    rows = rows.sort_values("block")
    values = widen(b"".join(rows["data"]), width)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    flags = verdict(order, new, np.diff(np.append(np.flatnonzero(new), len(new))))
    ends = np.cumsum([len(d) // width for d in rows["data"]])
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(flags[a:e].tobytes()) for a, e in zip([0, *ends[:-1]], ends)]  # noqa: B905
    return pd.DataFrame({"block": rows["block"].to_numpy(), "round": rows["round"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "flags": parts})


def judge(sent: DataFrame, width: int, verdict: Verdict) -> DataFrame:
    """FLAGS for SENT, one bucket at a time. A block sends a value once, so one that stands everywhere comes once for each block."""
    return sent.groupBy("round", "bucket").applyInPandas(lambda rows: judged(rows, width, verdict), FLAGS)


def send_owned(block: int, round_: int, values: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of SENT for hashes and their owners in the block; a value goes as six bytes, an owner as four planes of one."""
    order, ends = by_bucket(mix(values), buckets)
    values, owner = values[order], owner[order].astype("<u4").view(np.uint8).reshape(-1, 4)
    return [(round_, b, block, narrow(values[a:e], 6) + owner[a:e].T.tobytes()) for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > a]  # noqa: B905


def shared(rows: pd.DataFrame) -> pd.DataFrame:
    """FLAGS that hold, for each block, the owners of values with several owners, and for each such value a token and its hub.

    A value's hub is a number for the first block and owner that have it.
    """
    rows = rows.sort_values("block")
    blocks, bucket = rows["block"].to_numpy(), int(rows["bucket"].iloc[0])
    sizes = np.array([len(d) // 10 for d in rows["data"]])
    values = np.concatenate([widen(d[: 6 * n], 6) for d, n in zip(rows["data"], sizes.tolist())])  # noqa: B905
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    several = np.zeros(len(values), bool)
    counts = np.diff(np.append(np.flatnonzero(new), len(new)))
    several[order] = np.repeat(counts > 1, counts)
    owners = np.concatenate([np.ascontiguousarray(np.frombuffer(d[6 * n :], np.uint8).reshape(4, n).T).view("<u4").ravel() for d, n in zip(rows["data"], sizes.tolist())])  # noqa: B905
    own_hub, hubs = mix(mix(np.repeat(blocks, sizes).astype(np.uint64)) ^ owners.astype(np.uint64)), np.empty(len(values), np.uint64)
    hubs[order] = np.repeat(own_hub[order[new]], counts)
    tokens, out, press, at = mix(values ^ mix(np.full(1, bucket + 1, np.uint64))), [], zstandard.ZstdCompressor(level=1), 0
    for block, n in zip(blocks.tolist(), sizes.tolist()):  # noqa: B905
        use = several[at : at + n]
        if use.any():
            parts = (x[at : at + n][use].tobytes() for x in (owners, tokens, hubs))
            out.append((block, int(rows["round"].iloc[0]), bucket, press.compress(b"".join(parts))))
        at += n
    return pd.DataFrame(out, columns=["block", "round", "bucket", "flags"])


def received_owned(flags: pd.DataFrame, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, hub) of what shared found for a block."""
    found = [unpack(x) for x in flags["flags"][flags["round"] == round_]]
    parts = [(np.frombuffer(x[: len(x) // 5], "<u4").astype(np.int64), *np.frombuffer(x[len(x) // 5 :], np.uint64).reshape(2, -1)) for x in found]
    return tuple(map(np.concatenate, zip(*parts))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))  # noqa: B905
