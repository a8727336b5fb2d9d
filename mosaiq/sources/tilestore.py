"""Containers as a Spark data source of their own (S1, S2, S5, K1, E34): reads with pushed filters, a table of faults, writes with commit.

    spark.dataSource.register(ContainerSource)
    spark.read.format("mosaiq_containers").load(folder).filter("block IN (1, 3)")
    bodies.write.format("mosaiq_containers").mode("overwrite").save(folder)

A file is read in ranges of bytes; a task walks the headers of its file by
seeking and reads the chunks that begin in its range. With
spark.sql.python.filterPushdown.enabled, filters on external_id and block are
applied there: other chunks' bodies aren't read, other tiles aren't inflated,
and a chunk isn't looked at after the last tile that is wanted.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from mosaiq.checkpoints import shared_folder
from mosaiq.registry import Tables, query
from mosaiq.sources import container
from mosaiq.sources.queries import _B, bodies

#: Bytes of a file that a task answers for.
RANGE_BYTES = 64 << 20
SCHEMA = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("external_id", pa.string()), ("block", pa.int32()), ("raw_bytes", pa.int64()), ("is_empty", pa.bool_()), ("raw", pa.binary()), ("error", pa.string())])
SUFFIX, TEMPORARY = ".clip", "_temporary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


class ContainerReader(DataSourceReader):
    """Tiles, one row each; with the option damaged = fail a fault ends the query, else it is a row with error set.

    With the option fill = none an empty tile's raw is null, else it is the fill.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.strict = options["path"], options.get("damaged") == "fail"
        self.filled = options.get("fill") != "none"
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("external_id", "block"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, root = opened(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(SUFFIX)]
        # the last range of a file is the one that sees its end, so an empty file has one as well
        return [Range(f.path, f.size, a, min(f.size, a + self.step)) for f in sorted(files, key=lambda f: f.path) for a in range(0, max(f.size, 1), self.step)]

    def read(self, part: Range) -> Iterator[tuple]:
        store, _ = opened(self.folder)
        at = 0
        try:
            with store.open_input_file(part.path) as f:
                for at, kind, size in headers(f, part):
                    if part.start <= at < part.end and kind == container.EXTERNAL:
                        try:
                            yield from self.tiles(f, part.path, at, size)
                        except container.ContainerError as e:
                            yield self.fault(part.path, at, e)
        except container.ContainerError as e:
            # each task walks the headers, and the one whose range it is tells of a fault among them
            place = getattr(e, "place", 0)
            if part.start <= place < part.end or part.end == part.size <= place:
                yield self.fault(part.path, place, e)

    def fault(self, path: str, at: int, e: container.ContainerError) -> tuple:
        if self.strict:
            raise e
        return (path, at, None, None, None, None, None, str(e).split()[0])

    def tiles(self, f, path: str, at: int, size: int) -> Iterator[tuple]:  # noqa: ANN001
        f.seek(at + 16)
        head = f.read(min(size, 8))
        named = head + f.read(min(size - len(head), int.from_bytes(head, "big")))
        name, blocks, ids = container.external_id(named), self.wanted.get("block"), self.wanted.get("external_id")
        if ids is not None and name not in ids or blocks is not None and not blocks:
            return
        for index, raw_bytes, payload in container.read_blocks(named + f.read(size - len(named))):
            if blocks is None or index in blocks:
                raw = container.inflate(payload, 255, raw_bytes) if self.filled or payload is not None else None
                yield (path, at, name, index, raw_bytes, payload is None, raw, "DamagedTile" if raw is None and payload is not None else None)
            if blocks is not None and index >= max(blocks):
                return


def headers(f, part: Range) -> Iterator[tuple[int, bytes, int]]:  # noqa: ANN001
    """(place, kind, size) of the chunks of a file up to the end of a range; only headers are read."""

    def fault(what: str, place: int) -> container.ContainerError:
        e = container.ContainerError(what)
        e.place = place
        return e

    if part.size < 24 or f.read(8) != container.MAGIC:
        raise fault("InvalidMagic", 0)
    at, database = 24, False
    while at < part.size and (at < part.end or part.end == part.size):
        f.seek(at)
        head = f.read(16)
        if len(head) < 16:
            raise fault("TruncatedHeader", at)
        kind, size = struct.unpack(">8sQ", head)
        if at + 16 + size > part.size:
            raise fault("TruncatedBody", at)
        database |= kind == container.DATABASE
        yield at, kind, size
        at += 16 + size
    if at >= part.size and not database:
        raise fault("MissingDatabase", part.size)


class BatchReader(ContainerReader):
    """The same rows in batches of about container.BATCH_BYTES; Spark would gather them by number, whatever their size."""

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return container.gathered(((row, 200 + len(row[6] or b"")) for row in super(BatchReader, self).read(part)), SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ContainerWriter(DataSourceWriter):
    """A container for each task; files move to their place when all tasks are done, and none is left when one fails."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.folder)
        task, out, path = TaskContext.get(), None, None
        for row in rows:
            if out is None:
                name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job[:8]}{SUFFIX}"
                path = f"{root}/{TEMPORARY}/{self.job}/{name}"
                store.create_dir(f"{root}/{TEMPORARY}/{self.job}")
                out = store.open_output_stream(path)
                out.write(container.build_container([]))
            out.write(container.EXTERNAL + struct.pack(">Q", len(row.body)) + row.body)
        if out is not None:
            out.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.folder)
        store.create_dir(root)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.path:
                store.move(m.path, f"{root}/{m.path.rsplit('/', 1)[1]}")
        store.open_output_stream(f"{root}/_SUCCESS").close()
        self.clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*opened(self.folder))

    def clear(self, store: fs.FileSystem, root: str) -> None:
        """Also what attempts left behind that were not the last of their task."""
        if store.get_file_info(f"{root}/{TEMPORARY}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{TEMPORARY}/{self.job}")
        top = f"{root}/{TEMPORARY}"
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mosaiq_containers"

    def schema(self) -> str:
        return "path string, pos bigint, external_id string, block int, raw_bytes bigint, is_empty boolean, raw binary, error string"

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        if schema.names != ["external_id", "body"]:
            raise ValueError("a container takes external_id and body")
        return ContainerWriter(self.options, overwrite)


def stored(t: Tables) -> DataFrame:
    """Tiles of containers that are made of the tables' orders, written by tasks and read from there."""
    spark = t.spark
    spark.dataSource.register(ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}"
    bodies(t).select("external_id", "body").write.format("mosaiq_containers").mode("overwrite").save(folder)
    return spark.read.format("mosaiq_containers").option("fill", "none").load(folder)


@query("s1_stored_containers", f"{_B} SELECT external_id, count(*) AS blocks, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS empty, CAST(min(o_orderkey) AS BIGINT) AS first_key FROM b GROUP BY external_id")
def s1(t: Tables) -> DataFrame:
    """Written with a commit, read back, and the first tile that is stored or else the fill gives the first key."""
    tiles = stored(t).filter("error is null")
    first = F.min_by(F.when(~F.col("is_empty"), F.conv(F.hex(F.substring("raw", 1, 8)), 16, 10).cast("bigint")), "block")
    seen = tiles.groupBy("external_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("is_empty").alias("empty"), first.alias("first_key"))
    keys = t["orders"].groupBy(F.concat(F.lit("extrnlid"), F.col("o_custkey")).alias("external_id")).agg(F.min("o_orderkey").alias("least"))
    return seen.join(keys, "external_id").select("external_id", "blocks", "empty", F.coalesce("first_key", "least").alias("first_key"))


@query("s5_pushed_tiles", f"{_B} SELECT external_id, CAST(block AS INTEGER) AS block, CASE WHEN o_orderkey % 3 = 0 THEN 'FF' ELSE repeat(lpad(to_hex(o_orderkey), 16, '0'), 4) END AS raw FROM b WHERE block IN (1, 3)")
def s5(t: Tables) -> DataFrame:
    """The filter is pushed into the source; other tiles aren't inflated."""
    tiles = stored(t).filter("block IN (1, 3) AND error IS NULL")
    return tiles.select("external_id", "block", F.when(F.col("is_empty"), "FF").otherwise(F.hex("raw")).alias("raw"))
