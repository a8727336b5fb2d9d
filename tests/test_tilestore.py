"""The container source: fixed bytes, faults, pushed filters, commits."""

import os

import pytest
from pyspark.sql.datasource import EqualTo, In

from mosaiq.sources import container, tilestore

#: A container of one database chunk and one chunk x7 with an empty tile of 9 bytes, written out by hand.
GOLDEN = bytes.fromhex(
    "4353464348554e4b" + "00" * 16 + "43484e4b53514c69" + "0000000000000002" + "6462" + "43484e4b45787461" + "0000000000000054" + "0000000000000002" + "7837" + "00" * 8 + "00000014" + "00000013"
    + "BlockDataBeginChunk".encode("utf-16-be").hex() + "00000000" + "00000009" + "00" * 8 + "00000000"
)


@pytest.fixture
def folder(tmp_path):
    good = container.build_container([container.build_body(f"x{k}", [b"a" * k, None, b"c" * 9]) for k in range(1, 5)])
    files = {"good": good, "golden": GOLDEN, "magic": b"x" + good[1:], "header": good + b"CHNK", "body": good[:-1], "empty": b"", "nodb": good[:24] + good[42:], "tile": good[:-3] + b"zzz"}
    for name, data in files.items():
        (tmp_path / f"{name}.clip").write_bytes(data)
    return str(tmp_path)


def read(folder, filters=(), **options):
    reader = tilestore.ContainerReader({"path": folder} | options)
    left = list(reader.pushFilters(list(filters)))
    return reader, left, [row for part in reader.partitions() for row in reader.read(part)]


@pytest.mark.parametrize("step", [str(1 << 26), "100", "37"])
def test_faults_are_rows(folder, step):
    _, _, rows = read(folder, rangebytes=step)
    base = lambda r: os.path.basename(r[0])[:-5]
    faults = sorted((base(r), r[7]) for r in rows if r[7])
    assert faults == [("body", "TruncatedBody"), ("empty", "InvalidMagic"), ("header", "TruncatedHeader"), ("magic", "InvalidMagic"), ("nodb", "MissingDatabase"), ("tile", "DamagedTile")]
    good = [r[2:7] for r in rows if base(r) == "good"]
    assert good == [(f"x{k}", n, size, data is None, data if data is not None else b"\xff" * size) for k in range(1, 5) for n, (size, data) in enumerate([(k, b"a" * k), (container.TILE**2 * 5, None), (9, b"c" * 9)])]
    assert [r[2:7] for r in rows if base(r) == "golden"] == [("x7", 0, 9, True, b"\xff" * 9)]
    with pytest.raises(container.ContainerError):
        read(folder, damaged="fail")


def test_pushed_filters(folder, monkeypatch):
    inflated = []
    real = container.inflate
    monkeypatch.setattr(container, "inflate", lambda *a: inflated.append(a) or real(*a))
    other = EqualTo(("pos",), 3)
    _, left, rows = read(folder, [In(("block",), (0, 2)), EqualTo(("external_id",), "x3"), other, EqualTo(("block",), 2)])
    assert left == [other] and {r[2:4] for r in rows if r[3] is not None} == {("x3", 2)}
    assert len(inflated) == sum(r[3] is not None for r in rows)
    assert [r for r in read(folder, [EqualTo(("block",), 1), EqualTo(("block",), 2)])[2] if r[3] is not None] == []


def test_through_spark(spark, folder, tmp_path):
    spark.dataSource.register(tilestore.ContainerSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("mosaiq_containers").load(folder)
    assert df.filter("error is not null").count() == 6
    some = df.filter("block = 2 and external_id in ('x1', 'x4') and error is null")
    assert {(r.external_id, bytes(r.raw)) for r in some.collect()} == {("x1", b"c" * 9), ("x4", b"c" * 9)}
    # a task that fails leaves nothing, and what was there stays
    out = str(tmp_path / "out")
    bodies = spark.createDataFrame([(f"x{k}", container.build_body(f"x{k}", [bytes([k]) * 5])) for k in range(20)], "external_id string, body binary").repartition(4)
    bodies.write.format("mosaiq_containers").mode("overwrite").save(out)
    before = sorted(os.listdir(out))
    assert "_SUCCESS" in before and sum(x.endswith(".clip") for x in before) == 4
    bad = bodies.selectExpr("external_id", "CASE WHEN external_id = 'x7' THEN CAST(raise_error('no') AS binary) ELSE body END AS body")
    with pytest.raises(Exception, match="no"):
        bad.write.format("mosaiq_containers").mode("overwrite").save(out)
    assert [x for x in sorted(os.listdir(out)) if x != "_temporary"] == before
    got = spark.read.format("mosaiq_containers").load(out).collect()
    assert sorted((r.external_id, bytes(r.raw)) for r in got) == sorted((f"x{k}", bytes([k]) * 5) for k in range(20))


def test_read_batches_are_bounded(tmp_path):
    """A task's rows leave it in batches of bounded size, however many empty tiles are filled; with fill = none they have no bytes."""
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "a.clip").write_bytes(container.build_container([container.build_body("x", [None] * 50 + [b"z" * 7])]))
    for options, largest in (({}, 2 * container.BATCH_BYTES), ({"fill": "none"}, 100_000)):
        reader = tilestore.BatchReader({"path": str(folder), **options})
        batches = [b for part in reader.partitions() for b in reader.read(part)]
        assert sum(b.num_rows for b in batches) == 51
        assert max(b.nbytes for b in batches) < largest
        raw = [x for b in batches for x in b.column("raw").to_pylist()]
        assert raw[50] == b"z" * 7
        assert raw[0] == (None if options else bytes([255]) * (container.TILE**2 * 5))
        assert {x for b in batches for x in b.column("error").to_pylist()} == {None}
