"""Whitening of embeddings by a compensated covariance.

Sums and centred outer products are kept in double-double, a pair of a high
and a low part. A block of centred values is split, without error, into slices
of so few bits that the product of two of them is exact; slices are added to
the pair by error-free sums. Tasks send their pairs, which are merged part by
part, and the covariance is solved by reduction to a tridiagonal matrix and
divide and conquer (LAPACK's syevd, which numpy's eigh calls).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import workers

#: Rows of a block, bits of a slice and slices of a value: products of 2 * BITS - 2 bits are summed over 2 ** 10 rows within 53.
ROWS, BITS, SLICES = 1024, 22, 5
#: Tasks' parts are merged in so many groups before they meet.
FAN = 64
#: Entries are scaled, rounded down and moved up; what lies beyond 62 bits is the largest such number.
SCALE, OFFSET, LARGEST = 1024, 100_000, 1 << 62

Pair = tuple[np.ndarray, np.ndarray]
Blocks = Callable[[np.ndarray], Iterator[np.ndarray]]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as a rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    low, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + low)
    return two_sum(s, e + f)


def pair_of(values: list[Fraction]) -> Pair:
    high = np.array([float(v) for v in values])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(values, high.tolist())])  # noqa: B905


def exact(pair: Pair) -> list[Fraction]:
    return [Fraction(h) + Fraction(x) for h, x in zip(pair[0].ravel().tolist(), pair[1].ravel().tolist())]  # noqa: B905


def slices(value: Pair) -> list[np.ndarray]:
    """Matrices that add up to value but for what lies SLICES * BITS bits below a column's largest entry; a slice has BITS bits."""
    s, e = value
    unit = np.exp2(np.ceil(np.log2(np.maximum(np.abs(s).max(axis=0), 1e-280)))) * 2.0 ** (53 - BITS)
    out = []
    for _ in range(SLICES):
        q = (s + unit) - unit
        out.append(q)
        s, e = two_sum(s - q, e)
        unit = unit * 2.0**-BITS
    return out


def column_sums(value: Pair) -> Iterator[np.ndarray]:
    for q in slices(value):
        yield q.sum(axis=0, keepdims=True)


def outer_products(value: Pair) -> Iterator[np.ndarray]:
    """Matrices, each exact, that add up to the sum of the rows' outer products."""
    parts = slices(value)
    for k, a in enumerate(parts):
        for b in parts[: SLICES - k]:
            yield a.T @ b


def as_pair(x: np.ndarray) -> Pair:
    """Integers as double-doubles."""
    high = x.astype(np.float64)
    return high, (x - high.astype(np.int64)).astype(np.float64)


def centred(value: Pair, mean: Pair) -> Pair:
    return add(value, (-mean[0], -mean[1]))


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The integers that stand for a batch's vectors."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return (np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def totals(rows: DataFrame, size: int, blocks: Blocks) -> Pair:
    """The sum in double-double of what blocks gives for all blocks of rows(vector)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("whitening")
        total = None
        for batch in batches:
            x = matrix(batch, size)
            for k in range(0, len(x), ROWS):
                for part in blocks(x[k : k + ROWS]):
                    total = add(total, (part, np.zeros_like(part))) if total else (part, np.zeros_like(part))
        if total:
            n = len(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(list(x), pa.list_(pa.float64())) for x in total)], ["task", "place", "high", "low"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("task")
        total = None
        for h, low in zip(parts["high"], parts["low"]):  # noqa: B905
            total = add(total, (h, low)) if total else (h, low)
        return pd.DataFrame({"task": parts["task"].iloc[:1], "place": parts["place"].iloc[:1], "high": [total[0]], "low": [total[1]]})

    kind = "task int, place int, high array<double>, low array<double>"
    merged = rows.mapInArrow(scan, kind).groupBy("place", F.pmod("task", F.lit(FAN))).applyInPandas(merge, kind).groupBy("place").applyInPandas(merge, kind)
    found = sorted(merged.select("place", "high", "low").collect(), key=lambda r: r.place)
    return np.array([r.high for r in found]), np.array([r.low for r in found])


class Whitener:
    """Mean, components and scales of a set of vectors of one length, n of them."""

    def __init__(self, rows: DataFrame, size: int, most: int) -> None:
        ones = lambda x: np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
        found = exact(totals(rows, size, lambda x: column_sums(as_pair(ones(x)))))
        self.size, self.sums, self.n = size, [int(v) for v in found[:-1]], int(found[-1])
        mean = self.mean = pair_of([Fraction(s, self.n) for s in self.sums])
        high, low = totals(rows, size, lambda x: outer_products(centred(as_pair(x), mean)))
        cover = (high + low) / self.n
        values, vectors = np.linalg.eigh((cover + cover.T) / 2)
        order = [k for k in np.argsort(-values, kind="stable").tolist() if values[k] > size * 2.0**-50 * values[-1]][:most]
        self.values, self.vectors, trace = values[order], vectors[:, order], float(np.trace(cover))
        self.explained = self.values / trace if len(order) else self.values
        self.error = None
        if len(order):
            middle = pair_of([v / self.n for v in exact(totals(rows, size, lambda x: column_sums(self.pair(x))))])
            own = np.array([float(v / self.n) for v in exact(totals(rows, size, lambda x: outer_products(centred(self.pair(x), middle))))])
            self.error = float(np.abs(own.reshape(len(order), -1) - np.eye(len(order))).max())

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return sum(centred(as_pair(x), self.mean)) @ self.vectors / np.sqrt(self.values)

    def pair(self, x: np.ndarray) -> Pair:
        w = self.whiten(x)
        return w, np.zeros_like(w)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sum)^2 of each row, exact; None beyond 63 bits."""
        top = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        if top < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if self.size * max(abs(int(d.max())), abs(int(d.min()))) ** 2 < 1 << 63:
                return (d * d).sum(axis=1).tolist()
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]  # noqa: B905
        return [v if v < 1 << 63 else None for v in found]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is there, not empty, and has finite entries only."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return embeddings.select("vec_id", vector.alias("vector")).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def whiten(embeddings: DataFrame, most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of embeddings(vec_id, embedding), by row and component up to most.

    An entry c stands for floor(1024 c) + 100000. Rows whose vector is null or
    empty, or holds null or non-finite entries, are dropped; so are those of
    another length than most rows have (of lengths equally frequent the
    largest counts). n is the number of the others, deviation the exact sum of
    (n x - S)^2 over the dimensions, null where a long can't hold it, and
    identity_error the largest entry by which the whitened values' covariance
    differs from the identity. Components come by falling eigenvalue;
    those of no variance (2^-50 of the largest, for each dimension) are left
    out, so one vector alone, or equal ones, have none. vec_id is of any type;
    repeated rows each count and get theirs; other columns are left out.
    """
    kind = usable(embeddings.limit(0)).select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    rows = usable(embeddings)
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], kind)
    size = lengths[0]["size"]
    rows = rows.filter(F.size("vector") == size)
    space = Whitener(rows.select("vector"), size, most)
    k = len(space.values)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("whitening")
        for batch in batches:
            if k and batch.num_rows:
                x = matrix(batch, size)
                n = len(x)
                deviation = pa.array(space.deviations(x), pa.int64())
                take = pa.array(np.repeat(np.arange(n), k))
                columns = [batch.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, space.n)), deviation.take(take), pa.array(space.whiten(x).ravel()), pa.array(np.tile(space.explained, n)), pa.array(np.full(n * k, space.error))]
                yield pa.RecordBatch.from_arrays(columns, kind.names)

    return rows.mapInArrow(scores, kind)
