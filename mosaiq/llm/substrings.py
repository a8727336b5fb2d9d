"""Repeated substrings by difference-cover samples and blockwise sorting of suffixes.

Two suffixes that share their first 400 bytes share, at some distance below
the cover's period, sampled suffixes that agree as far. So:

1. every sampled suffix (12 of 133) is ranked by its first bytes, 150 of them; a
   suffix with no repeated sample in its first 133 bytes can't be repeated, and
   a string of 282 bytes that stands anywhere else has one;
2. repeated samples are ranked by their first 532 bytes; a tie there settles
   the 133 suffixes that begin in the sample's period, whose order the cover
   ranks give without comparing them again. One sample of each class stays to
   stand for its text;
3. the suffixes that are still open, near the ends of repeats, and those of
   the standing samples are sorted by their first 400 bytes, bucket by bucket.

Ranks and order are by fingerprints of those bytes (a polynomial modulo 2**64,
and another that picks the bucket), since only equality matters here.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from mosaiq.llm import packed, workers

# A perfect difference set; each distance modulo 133 but 0 occurs once.
COVER, PERIOD = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 133
#: For fingerprints that only nominate, six bytes; for those that decide, eight.
NOMINATE, DECIDE = 6, 8


@cache
def letters(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = workers.remembered({})
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i up to n, modulo 2**64; kept by the worker."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, packed.BLOCK_BYTES + 1)
        grown = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            grown.append(np.multiply.accumulate(row))
        _powers[base] = (grown[0], grown[1])
    return _powers[base]


class Text:
    """The bytes of a block, and fingerprints of windows of them."""

    def __init__(self, row: pd.Series) -> None:
        self.block = int(row["block"])
        self.ids, self.lens = packed.ids_of(row), np.asarray(row["lens"], np.int64)
        self.raw = np.frombuffer(packed.unpack(row["data"]), np.uint8)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.sums: dict[int, np.ndarray] = {}

    def windows(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        up, down = powers(BASES[which], len(self.raw))
        if which not in self.sums:
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters(which)[self.raw] * up[: len(self.raw)], dtype=np.uint64)])
        c = self.sums[which]
        return packed.mix((c[at + size] - c[at]) * down[at])

    def samples(self, size: int) -> np.ndarray:
        """Places of the cover's samples that have size bytes left in their document."""
        out = [s + (np.arange(0, n - size + 1, PERIOD)[:, None] + np.array(COVER)).ravel() for s, n in zip(self.starts.tolist(), self.lens.tolist()) if n >= size]  # noqa: B905
        ends = [np.full(len(x), e) for x, e in zip(out, self.ends[self.lens >= size].tolist())]  # noqa: B905
        if not out:
            return np.zeros(0, np.int64)
        at = np.concatenate(out)
        return at[at + size <= np.concatenate(ends)]

    def marked(self, first: np.ndarray, size: int) -> np.ndarray:
        """A mask of the bytes from each place on, size of them."""
        edge = np.zeros(len(self.raw) + size + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size, -1)
        return np.cumsum(edge[: len(self.raw)]) > 0


class Search:
    """What a block sends in each round, and finds from what came back."""

    def __init__(self, length: int, short: int, total: int) -> None:
        if not 0 < short <= length - PERIOD + 1:
            raise ValueError(f"short must be between 1 and length - {PERIOD - 1}")
        self.length, self.short, self.long = length, short, length + PERIOD - 1
        share = len(COVER) / PERIOD
        self.buckets = (packed.bucket_count(total * share), packed.bucket_count(total * share / 2), packed.bucket_count(total / 4))

    def _sample(self, t: Text) -> tuple[np.ndarray, packed.Distinct]:
        at = t.samples(self.short)
        return at, packed.Distinct(t.windows(at, self.short, 0), t.windows(at, self.short, 1))

    def repeated(self, t: Text, flags: pd.DataFrame) -> np.ndarray:
        """Places of the samples whose first short bytes begin anywhere else too."""
        at, sent = self._sample(t)
        return at[sent.flags(flags, 0, self.buckets[0]) > 0]

    def _long(self, t: Text, repeated: np.ndarray) -> tuple[np.ndarray, packed.Distinct]:
        ends = t.ends[np.searchsorted(t.ends, repeated, side="right")] if len(repeated) else repeated
        at = repeated[repeated + self.long <= ends]
        return at, packed.Distinct(t.windows(at, self.long, 0), t.windows(at, self.long, 1))

    def _open(self, t: Text, repeated: np.ndarray, flags: pd.DataFrame) -> tuple[np.ndarray, packed.Distinct, np.ndarray]:
        """Places whose suffixes are sorted, their fingerprints, and a mask of the places settled before."""
        at, sent = self._long(t, repeated)
        ties = sent.flags(flags, 1, self.buckets[1])
        settled = t.marked(at[ties > 0], PERIOD)
        standing = t.marked(at[ties > 1], PERIOD)
        near = np.zeros(len(t.raw) + 1, np.int32)
        np.add.at(near, np.maximum(repeated - PERIOD + 1, 0), 1)
        np.add.at(near, repeated + 1, -1)
        candidate = np.cumsum(near[:-1]) > 0
        for e, n in zip(t.ends.tolist(), t.lens.tolist()):  # noqa: B905
            candidate[max(e - n, e - self.length + 1) : e] = False
        places = np.flatnonzero((candidate & ~settled) | standing)
        return places, packed.Distinct(t.windows(places, self.length, 0), t.windows(places, self.length, 1)), settled

    def _send(self, t: Text, round_: int, sent: packed.Distinct, width: int) -> list[tuple]:
        return packed.send(t.block, round_, sent.values, sent.choice, self.buckets[round_], width)

    def first(self, t: Text) -> list[tuple]:
        return self._send(t, 0, self._sample(t)[1], NOMINATE)

    def second(self, t: Text, flags: pd.DataFrame) -> list[tuple]:
        return self._send(t, 1, self._long(t, self.repeated(t, flags))[1], DECIDE)

    def third(self, t: Text, flags: pd.DataFrame) -> list[tuple]:
        return self._send(t, 2, self._open(t, self.repeated(t, flags), flags)[1], DECIDE)

    def repeats(self, t: Text, repeated: np.ndarray, flags: pd.DataFrame) -> np.ndarray:
        """A mask of the bytes that repeated strings cover."""
        places, sent, settled = self._open(t, repeated, flags)
        starts = settled
        starts[places[sent.flags(flags, 2, self.buckets[2]) > 0]] = True
        return t.marked(np.flatnonzero(starts), self.length)


def remove_repeats(docs: DataFrame, length: int = 400, short: int = 150, texts: bool = False) -> DataFrame:
    """Removes every byte that a string of length bytes covers which starts anywhere else too.

    Texts are UTF-8 bytes, null ones empty; matches never cross documents, may
    overlap, and are judged on the input. (doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, n_short), one row per row of docs(doc_id, text), and with
    texts also kept: what remains, as binary, since it needn't be UTF-8.
    n_short counts the sampled strings of short bytes that stand anywhere else
    too; it tells of passages that are too short to be removed. Documents
    shorter than length stay whole. Repeated rows are repeats of each other.
    doc_id is read as a whole number, what isn't one as null.
    """
    blocks = packed.pack_blocks(docs)
    search = Search(length, short, packed.text_bytes(docs))

    def first(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for _, row in batch.iterrows():
                yield pd.DataFrame(search.first(Text(row)), columns=["round", "bucket", "block", "data"])

    def later(step):  # noqa: ANN001, ANN202
        def run(left: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
            rows = [x for _, row in left.iterrows() for x in step(Text(row), flags)]
            return pd.DataFrame(rows, columns=["round", "bucket", "block", "data"])

        return run

    def finish(left: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in left.iterrows():
            t = Text(row)
            repeated = search.repeated(t, flags)
            gone = search.repeats(t, repeated, flags)
            short = np.diff(np.searchsorted(repeated, np.append(t.starts, len(t.raw)))).tolist()
            for i, s, e, r in zip(t.ids, t.starts.tolist(), t.ends.tolist(), short):  # noqa: B905
                m = gone[s:e]
                kept = t.raw[s:e][~m].tobytes()
                spans = int(np.count_nonzero(m[1:] & ~m[:-1]) + bool(len(m) and m[0]))
                rows.append((i, e - s, int(m.sum()), spans, hashlib.sha256(kept).hexdigest(), r, *([kept] if texts else [])))
        frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_short", *(["kept"] if texts else [])])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def with_flags(flags: DataFrame, step, schema: str) -> DataFrame:  # noqa: ANN001
        return blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(step, schema)

    ranks = packed.judge(blocks.mapInPandas(first, packed.SENT), NOMINATE, packed.repeated_or_first)
    ties = packed.judge(with_flags(ranks, later(search.second), packed.SENT), DECIDE, packed.repeated_or_first)
    known = ranks.unionByName(ties)
    sorted_ = packed.judge(with_flags(known, later(search.third), packed.SENT), DECIDE, packed.repeated_or_first)
    return with_flags(known.unionByName(sorted_), finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_short bigint" + ", kept binary" * texts)
