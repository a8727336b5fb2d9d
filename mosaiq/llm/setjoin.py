"""Exact n-gram Jaccard join with index lists, skipping, and answers derived from similar sets' answers.

1. Document frequencies: each block sends its distinct shingles, packed, and
   gets back a frequency class for each.
2. Index: in the order of frequency class and hash, which is the same for all
   sets, two sets of likeness t share a shingle among the first
   n - ceil(t n) + 1 of either. Those that occur in one document only come
   first, can't be shared and are left out, so most documents send nothing. A list's entries meet at one node, not in pairs.
3. The lists' components hold all links. Within one, lists by shingle are
   skipped by size, one set's overlaps are counted, and those of the sets that
   it links with are derived from its own, by the shingles in which they
   differ, for the sets that bounds don't settle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaiq.llm import packed, workers
from mosaiq.llm.components import components
from mosaiq.llm.lineage import cut

NOMINATE = 6
#: Sets of a component that one task compares with each other; a larger one is dealt out in pairs of shares.
SHARE_SETS = 4000
KEY = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """A 64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = workers.remembered(Words())


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, sorted by both.

    Words are what stands between runs of ASCII white space, with A-Z in lower
    case. Fewer than n words are one shingle; a text without words has none.
    """
    docs, hashes = [], []
    for d, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        k = min(n, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : len(w) - k + 1 + i]) * KEY
            h ^= h >> np.uint64(29)
        h = np.unique(packed.mix(h))
        docs.append(np.full(len(h), d))
        hashes.append(h)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


def texts_of(row: Mapping) -> list[bytes]:
    raw, ends = packed.unpack(row["data"]), np.cumsum(row["lens"])
    return [raw[e - n : e] for n, e in zip(np.asarray(row["lens"]).tolist(), ends.tolist())]  # noqa: B905


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def frequency_class(order: np.ndarray, new: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 for a shingle of one block, else the number of bits of the number of blocks that have it."""
    out = np.zeros(len(order), np.uint8)
    out[order] = np.repeat(np.frexp(counts)[1].astype(np.uint8), counts)
    return out


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The least intersection of two sets of these sizes that links them: 100 i >= percent (a + b - i)."""
    return -(-percent * (np.asarray(a) + b) // (100 + percent))


class Index:
    """Lists by shingle of the sets of a component, each list in order of size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = [token[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")  # the sets come by size, and so do the entries of a list
        self.entries = owner[order]
        self.ends = np.cumsum(np.bincount(token))
        self.starts = self.ends - np.bincount(token)

    def overlaps(self, tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of tokens each set from low to high has; the parts of the lists outside are skipped."""
        total = np.zeros(high - low, np.int64)
        for t in tokens.tolist():
            part = self.entries[self.starts[t] : self.ends[t]]
            if len(part) and part[-1] >= low and part[0] < high:
                a, b = (0, len(part)) if part[0] >= low and part[-1] < high else np.searchsorted(part, (low, high))
                total[part[a:b] - low] += 1
        return total


def link_sets(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> np.ndarray:
    """The component of each set by links of percent likeness, as the index of its first set.

    sets must be in order of size. Where apart is given, sets of the same mark
    aren't compared: another task does it.
    """
    n, index = len(sets), Index(sets)
    root, done = np.arange(n), np.zeros(n, bool)

    def compare(x: int, z: np.ndarray) -> np.ndarray:
        return z if apart is None else z[apart[z] != apart[x]]

    def join(x: int, z: np.ndarray) -> None:
        roots = np.unique(np.append(root[z], root[x]))
        root[np.isin(root, roots)] = roots[0]

    for x in range(n):
        if done[x]:
            continue
        done[x] = True
        size = int(index.sizes[x])
        # sets that a set linked with x may link with: two steps of size away
        low = int(np.searchsorted(index.sizes, math.floor(size * percent * percent / 10_000)))
        high = int(np.searchsorted(index.sizes, math.ceil(size * 10_000 / percent / percent), side="right"))
        overlap = index.overlaps(index.tokens[x], low, high)
        near = low + np.flatnonzero(overlap >= need(size, index.sizes[low:high], percent))
        join(x, compare(x, near))
        for y in near[~done[near]].tolist():
            done[y] = True
            z = np.arange(low, high)
            z = compare(y, z[root[z] != root[y]])  # the same component: nothing to find
            if not len(z):
                continue
            mine = index.tokens[y]
            more, less = np.setdiff1d(mine, index.tokens[x], assume_unique=True), np.setdiff1d(index.tokens[x], mine, assume_unique=True)
            least = need(len(mine), index.sizes[z], percent)
            z = z[overlap[z - low] + len(more) >= least]
            if not len(z):
                continue
            shared = overlap + index.overlaps(more, low, high) - index.overlaps(less, low, high)
            join(y, z[shared[z - low] >= need(len(mine), index.sizes[z], percent)])
    return root


def set_classes(docs: DataFrame, carry: bool, percent: int = 80, words: int = 5) -> DataFrame:
    """(block, place, doc_id, n_shingles, root), by the blocks that carry or don't: root is the same for the documents of a component, null without words."""
    buckets = packed.bucket_count(packed.text_bytes(docs) / 7)
    blocks = packed.pack_blocks(docs, carry).drop("rest")

    def block_set(row: Mapping) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and shingle of each entry, and the block's distinct shingles."""
        doc, h = shingle_sets(texts_of(row), words)
        return doc, h, np.unique(h)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = block_set(row)[2]
                yield packed.sent_batch(packed.send(row["block"], 0, own, packed.mix(own), buckets, NOMINATE))

    def index(left: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        workers.enter("blocks")
        out = []
        for _, row in left.iterrows():
            doc, h, own = block_set(row)
            place = np.searchsorted(own, h)
            inside = np.bincount(place, minlength=len(own))
            level = packed.received(flags, 0, packed.mix(own), buckets).astype(np.int64)
            # the order must be the same in all blocks: only the block that alone has a shingle may rank it by its own count
            level = np.where(level > 1, level, inside > 1)[place]
            order = np.lexsort((h, level, doc))
            sizes = np.bincount(doc, minlength=len(row["lens"]))
            start = np.cumsum(sizes) - sizes
            rank = np.arange(len(doc)) - np.repeat(start, sizes)
            sized = np.repeat(sizes, sizes)
            chosen = (rank < sized - -(-percent * sized // 100) + 1) & (level[order] > 0)
            h_chosen, of = h[order][chosen].view(np.int64), doc[chosen]
            ends = np.searchsorted(of, np.arange(len(sizes)), side="right")
            for d, (i, n, s) in enumerate(zip(packed.ids_of(row), sizes.tolist(), start.tolist())):  # noqa: B905
                out.append((int(row["block"]), d, i, n, set_key(h[s : s + n]) if n else None, h_chosen[ends[d - 1] if d else 0 : ends[d]]))
        frame = pd.DataFrame(out, columns=["block", "place", "doc_id", "n", "node", "entries"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    ranks = packed.judge(packed.pack_blocks(docs, carry, first, packed.SENT), NOMINATE, frequency_class)
    listed = blocks.groupBy("block").cogroup(ranks.groupBy("block")).applyInPandas(index, "block bigint, place int, doc_id bigint, n bigint, node binary, entries array<bigint>")
    table = cut(listed)
    entries = table.filter(F.size("entries") > 0).select("node", F.explode("entries").alias("token")).distinct()
    hubs = entries.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    near = components(entries.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # one document stands for all of an equal set
    standing = table.filter("node is not null").groupBy("node").agg(F.min(F.struct("block", "place")).alias("at"))
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
    wanted = standing.join(near, "node").join(sizes, "root").select(F.col("at.block").alias("block"), F.col("at.place").alias("place"), "node", "root", "sets")

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            if len(right):
                texts = texts_of(row)
                doc, h = shingle_sets([texts[p] for p in right["place"]], words)
                cuts = np.searchsorted(doc, np.arange(len(right) + 1))
                shares = np.maximum(1, -(-right["sets"].to_numpy() // SHARE_SETS))
                for k, (root, node, m) in enumerate(zip(right["root"], right["node"], shares.tolist())):  # noqa: B905
                    data = h[cuts[k] : cuts[k + 1]].tobytes()
                    own = xxhash.xxh3_64_intdigest(bytes(node)) % m
                    for other in range(m):
                        out.append((root, min(own, other), max(own, other), own, node, m, data))
        return pd.DataFrame(out, columns=["root", "i", "j", "own", "node", "m", "data"])

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        workers.enter("blocks")
        rows = rows.assign(n=rows["data"].map(len)).sort_values(["n", "node"])
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        sets = [np.frombuffer(x, np.uint64) for x in rows["data"]]
        root = link_sets(sets, percent, rows["own"].to_numpy() if i != j else None)
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"a": nodes, "b": nodes[root], "whole": (rows["m"] == 1).to_numpy()})

    held = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(gather, "root binary, i int, j int, own int, node binary, m int, data binary")
    links = cut(held.groupBy("root", "i", "j").applyInPandas(verify, "a binary, b binary, whole boolean"))
    linked = links.filter("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not links.filter("not whole").isEmpty():
        linked = linked.union(components(links.filter("not whole").select("a", "b")))
    return table.join(linked.filter("node <> root"), "node", "left").select("block", "place", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))


def jaccard_components(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs(doc_id, text).

    Two documents link when 100 |A and B| >= percent |A or B| for their sets of
    shingles of words words; component_id is the smallest doc_id reachable.
    Null and empty texts, and texts without words, have no shingles and link
    with nothing: their own id is their component. Null ids are never the
    smallest unless a component has no other. Repeated rows each get a row.
    doc_id is read as a whole number, what isn't one as null.
    """
    rooted = set_classes(docs, False, percent, words)
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """docs with one row of each component: that of the smallest id, nulls last, and of equal ids the first read.

    Rows without words are components of their own and stay, as they are.
    Columns keep their names, order and types, whatever they are called.
    """
    blocks = packed.pack_blocks(docs, carry=True)
    rooted = set_classes(docs, True, percent, words).filter("root is not null")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "block", "place")
    firsts = rooted.groupBy("root").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = rooted.join(firsts, "root").filter(at != F.col("first")).select("block", "place")

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        stay = np.ones(len(left["rest"].combine_chunks().flatten()), bool)
        stay[right["place"].to_numpy()] = False
        texts = [t for row in left.drop_columns("rest").to_pylist() for t in texts_of(row)]
        mask = pa.array(stay)
        return pa.table({"text": pa.array(texts, pa.binary()).filter(mask).cast(pa.string()), "rest": left["rest"].combine_chunks().flatten().filter(mask)})

    fields = StructType().add("text", "string").add("rest", blocks.schema["rest"].dataType.elementType)
    done = blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(strip, fields)
    return packed.unpack_rest(done, docs)
