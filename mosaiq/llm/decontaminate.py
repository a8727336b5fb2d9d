"""Benchmark decontamination by latent semantic retrieval, then common-subsequence and answer checks.

One pass over the corpus counts passages and adds up a randomised sketch of
their TF-IDF matrix A (passages by words of the benchmark): Y = A'A Omega. Its
Nystroem factors are the singular vectors; no task holds more than words by
rank numbers, and no second pass is needed since the weights are diagonal and
can be put in afterwards. A second pass searches every document in two ways:

* Windows that hold a key word of an item are compared word by word with it,
  so no text that has enough of the item's own words is missed.
* Windows of about an item's length whose direction in the space is near the
  item's are candidates for a paraphrase in other words: a word that the item
  doesn't have stands for those of its words whose directions are near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import workers
from mosaiq.llm.lines import FOLD

WINDOW, STRIDE = 64, 32
RANK = 64
#: Share of an item's words in common with a stretch of text: enough alone, and enough if the item's answer is there whole.
ALONE, WITH_ANSWER = 0.8, 0.6
#: Cosine from which a window is a candidate for an item, and a word stands for another; passages that such words have at least.
COSINE, NEAR_WORD, KNOWN = 0.7, 0.7, 3
#: Share of an item's words that a paraphrase still has in order.
UNCHANGED = 0.5
#: Words of a block, blocks of the longest window, blocks at a time.
BLOCK, LONGEST, SPAN = 8, 32, 8192
#: Words of 64 bits that say which of an item's words a stretch can't have.
BITS = 8
#: Items that are searched for at a time.
ITEM_BLOCK = 5000
FLUSH = 60_000


def tokens(text: str) -> list[bytes]:
    """Words of letters and digits in lower case."""
    return text.lower().encode().translate(FOLD).split()


def lcs(at: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence; at has the places of each word of the other sequence as bits."""
    full = (1 << n) - 1
    row = full
    for w in words:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def places(words: list) -> dict:
    at: dict = {}
    for k, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << k
    return at


@dataclass
class Item:
    """A benchmark item; its answer is its last sentence, or its last quarter if that is shorter than 3 words or more than half."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]
    joined: bytes = b""
    at: dict[bytes, int] = field(default_factory=dict)
    answer_at: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.joined = b" " + b" ".join(self.words) + b" "
        self.at, self.answer_at = places(self.words), places(self.answer)

    def share(self, text: list[bytes], start: int, end: int) -> float:
        """The share of the item's words that a stretch of about its length near the window has in order, 0 if it isn't enough."""
        n = len(self.words)
        low, high = max(0, start - n), min(len(text), end + n)
        if self.joined in b" " + b" ".join(text[low:high]) + b" ":
            return 1.0
        size, best = -(-5 * n // 4), 0.0
        for a in range(low, max(low + 1, high - size + max(1, n // 8)), max(1, n // 8)):
            part = text[a : a + size]
            got = lcs(self.at, n, part) / n
            if got > best and (got >= ALONE or got >= WITH_ANSWER and lcs(self.answer_at, len(self.answer), part) == len(self.answer)):
                best = got
        return best


def read_items(benchmark: DataFrame) -> list[Item]:
    """The items that have words, by id; equal rows once."""
    out = []
    for r in benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "text").distinct().orderBy("item_id", "text").collect():
        words = tokens(r.text)
        if words:
            sentences = [t for t in map(tokens, r.text.replace("\n", " ").rstrip(" .!?").rsplit(". ", 1)) if t]
            last = sentences[-1] if len(sentences) > 1 else words
            out.append(Item(r.item_id, words, last if 3 <= len(last) <= len(words) / 2 else words[-max(1, len(words) // 4) :]))
    return out


@dataclass
class Space:
    """Word weights and latent directions, the items' unit vectors there, and their key words.

    Text can't hold an item without one of its key words: its rarest words, as
    many as it may lack and one more, and the rarest word of its answer.
    """

    vocab: dict[bytes, int]
    basis: np.ndarray
    items: np.ndarray
    key_ends: np.ndarray  # by word, where its items end in key_items
    key_items: np.ndarray
    words: list[np.ndarray]  # by item
    answers: list[np.ndarray]
    directions: np.ndarray  # unit vectors of the words, zero for rare ones
    scales: np.ndarray  # by item, the blocks of its windows
    bits: np.ndarray = field(init=False)  # of a word
    item_bits: np.ndarray = field(init=False)
    at: list[dict[int, int]] = field(init=False)  # by item, the places of its words as bits

    def __post_init__(self) -> None:
        # word -1, which is none of the vocabulary, has no direction and no bits
        self.basis, self.directions = (np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)]) for x in (self.basis, self.directions))
        k = np.arange(len(self.vocab))
        self.bits = np.zeros((len(k) + 1, BITS), np.uint64)
        self.bits[k, k // 64 % BITS] = np.uint64(1) << (k % 64).astype(np.uint64)
        self.at = [places(w.tolist()) for w in self.words]
        self.item_bits = np.array([np.bitwise_or.reduce(self.bits[w], axis=0) for w in self.words])

    def margin(self, item: int) -> int:
        """How many words beside a window the item's words are looked for."""
        n = len(self.words[item])
        return max(n // 2, n - int(self.scales[item]) * BLOCK // 2)

    def may_hold(self, present: np.ndarray, item: int) -> bool:
        """Whether the words alone allow that text has the item."""
        share = present[self.words[item]].mean()
        return share >= ALONE or share >= WITH_ANSWER and bool(present[self.answers[item]].all())

    def near_share(self, item: int, ids: np.ndarray) -> float:
        """The share of the item's words that a stretch of ids of about its length has in order, near words included; 0 if it isn't enough."""
        own = self.words[item]
        n = len(own)
        exact = self.at[item]
        if lcs(exact, n, ids.tolist()) < UNCHANGED * n:
            return 0.0
        others = np.array([w for w in set(ids.tolist()) if w not in exact], np.int64)
        near = self.directions[others] @ self.directions[own].T >= NEAR_WORD
        if (np.isin(own, ids) | near.any(axis=0)).mean() < ALONE:
            return 0.0
        both = exact | {int(w): sum(1 << int(k) for k in np.flatnonzero(row)) for w, row in zip(others, near, strict=True) if row.any()}
        size, step, best = -(-5 * n // 4), max(1, n // 8), 0.0
        for a in range(0, max(1, len(ids) - size + step), step):
            part = ids[a : a + size].tolist()
            if lcs(exact, n, part) >= UNCHANGED * n and (got := lcs(both, n, part) / n) >= ALONE:
                best = max(best, got)
        return best


def _terms(row: np.ndarray, word: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) by row; word -1 is none of the vocabulary."""
    hit = word >= 0
    key, n = np.unique(row[hit] * d + word[hit], return_counts=True)
    return key // d, key % d, n.astype(np.float32)


def _sum_rows(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums values by row, which must be in order."""
    if not len(row):
        return row, values
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[first], np.add.reduceat(values, first, axis=0)


def sketch_add(y: np.ndarray, df: np.ndarray, row: np.ndarray, word: np.ndarray, omega: np.ndarray) -> None:
    """Adds T'T omega of passages to y, and in how many each word occurs to df."""
    row, word, n = _terms(row, word, len(omega))
    df += np.bincount(word, minlength=len(omega))
    rows, z = _sum_rows(row, n[:, None] * omega[word])
    order = np.argsort(word, kind="stable")
    words, add = _sum_rows(word[order], n[order, None] * z[np.searchsorted(rows, row[order])])
    y[words] += add


def fit_space(docs: DataFrame, items: list[Item], rank: int = RANK) -> Space:
    """Latent space of the passages of all documents over the items' words, which the items join."""
    vocab = {w: k for k, w in enumerate(sorted({w for i in items for w in i.words}))}
    d = len(vocab)
    k = min(d, rank + 16)
    omega = np.random.Generator(np.random.PCG64(7)).standard_normal((d, k)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, omega))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.enter("decontaminate")
        own, directions = shared.value
        y, df, passages = np.zeros((len(own), directions.shape[1]), np.float64), np.zeros(len(own), np.int64), 0
        rows, words, held = [], [], 0

        def flush() -> None:
            if rows:
                sketch_add(y, df, np.concatenate(rows), np.concatenate(words), directions)
            rows.clear()
            words.clear()

        for batch in batches:
            for text in batch["text"]:
                ids = np.array([own.get(w, -1) for w in tokens(text)], np.int64)
                rows.append(passages + np.arange(len(ids)) // WINDOW)
                words.append(ids)
                passages += -(-len(ids) // WINDOW)
                held += len(ids)
                if held > FLUSH:
                    flush()
                    held = 0
        flush()
        parts = [(p, passages if p == 0 else 0, df[a : a + 256].tobytes(), y[a : a + 256].astype(np.float32).tobytes()) for p, a in enumerate(range(0, len(own), 256))]
        yield pd.DataFrame(parts, columns=["part", "passages", "df", "y"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = lambda c, kind: sum(np.frombuffer(x, kind).astype(np.float64) for x in group[c])
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "passages": [int(group["passages"].sum())], "df": [total("df", np.int64).astype(np.int64).tobytes()], "y": [total("y", np.float32).tobytes()]})

    kind = "part int, passages bigint, df binary, y binary"
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    got = texts.mapInPandas(sketch, kind).groupBy("part").applyInPandas(add, kind).orderBy("part").collect()  # words by rank numbers
    n = sum(r.passages for r in got)
    df = np.frombuffer(b"".join(r.df for r in got), np.int64) if got else np.zeros(d, np.int64)
    y = np.frombuffer(b"".join(r.y for r in got), np.float64).reshape(d, k).copy() if got else np.zeros((d, k))
    own = _terms(np.repeat(np.arange(len(items)), [len(i.words) for i in items]), np.array([vocab[w] for i in items for w in i.words], np.int64), d)
    # the items count as passages, often enough to be seen in a large corpus
    weight = max(1.0, 0.01 * n / len(items))
    extra, none = np.zeros((d, k)), np.zeros(d, np.int64)
    sketch_add(extra, none, np.repeat(own[0], own[2].astype(int)), np.repeat(own[1], own[2].astype(int)), omega)
    idf = np.log(1 + (n + len(items)) / (1 + df))
    # A'A (omega / idf) = idf * T'T omega; its Nystroem approximation Y (omega'Y)^-1 Y' gives the singular vectors
    y = idf[:, None] * (y + weight * extra)
    om = omega / idf[:, None]
    shift = 1e-6 * np.linalg.norm(y)
    y += shift * om
    inner = om.T @ y
    vals, vecs = np.linalg.eigh((inner + inner.T) / 2)
    good = vals > vals.max() * 1e-10
    u, s, _ = np.linalg.svd(y @ (vecs[:, good] / np.sqrt(vals[good])), full_matrices=False)
    kept = min(rank, int((s > 0).sum()))
    basis = (idf[:, None] * u[:, :kept]).astype(np.float32)
    directions = u[:, :kept] * s[:kept]
    directions *= (df >= KNOWN)[:, None] / np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)
    _, vectors = _sum_rows(own[0], own[2][:, None] * basis[own[1]])
    words, answers = ([np.array([vocab[w] for w in x], np.int64) for x in side] for side in ([i.words for i in items], [i.answer for i in items]))
    keys = sorted({(w, k) for k, (ws, an) in enumerate(zip(words, answers, strict=True)) for w in key_words(ws, an, df)})
    ends = np.cumsum(np.bincount([w for w, _ in keys], minlength=d))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    scales = np.array([min(LONGEST, 2 << max(0, round(math.log2(len(w) / (2 * BLOCK))))) for w in words], np.int64)
    return Space(vocab, basis, unit.astype(np.float32), ends, np.array([k for _, k in keys], np.int64), words, answers, directions.astype(np.float32), scales)


def key_words(words: np.ndarray, answer: np.ndarray, df: np.ndarray) -> set[int]:
    """The rarest words that make up more of an item than it may lack, and the answer's rarest."""
    ids, n = np.unique(words, return_counts=True)
    order = np.lexsort((ids, df[ids]))
    may_lack = len(words) - math.ceil(Fraction(str(ALONE)) * len(words))
    enough = int(np.searchsorted(np.cumsum(n[order]), may_lack, side="right")) + 1
    return {*ids[order[:enough]].tolist(), int(answer[np.lexsort((answer, df[answer]))[0]])}


def nominate(space: Space, coded: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(text, place, item) for windows of about an item's length whose direction is near the item's."""
    pad = int(space.scales.max())
    sizes = np.array([-(-len(ids) // BLOCK) + pad for ids in coded])
    first = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()) * BLOCK, -1)
    for ids, k in zip(coded, (first * BLOCK).tolist(), strict=True):
        flat[k : k + len(ids)] = ids
    # items, how many of their words may be missing; all may where the margin is wider than a window
    lack = np.array([len(w) * (1 - UNCHANGED) if space.margin(k) <= space.scales[k] * BLOCK else np.inf for k, w in enumerate(space.words)])
    of_scale = [(int(k), np.flatnonzero(space.scales == k)) for k in np.unique(space.scales)]
    total = len(flat) // BLOCK
    for a in range(0, total, SPAN):
        low = max(0, a - pad)
        part = flat[low * BLOCK : (a + SPAN + 2 * pad) * BLOCK].reshape(-1, BLOCK)
        sums, seen = space.basis[part[:, 0]], space.bits[part[:, 0]]
        for k in range(1, BLOCK):
            sums += space.basis[part[:, k]]
            seen |= space.bits[part[:, k]]
        width = 1
        seen[:-1] |= seen[1:]  # always of twice the width
        for scale, items in of_scale:
            while width < scale:
                sums[:-width] += sums[width:]
                width *= 2
                seen[:-width] |= seen[width:]
            at = np.arange(a, min(a + SPAN, total), scale // 2) - low
            vectors = sums[at]
            vectors /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)[:, None]
            win, i = np.nonzero(vectors @ space.items[items].T >= COSINE)
            around = seen[at[win]] | seen[np.maximum(at[win] - scale, 0)]
            enough = np.bitwise_count(space.item_bits[items[i]] & ~around).sum(axis=1) <= lack[items[i]]
            win, i = win[enough], i[enough]
            # the padding is no shorter than a window, so one that ends in a text has words of no other
            place = (low + at[win]) * BLOCK
            text = np.searchsorted(first * BLOCK, place + scale * BLOCK - 1, side="right") - 1
            yield from zip(text.tolist(), (place - first[text] * BLOCK).tolist(), items[i].tolist(), strict=True)


def search_texts(space: Space, items: list[Item], texts: list[str]) -> list[dict[int, float]]:
    """For each text the items found in it, and the share of their words in common."""
    split = [tokens(t) for t in texts]
    coded = [np.array([space.vocab.get(w, -1) for w in ws], np.int64) for ws in split]
    found = search_words(space, items, split, coded)
    for d, place, i in nominate(space, coded):
        item, hit = items[i], found[d]
        if item.item_id not in hit:
            side, end = space.margin(i), place + int(space.scales[i]) * BLOCK
            if share := space.near_share(i, coded[d][max(0, place - side) : end + side]):
                hit[item.item_id] = share
    return found


def search_words(space: Space, items: list[Item], split: list[list[bytes]], coded: list[np.ndarray]) -> list[dict[int, float]]:
    """The items of which a text has enough words, found by their key words."""
    found: list[dict[int, float]] = [{} for _ in split]
    many = np.append(np.diff(np.concatenate([[0], space.key_ends])), 0)  # the last is for words of no item
    starts, docs, rows, words, n = [], [], [], [], 0
    for d, ids in enumerate(coded):
        first = np.arange(0, max(1, len(ids) - WINDOW + STRIDE), STRIDE)
        keys = np.concatenate([[0], np.cumsum(many[ids] > 0)])
        for a in first[keys[np.minimum(first + WINDOW, len(ids))] > keys[first]].tolist():
            part = ids[a : a + WINDOW]
            rows.append(np.full(len(part), n))
            words.append(part)
            starts.append(a)
            docs.append(d)
            n += 1
    if not n:
        return found
    row, word = np.concatenate(rows), np.concatenate(words)
    for a in range(0, n, 2000):
        low, high = np.searchsorted(row, (a, min(n, a + 2000)))
        # items with a key word in the window
        r, w = row[low:high], word[low:high]
        times = many[w]
        at = np.repeat(space.key_ends[w] - times, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.unique(np.repeat(r, times) * len(items) + space.key_items[at])
        last, present = -1, np.zeros(0, bool)
        for win, i in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist()):  # noqa: B905
            item, hit, text = items[i], found[docs[win]], coded[docs[win]]
            if hit.get(item.item_id, 0) >= 1:
                continue
            reach = len(item.words)
            if reach > WINDOW or last != win:
                last, present = (win, np.zeros(len(space.vocab) + 1, bool)) if reach <= WINDOW else (-1, np.zeros(len(space.vocab) + 1, bool))
                wide = max(reach, WINDOW)
                present[text[max(0, starts[win] - wide) : starts[win] + WINDOW + wide]] = True
            if space.may_hold(present, i) and (share := item.share(split[docs[win]], starts[win], starts[win] + WINDOW)) > hit.get(item.item_id, 0):
                hit[item.item_id] = share
    return found


def _searcher(shared: Broadcast):  # noqa: ANN202
    @F.pandas_udf("struct<item_ids:array<bigint>,best:double>")
    def search(texts: pd.Series) -> pd.DataFrame:
        workers.enter("decontaminate")
        space, items = shared.value
        out = []
        for k in range(0, len(texts), 200):
            out += search_texts(space, items, texts.iloc[k : k + 200].tolist())
        return pd.DataFrame({"item_ids": [sorted(x) for x in out], "best": [max(x.values(), default=0.0) for x in out]})

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with item_ids (array, sorted) and best (the largest share, 0 without items) added.

    A document is contaminated by an item if a stretch of it has 0.8 of the
    item's words in order, or 0.6 and the whole answer; or if it has half of
    them in order, 0.8 with words that the space holds for near, and its
    direction is near the item's. Only words of the benchmark that the corpus
    has in KNOWN passages have directions. Null and empty texts,
    and all texts if the benchmark is empty, have no items. Repeated rows get
    equal results; columns of these names are replaced, others stay. Texts
    are compared by words in lower case without punctuation.
    """
    found = docs.drop("item_ids", "best")
    items = read_items(benchmark)
    if not items:
        return found.withColumns({"item_ids": F.array().cast("array<bigint>"), "best": F.lit(0.0)})
    columns = []
    for a in range(0, len(items), ITEM_BLOCK):
        block = items[a : a + ITEM_BLOCK]
        shared = docs.sparkSession.sparkContext.broadcast((fit_space(docs, block), block))

        name = f"__block{a}"
        found = found.withColumn(name, _searcher(shared)(F.coalesce("text", F.lit(""))))
        columns.append(name)
    ids = F.array_sort(F.array_distinct(F.concat(*(F.col(f"{c}.item_ids") for c in columns))))
    best = F.greatest(*(F.col(f"{c}.best") for c in columns), F.lit(0.0))
    return found.withColumns({"item_ids": ids, "best": best}).drop(*columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), F.array_join("item_ids", ",").alias("item_ids"), F.round("best", 4).alias("best"))
