"""Byte-level BPE with a minimal acyclic lexicon of frequent words; what the lexicon lacks is merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import workers

# The white space that the pre-tokenizer's \s stands for, and its pattern.
WHITE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: No word of the pattern reaches across two of these pieces, and none depends on a neighbour.
PIECES = rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Pieces a worker remembers before it starts anew.
MEMO = 800_000
#: Texts that are encoded together.
BATCH = 100
#: Texts whose results go on together.
FRAME = 500


def byte_letters() -> dict[str, int]:
    """The letters by which a vocabulary file spells bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        #: by the ids of both parts; and what they become, by rank
        self.ranks = {self.ids[a] << 32 | self.ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.added = added
        self.bytes = [b""] * (max([*self.ids.values(), *added.values()]) + 1)
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes[i] = t

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is joined, leftmost first, until none is left."""
        parts = [self.first[b] for b in word]
        if len(parts) > 200:
            return self._merge_long(parts)
        get, none = self.ranks.get, 1 << 30
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap over a linked list: n log n, for words of any length."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = lambda i, j: self.ranks.get(parts[i] << 32 | parts[j])
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[best], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(i, k)) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank(h, i)) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]


class Lexicon:
    """A minimal acyclic automaton over the bytes of words.

    Suffixes are shared between words. Each transition carries how many words
    sort before those it leads to, so a walk adds up to the word's number, and
    the numbers index the id outputs. All of it is one array in a file that
    workers map into memory.
    """

    def __init__(self, flat: np.ndarray) -> None:
        trans, states, words, ids = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, trans, trans, trans, states, words + 1, ids])
        self.keys, self.target, self.before, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))  # noqa: B905

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.load(path, mmap_mode="r"))

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> np.ndarray:
        """Adds words in order; a finished branch is replaced by an equal one that is registered already."""
        words = sorted(entries)
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple]] = []  # by state: final, (byte, target)s

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        last = b""

        def close(keep: int) -> None:
            while len(path) > keep + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))

        for w in words:
            same = next((i for i, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))  # noqa: B905
            close(same)
            path.extend([False, []] for _ in w[same:])
            path[-1][0] = True
            last = w
        close(0)
        root = freeze(path[0])
        below = [0] * len(done)
        for s, (final, out) in enumerate(done):  # targets are frozen before what leads to them
            below[s] = final + sum(below[t] for _, t in out)
        number = {s: s for s in range(len(done))} | {root: 0, 0: root}
        rows = []
        for s, (final, out) in enumerate(done):
            n = int(final)
            for b, t in out:
                rows.append((number[s] * 256 + b, number[t], n))
                n += below[t]
        rows.sort()
        flat = np.array(rows, dtype=np.int64).reshape(-1, 3)
        final = np.zeros(len(done), np.int64)
        for s, (f, _) in enumerate(done):
            final[number[s]] = f
        outputs = [entries[w] for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64)
        ids = np.array([i for o in outputs for i in o], dtype=np.int64)
        return np.concatenate([[len(flat), len(done), len(words), len(ids)], flat[:, 0], flat[:, 1], flat[:, 2], final, offsets, ids]).astype(np.int64)

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The outputs of words, None where the lexicon lacks them; all words walk at once, byte by byte."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        state, index, alive, active = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool), np.flatnonzero(lens > 0)
        step = 0
        while len(active):
            key = state[active] * 256 + text[at[active] + step]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            alive[active[~hit]] = False
            active, pos = active[hit], pos[hit]
            state[active], index[active] = self.target[pos], index[active] + self.before[pos]
            step += 1
            active = active[lens[active] > step]
        alive &= self.final[state] > 0
        offsets, ids = self.offsets, self.ids
        return [tuple(ids[offsets[i] : offsets[i + 1]].tolist()) if ok else None for ok, i in zip(alive.tolist(), index.tolist())]  # noqa: B905


class Encoder(dict):
    """From a piece of text to its ids; remembers pieces it has met."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        self.pieces, self.words = re.compile(PIECES), regex.compile(WORDS)
        self.names = [str(i) for i in range(len(bpe.bytes))]
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(bpe.added, key=len, reverse=True))) + ")") if bpe.added else None

    def learn(self, pieces: set[str]) -> None:
        """Looks up or merges the words of pieces not met before."""
        if len(self) + len(pieces) > MEMO:
            self.clear()
        new = [p for p in pieces if p not in self]
        split = [[w.encode() for w in self.words.findall(p)] for p in new]
        unseen = list({w for ws in split for w in ws})
        known = {w: got if got is not None else tuple(self.bpe.merge(w)) for w, got in zip(unseen, self.lexicon.find(unseen))}  # noqa: B905
        for p, ws in zip(new, split):  # noqa: B905
            self[p] = known[ws[0]] if len(ws) == 1 else tuple(i for w in ws for i in known[w])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; what isn't known yet of all of them is learnt at once."""
        parts = [self.marks.split(t) if self.marks else [t] for t in texts]
        split = [[self.pieces.findall(x) for x in p[::2]] for p in parts]
        every = set().union(*(x for p in split for x in p))
        new = {x for x in every if x not in self}
        if new:
            self.learn(every if len(self) + len(new) > MEMO else new)
        out = []
        get = self.__getitem__
        for p, pieces in zip(parts, split):  # noqa: B905
            ids = list(chain.from_iterable(map(get, pieces[0])))
            for mark, more in zip(p[1::2], pieces[1:]):  # noqa: B905
                ids.append(self.bpe.added[mark])
                ids.extend(chain.from_iterable(map(get, more)))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bpe.bytes.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int, share: float = 1e-6) -> list[str]:
    """The pieces of text that are most frequent over all documents, most at most.

    Each batch counts all its pieces and sends those that make up share of it
    and occur twice at least, so a count is short by no more than that share.
    Only speed depends on it: what is missing here is merged.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, total = re.compile(PIECES), Counter()

        def send() -> pd.DataFrame:
            least = max(2, share * total.total())
            rows = [(w, n) for w, n in total.items() if n >= least and len(w) <= 24]
            total.clear()
            return pd.DataFrame(rows, columns=["w", "n"]).astype({"w": str, "n": "int64"})

        for batch in batches:
            for text in batch["text"]:
                total.update(pieces.findall(text))
            if len(total) > 1_000_000:
                yield send()
        yield send()

    counted = docs.filter("text is not null").select("text").mapInPandas(count, "w string, n bigint")
    top = counted.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most)
    return [r.w for r in top.select("w").collect()]


def ship_lexicon(spark: SparkSession, flat: np.ndarray) -> str:
    """Sends the file to every executor through Spark, and returns the name by which they find it."""
    name = f"lexicon_{hashlib.sha256(flat.tobytes()).hexdigest()[:20]}.npy"
    if not os.path.exists(SparkFiles.get(name)):
        path = os.path.join(tempfile.mkdtemp(), name)
        np.save(path, flat)
        spark.sparkContext.addFile(path)
    return name


_encoders: dict[str, Encoder] = workers.remembered({})


def encode(docs: DataFrame, tokenizer: str, lexicon_words: int = 50_000) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of docs(doc_id, text): special tokens are found in the text, none is added.

    tokenizer is a path on the driver; its tables (bounded by the vocabulary)
    are broadcast. Null texts count as empty and have no ids. Repeated rows
    each get theirs; other columns are left out.
    """
    make = _encoder_for(docs, tokenizer, lexicon_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.enter("bpe")
        encoder = make()
        for batch in batches:
            texts = batch["text"].tolist()
            ids = [i for k in range(0, len(texts), BATCH) for i in encoder.encode_batch(texts[k : k + BATCH])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "decoded": [encoder.decode(i) for i in ids]})

    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id bigint, ids array<int>, decoded string")


def _encoder_for(docs: DataFrame, tokenizer: str, lexicon_words: int):  # noqa: ANN202
    spark = docs.sparkSession
    bpe = Bpe(tokenizer)
    probe = Encoder(bpe, Lexicon(np.zeros(4, np.int64)))
    words = {w.encode() for p in frequent_words(docs, lexicon_words) for w in probe.words.findall(p)}
    name = ship_lexicon(spark, Lexicon.compile({w: bpe.merge(w) for w in words}))
    shared = spark.sparkContext.broadcast(bpe)

    def make() -> Encoder:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(shared.value, Lexicon.open(SparkFiles.get(name)))
        return _encoders[name]

    return make


def bpe_digest(docs: DataFrame, tokenizer: str, lexicon_words: int = 50_000, ids: bool = False) -> DataFrame:
    """encode() summed up by row: decoded texts stay in the worker, and unless ids is set the ids too."""
    make = _encoder_for(docs, tokenizer, lexicon_words)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.enter("bpe")
        encoder = make()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts, doc_ids = batch["text"].tolist(), batch["doc_id"]
            del batch
            # what is done goes on at once, so that few ids are held
            for a in range(0, len(texts), FRAME):
                rows = []
                for k in range(a, min(len(texts), a + FRAME), BATCH):
                    for found in encoder.encode_batch(texts[k : min(k + BATCH, a + FRAME)]):
                        rows.append((len(found), sha(",".join(map(encoder.names.__getitem__, found))), sha(encoder.decode(found)), *([np.array(found, np.int32)] if ids else [])))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])
                yield out.assign(doc_id=doc_ids[a : a + FRAME].to_numpy())

    return docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, kind)
