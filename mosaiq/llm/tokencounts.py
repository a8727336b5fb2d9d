"""Token counts of a piece vocabulary, by merging ragged arrays of symbols rank by rank.

1. A text's blanks become the vocabulary's mark, and it is cut into pre-tokens
   wherever two characters meet that no piece holds side by side, so no merge
   reaches across.
2. The pre-tokens of a batch that aren't remembered yet lie one after another
   in one array of symbols. In each round every sequence merges its pair of
   lowest rank: all occurrences, from the left, up to the first whose merge
   makes a pair that would have to come next.
3. What no pair can merge any more is counted; a text's count is the sum of
   its pre-tokens'.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import workers

#: The mark that stands for a blank.
MARK = "▁"
#: Pre-tokens that a worker remembers before it starts anew, and the longest that it does.
MEMO, LONGEST = 600_000, 60
#: Texts whose pre-tokens are merged together, and symbols in an array, about.
BATCH, SYMBOLS = 200, 1_000_000
#: A longer pre-token is merged by a heap: a round looks at all of a sequence, so rounds would take its square.
MANY_SYMBOLS = 5_000
NONE = np.int64(1 << 40)


class Pieces:
    """The tables of a vocabulary: symbols of characters, and rank and result of each pair of symbols.

    Bounded by the vocabulary. Characters that it lacks are one symbol, which
    stands for its UTF-8 bytes.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if not any(map(model.is_byte, range(size))) or model.encode("A ﬁ  ", out_type=str) and "".join(model.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the vocabulary must have pieces for bytes, a mark before each text, and take texts as they are")
        own = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        chars = sorted({c for p in own for c in p})
        ids = {c: size + k for k, c in enumerate(chars)} | own
        #: code points of the alphabet, in order, and their symbols; the last symbol is any other character
        self.codes, self.symbols = np.array([ord(c) for c in chars], np.int64), np.array([ids[c] for c in chars], np.int64)
        self.unknown = size + len(chars)
        #: whether a symbol is a token of its own, or so many bytes
        self.whole = np.arange(self.unknown + 1) < size
        scores = np.unique([-model.get_score(i) for i in own.values()])
        rows = sorted((ids[p[:k]] * (self.unknown + 1) + ids[p[k:]], int(np.searchsorted(scores, -model.get_score(i))), i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        self.keys, ranks, self.made = (np.array(x, np.int64) for x in zip(*rows))  # noqa: B905
        self.ranks = np.append(ranks, NONE)
        self.pattern = self._pattern(list(own))

    @staticmethod
    def _pattern(pieces: list[str]) -> str:
        """Runs of characters that pieces connect, with the marks before them; a character that pieces have only alone stands alone."""
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.setdefault(c, c) != c:
                c = up[c]
            return c

        for p in pieces:
            for a, b in zip(p, p[1:]):  # noqa: B905
                if b == MARK and a != MARK:
                    return "(?s:.+)"  # a mark inside a piece: nothing is safe to cut
                if a != MARK:
                    up[top(a)] = top(b)
        groups: dict[str, list[str]] = {}
        for c in up:
            groups.setdefault(top(c), []).append(c)
        runs = [f"[{re.escape(''.join(sorted(g)))}]+" for g in sorted(groups.values(), key=len, reverse=True)]
        return f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+"

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the table of each pair of symbols, -1 for none."""
        key = left * (self.unknown + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def spread(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.repeat(values, lens)


class Counter(dict):
    """From a pre-token to its number of tokens; remembers those it has met."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.find = pieces, re.compile(pieces.pattern).findall

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' symbols one after another, how many each has, and the tokens of each symbol if it survives."""
        p = self.pieces
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(p.codes, codes), len(p.codes) - 1)
        sym = np.where(p.codes[at] == codes, p.symbols[at], p.unknown)
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        return sym, np.fromiter(map(len, words), np.int64, len(words)), np.where(p.whole[sym], 1, size)

    def merge(self, words: list[str]) -> np.ndarray:
        """The number of symbols that survive in each word, in tokens; all words go through each round together."""
        p = self.pieces
        sym, lens, weight = self.symbols(words)
        out, of = np.zeros(len(words), np.int64), np.arange(len(words))
        starts = np.cumsum(lens) - lens
        pair = np.append(p.pair(sym[:-1], sym[1:]), -1)
        pair[starts + lens - 1] = -1
        while len(lens):
            rank = p.ranks[pair]
            low = np.minimum.reduceat(rank, starts)
            over = low == NONE
            if over.any():
                out[of[over]] = np.add.reduceat(weight, starts)[over]
                stay = spread(~over, lens)
                sym, weight, pair, rank = sym[stay], weight[stay], pair[stay], rank[stay]
                of, lens, low = of[~over], lens[~over], low[~over]
                starts = np.cumsum(lens) - lens
                if not len(lens):
                    break
            seq = spread(np.arange(len(lens)), lens)
            hit = np.flatnonzero(rank == low[seq])
            # of pairs that overlap every other one goes, from the left
            fresh = np.diff(hit, prepend=-2) != 1
            begin = np.flatnonzero(fresh)
            nth = np.arange(len(hit)) - begin[np.cumsum(fresh) - 1]
            hit = hit[nth % 2 == 0]
            new, own = p.made[pair[hit]], seq[hit]
            # a merge that makes a pair of the same rank or a lower one is the last of its round
            before = np.maximum(hit - 1, 0)
            joined = np.diff(hit, prepend=-9) == 2
            left = np.where(joined, np.roll(new, 1), sym[before])
            after = np.minimum(hit + 2, len(sym) - 1)
            ends = starts + lens
            next_up = (p.ranks[p.pair(left, new)] <= low[own]) & (hit > starts[own]) | (p.ranks[p.pair(new, sym[after])] <= low[own]) & (hit + 2 < ends[own])
            until = np.cumsum(next_up) - next_up
            first = np.flatnonzero(np.diff(own, prepend=-1))
            go = until == until[first][np.searchsorted(own[first], own)]
            hit, new, own = hit[go], new[go], own[go]
            sym[hit], weight[hit] = new, 1
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            changed[hit[hit > 0] - 1] = True
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, weight, pair, changed = sym[stay], weight[stay], pair[stay], changed[stay]
            lens = lens - np.bincount(own, minlength=len(lens))
            starts = np.cumsum(lens) - lens
            again = np.flatnonzero(changed)
            pair[again] = p.pair(sym[again], sym[np.minimum(again + 1, len(sym) - 1)])
            pair[starts + lens - 1] = -1
        return out

    def merge_long(self, word: str) -> int:
        """The same for one word of any length."""
        p = self.pieces
        sym, _, weight = (x.tolist() for x in self.symbols([word]))
        table = {k: (r, m) for k, r, m in zip(p.keys.tolist(), p.ranks.tolist(), p.made.tolist())}  # noqa: B905
        n, wide = len(sym), p.unknown + 1
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(found[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (found := table.get(sym[i] * wide + sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], weight[i], weight[j] = table[a * wide + b][1], -1, 1, 0
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := table.get(sym[i] * wide + sym[k]):
                    heapq.heappush(heap, (found[0], i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (found := table.get(sym[h] * wide + sym[i])):
                heapq.heappush(heap, (found[0], h, sym[h], sym[i]))
        return sum(weight)

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words not met before; the long ones are given back but not remembered."""
        rest = {w: self.merge_long(w) for w in words if len(w) > MANY_SYMBOLS}
        todo = [w for w in words if len(w) <= MANY_SYMBOLS]
        at = np.cumsum([len(w) for w in todo]) // SYMBOLS if todo else []
        for k in np.unique(at).tolist():
            some = [w for w, c in zip(todo, at.tolist()) if c == k]  # noqa: B905
            for w, n in zip(some, self.merge(some).tolist()):  # noqa: B905
                (self if len(w) <= LONGEST else rest)[w] = n
        return rest

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        split = [self.find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*split)
        if len(self) + len(every) > MEMO:
            self.clear()
        rest = self.learn({w for w in every if w not in self})
        get = (lambda w: self[w] if w in self else rest[w]) if rest else self.__getitem__
        return [sum(map(get, words)) for words in split]


_counters: dict[int, Counter] = workers.remembered({})


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of docs(doc_id, text): the length of each whole text in UTF-8 bytes and in tokens.

    model is a path on the driver of a vocabulary with byte fallback; its
    tables, bounded by the vocabulary, are broadcast. No begin, end or other
    token is added, and names of special tokens in a text are text. Null texts
    count as empty, and empty ones have no tokens. doc_id is of any type, null
    too; repeated rows each get theirs; other columns are left out.
    """
    pieces = Pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    mark = xxhash.xxh3_64_intdigest(pieces.keys.tobytes() + pieces.ranks.tobytes() + pieces.pattern.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("tokens")
        counter = _counters.get(mark)
        if counter is None:
            _counters.clear()
            counter = _counters[mark] = Counter(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for k in range(0, len(texts), BATCH) for n in counter.count(texts[k : k + BATCH])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    done = rows.mapInArrow(run, rows.select("doc_id", "n_bytes").schema.add("n_tokens", "long"))
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
