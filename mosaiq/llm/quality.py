"""A generalised additive model with pairwise interactions over features of the text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import workers

FEATURES = [
    "log_chars", "log_words", "word_len", "word_len_sd", "upper", "digit", "symbol", "non_ascii", "space", "distinct", "top_word", "adjacent_same",
    "lines_per_word", "distinct_lines", "capital_words", "marked_words", "short_words", "long_words", "comma_stop", "bars", "last_stop", "symbol_runs",
]
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?()-")
HIGH, SPACE = bytes(range(128, 256)), b" \t\n\r\x0b\x0c"
RUNS = re.compile(r"([^\w\s.\-])\1+")
#: Rows of labelled documents that a fit reads at most.
FIT_ROWS = 20_000


def features(text: str) -> list[float]:
    """Numbers that describe a text; all zero for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    size = len(raw)
    share = lambda kind: (size - len(raw.translate(None, kind))) / size
    lens = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(len(text)), math.log1p(n), float(lens.mean()), float(lens.std()), share(UPPER), share(DIGIT), share(SYMBOL), share(HIGH), share(SPACE),
        len(counts) / n**0.85, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(w[0].isupper() for w in words) / n, sum(not w[-1].isalnum() for w in words) / n,
        float((lens <= 2).mean()), float((lens >= 12).mean()), (raw.count(b",") + raw.count(b".")) / n, raw.count(b"|") / n, float(text.rstrip()[-1] in ".!?"), len(RUNS.findall(text)) / n,
    ]


@dataclass
class Gam:
    """Bin edges, and the lookup tables of features and of pairs of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1: table entries by bin, added up."""
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (f, g), table in self.pairs.items():
            total += table[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree over ordered bins, grown best cut first; what it adds to each bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gain = _gain(cg, ch) + _gain(g[a:b].sum() - cg, h[a:b].sum() - ch) - _gain(g[a:b].sum(), h[a:b].sum())
        return float(gain.max()), a + 1 + int(gain.argmax())

    while len(parts) < leaves:
        (gain, cut), (a, b) = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut in each of two features, four leaves; its gain, and what it adds to each cell."""
    cg, ch = (np.cumsum(np.cumsum(np.pad(x, ((1, 0), (1, 0))), 0), 1) for x in (g, h))
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    quads = lambda c: (c[a, b], c[:, -1][a] - c[a, b], c[-1][b] - c[a, b], c[-1, -1] - c[:, -1][a] - c[-1][b] + c[a, b])
    if not a.size:
        return 0.0, np.zeros_like(g)
    gain = sum(_gain(x, y) for x, y in zip(quads(cg), quads(ch), strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pair_bins: int = 8, most_pairs: int = 8) -> Gam:
    """Cyclic boosting: each round gives every feature one shallow tree in turn, then every chosen pair.

    Without both labels in y the model is their share (0.5 without any row).
    """
    n = len(y)
    prior = (float(y.sum()) + 1) / (n + 2)
    edges, coarse = ([_cuts(x[:, f], k) if n else np.zeros(0) for f in range(x.shape[1])] for k in (bins, pair_bins))
    model = Gam(math.log(prior / (1 - prior)), edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    if not n or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    at2 = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            add = rate * _tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)))
            table += add
            total += add[at[f]]

    def cells(f: int, g: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return at2[f] * shape[1] + at2[g], shape

    def tree(f: int, g: int, slope: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
        cell, shape = cells(f, g)
        return _tree2(*(np.bincount(cell, s, shape[0] * shape[1]).reshape(shape) for s in slope))

    slope = slopes()
    ranked = sorted(((-tree(f, g, slope)[0], f, g) for f in range(x.shape[1]) for g in range(f)))[:most_pairs]
    for _, f, g in ranked:
        model.pairs[f, g] = np.zeros(cells(f, g)[1])
    for _ in range(rounds // 3):
        for (f, g), table in model.pairs.items():
            add = rate * tree(f, g, slopes())[1]
            table += add
            total += add.ravel()[cells(f, g)[0]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(quality, x): features of labelled documents whose crc32(doc_id) mod 5 is not 0, fit_rows at most.

    The sample is by a hash of the id, so it is the same each time. Its ids,
    at most fit_rows, are broadcast.
    """
    usable = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("quality").isNotNull())
    chosen = usable.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(fit_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        workers.enter("quality")
        for batch in batches:
            yield pd.DataFrame({"quality": batch["quality"], "x": [features(t) for t in batch["text"]], "doc_id": batch["doc_id"]})

    return texts.select("doc_id", "quality", "text").mapInPandas(run, "quality double, x array<double>, doc_id bigint")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Gam:
    rows = training_rows(docs, labels, fit_rows).orderBy("doc_id", "quality").limit(2 * fit_rows).collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_gam(x, np.array([r.quality for r in rows], dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted added; every other column stays.

    Null texts count as empty; an empty text gets the score of zero features.
    Without labels every score is 0.5. Repeated rows get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        workers.enter("quality")
        x = np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        return pd.Series(shared.value.score(x))

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumns({"held_out": held, "predicted": F.when(F.col("score") >= least, 1).otherwise(0)})


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")
