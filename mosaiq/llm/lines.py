"""Fuzzy line deduplication: SimHash, a join on pigeonhole blocks, edit similarity, connected groups.

1. A line's anchors are up to ANCHORS of its distinct words, chosen by a
   weighted hash that prefers long ones; words that are frequent in the corpus
   are none. A block is three anchors, and its 64 bits of the line's SimHash
   are those that most of the three words' hashes have. By the pigeonhole
   principle two lines of which up to ANCHORS - 3 anchors differ have a block
   in common. Lines of few words have blocks of all their words but one; those
   of more words but PART anchors or fewer take other words beside them.
2. Blocks of documents send fingerprints of their lines and of the SimHash
   blocks, and learn which occur more often. Only those lines are joined.
3. Each SimHash block has a lead, the first line that owns it, and lines meet
   at the leads of their blocks: near copies have few, so a line goes to few
   places, however many lines are connected with it. There those that share a
   block and aren't together yet are compared; groups are the components of
   what is alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from mosaiq.llm import packed, workers
from mosaiq.llm.components import components
from mosaiq.llm.lineage import cut
from mosaiq.llm.substrings import BASES, letters, powers

#: Anchors of a line, at most, and words of a block; bytes that an anchor has at least.
ANCHORS, PART, LONG = 6, 3, 4
#: Lines of at most FEW distinct words have blocks of all and of all but one; what such a block has at least, in bytes and words.
FEW, LEAST, SEVERAL = 8, 8, 2
#: A word is frequent if more than MOST of the lines have it, and more than (ANCHORS choose PART times the lines) ** (-1 / PART).
MOST, RARE_LINES = 0.02, 50
#: Lines, and bytes, of a lead that one task compares with each other; those of a larger one are dealt out in pairs of shares.
SHARE_LINES, SHARE_BYTES = 1500, 4_000_000
#: Bytes of lines of small leads that one task compares, about.
GROUP_BYTES = 1_000_000
#: Bytes of lines whose distances from one line are found together.
LANE_BITS = 8_000
#: Counts of 4-grams that are kept for a line; those of equal remainder count as one.
BINS = 1021
#: Lines are first aligned by their words if so much of the 4-grams that may change does; the others hardly pass that way.
LIKELY = 0.35
#: Bytes of text for each fingerprint that is sent, about.
BYTES_A_KEY = 9
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
#: Upper case to lower case, anything in ASCII but letters, digits and line feeds to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or b == 10 or chr(b).isalnum() else 32 for b in range(256))
KEY = np.uint64(0x9E3779B97F4A7C15)
CODE = letters(0)


def normalise(line: bytes) -> bytes:
    """Words of letters and digits in lower case (A-Z), one blank between them."""
    return b" ".join(line.translate(FOLD).split())


def powers_of(key: int, n: int) -> np.ndarray:
    """key ** i for i below n, modulo 2 ** 64."""
    row = np.full(max(n, 1), key % (1 << 64), np.uint64)
    row[0] = 1
    return np.multiply.accumulate(row)


class Words:
    """The words of folded text: where they start and end, their hashes, and their line, counted by line feeds."""

    def __init__(self, folded: bytes) -> None:
        raw = np.frombuffer(folded, np.uint8)
        inside = np.concatenate([[False], raw > 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.feeds = np.flatnonzero(raw == 10)
        self.line = np.searchsorted(self.feeds, self.start)
        parts, a = [], 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + CHUNK, side="right")))
            low = int(self.start[a])
            own, start, end = raw[low : int(self.end[b - 1])], self.start[a:b] - low, self.end[a:b] - low
            # a polynomial of each one's bytes, by differences of running sums
            up, down = powers(BASES[0], len(own))
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(np.multiply(CODE[own], up[: len(own)]), out=sums[1:])
            parts.append(packed.mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64)))
            a = b
        self.hash = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines that have words, by number, and two hashes of each one's sequence of words."""
        first = np.flatnonzero(np.diff(self.line, prepend=-1))
        if not len(first):
            return first, self.hash, self.hash
        count = np.diff(np.append(first, len(self.line)))
        nth = np.arange(len(self.line)) - np.repeat(first, count)
        sums = (np.add.reduceat(packed.mix(self.hash ^ np.uint64(k)) * powers_of(int(KEY) * (2 * k + 1), int(count.max()) + 1)[nth + 1], first) for k in (1, 2))
        one, two = (packed.mix(x ^ count.astype(np.uint64)) for x in sums)
        return self.line[first], one, two


def simhash(*hashes: np.ndarray) -> np.ndarray:
    """The bits that most of some words' hashes have (an odd number of words), for many blocks at once."""
    if len(hashes) == 1:
        return hashes[0]
    if len(hashes) == 3:
        a, b, c = hashes
        return (a & b) | (c & (a | b))
    # digits of a counter for each bit, in planes of 64 bits
    planes = [np.zeros_like(hashes[0]) for _ in range(len(hashes).bit_length())]
    for h in hashes:
        carry = h
        for k, plane in enumerate(planes):
            planes[k], carry = plane ^ carry, plane & carry
    more, same = np.zeros_like(hashes[0]), np.full_like(hashes[0], ~np.uint64(0))
    for k in range(len(planes) - 1, -1, -1):
        digit = ~np.uint64(0) if len(hashes) // 2 >> k & 1 else np.uint64(0)
        more |= same & planes[k] & ~digit
        same &= ~(planes[k] ^ digit)
    return more


def simhash_blocks(line: np.ndarray, hashes: np.ndarray, size: np.ndarray, n_lines: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, SimHash block) from the words of n_lines lines: line by line their hashes and sizes; frequent is sorted."""
    share = ((hashes >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    rank = (-np.log(share) / np.minimum(size, 12)).astype(np.float32).view(np.uint32).astype(np.uint64)
    order = np.argsort((line.astype(np.uint64) << np.uint64(32)) | rank, kind="stable")
    line, hashes, size = line[order], hashes[order], size[order]
    fresh = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])) if len(line) else np.zeros(0, bool)
    line, hashes, size = line[fresh], hashes[fresh], size[fresh]
    owners, blocks = [], []

    def send(of: np.ndarray, value: np.ndarray, salt: int) -> None:
        owners.append(of)
        blocks.append(packed.mix(value ^ np.uint64(salt)))

    def table(use: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first words in use of each line, most at most, by hash; their sizes; how many."""
        of, h, s = line[use], hashes[use], size[use]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        of, h, s, nth = (x[nth < most] for x in (of, h, s, nth))
        words, sizes = np.zeros((n_lines, most), np.uint64), np.zeros((n_lines, most), np.int64)
        words[of, nth], sizes[of, nth] = h, s
        order = np.argsort(words, axis=1)  # what is missing comes first
        return np.take_along_axis(words, order, 1), np.take_along_axis(sizes, order, 1), np.bincount(of, minlength=n_lines)

    anchor = size >= LONG
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        anchor &= frequent[at] != hashes
    distinct = np.bincount(line, minlength=n_lines)
    use = np.flatnonzero(anchor)
    # too few anchors for a block, or just enough for one: the line's other words come after them
    bare = ((np.bincount(line[use], minlength=n_lines) <= PART) & (distinct > FEW))[line]
    if bare.any():
        own = np.flatnonzero(bare)
        use = np.concatenate([np.flatnonzero(anchor & ~bare), own[np.lexsort((~anchor[own], line[own]))]])
        use = use[np.argsort(line[use], kind="stable")]
    words, _, count = table(use, ANCHORS)
    for part in combinations(range(ANCHORS), PART):
        of = np.flatnonzero(count >= ANCHORS - part[0])
        send(of, simhash(*(words[of, k] for k in part)), 1)
    short = (distinct <= FEW)[line]
    words, sizes, count = table(short, FEW)
    total = sizes.sum(axis=1)
    for n in range(1, FEW + 1):
        of = np.flatnonzero((count == n) & (distinct == n))
        own = [words[of, FEW - n + k] for k in range(n)]
        send(of, simhash(*own, *([packed.mix(own[0])] if n % 2 == 0 else [])), 2 + n)
        for k in range(n if n > SEVERAL else 0):
            rest = [x for j, x in enumerate(own) if j != k]
            # one word may be another one only if what stays is most of the line
            use = (total[of] - sizes[of, FEW - n + k] >= LEAST) & (2 * sizes[of, FEW - n + k] <= total[of])
            send(of[use], simhash(*rest, *([packed.mix(rest[0])] if n % 2 else []))[use], 2 + n - 1)
    return np.concatenate(owners), np.concatenate(blocks)


def blocks_of_lines(lines: list[bytes], frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(line, SimHash block) of normalised lines."""
    words = Words(b"\n".join(lines) + b"\n")
    return simhash_blocks(words.line, words.hash, words.end - words.start, len(lines), np.zeros(0, np.uint64) if frequent is None else frequent)


def edit_distances(text: bytes, others: list[bytes], percent: int = 0) -> list[int]:
    """Levenshtein distances of text to other lines.

    A column of the table at a time, as bits that tell where its values rise
    and fall; the columns of the others lie side by side in one number, a bit
    of nought between them, so that all of them are done together. With
    percent, when few of them can still have that similarity, these begin anew
    alone; the others get what their distances are at least.
    """
    starts, at = [], 0
    for other in others:
        starts.append(at)
        at += len(other) + 1
    raw = np.frombuffer(b"\0".join(others), np.uint8)
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, first = number(raw != 0), sum(1 << k for k, other in zip(starts, others) if other)  # noqa: B905
    equal = {c: number(raw == c) for c in set(text)}
    up, down, size = full, 0, len(text)
    part = lambda v, k, n: (v >> k & (1 << n) - 1).bit_count()
    every = max(40, size // 5)
    for a in range(0, size, every):
        for c in text[a : a + every]:
            here = equal[c]
            x = here | down
            d = (((here & up) + up ^ up) | x) & full
            rise = (down | (full ^ (d | up))) << 1 & full | first
            fall = (up & d) << 1 & full
            up, down = fall | (full ^ (x | rise)), rise & x
        # the last column is 1 away from this one for each byte that is left, at most
        done = min(size, a + every)
        if percent and done < size:
            least = [2 * done - size + part(up, k, len(x)) - part(down, k, len(x)) for k, x in zip(starts, others)]  # noqa: B905
            live = [k for k, (v, x) in enumerate(zip(least, others)) if 100 * v <= (100 - percent) * max(size, len(x))]  # noqa: B905
            if len(live) < 0.4 * len(others):
                for k, d in zip(live, edit_distances(text, [others[k] for k in live], percent) if live else []):  # noqa: B905
                    least[k] = d
                return least
    return [size + part(up, k, len(x)) - part(down, k, len(x)) for k, x in zip(starts, others)]  # noqa: B905


def edit_distance(a: bytes, b: bytes, percent: int = 0) -> int:
    """Levenshtein distance in bytes, after what both begin and end with; with percent any number beyond it if they are less alike."""
    longer = max(len(a), len(b))
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[i:], b[i:]
    j = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    # what was cut off may count as well: the limit is that of the whole lines
    few = 100 - (100 - percent) * longer // max(len(a), len(b)) if percent else 0
    return edit_distances(a, [b], max(0, few - 1))[0]


def replaced(a: bytes, b: bytes) -> int | None:
    """The cost of replacing the words that differ, a bound of the distance; None for other numbers of words."""
    x, y = a.split(b" "), b.split(b" ")
    return sum(max(len(v), len(w)) for v, w in zip(x, y) if v != w) if len(x) == len(y) else None  # noqa: B905


def aligned(a: bytes, b: bytes) -> int:
    """The cost of keeping a longest common subsequence of words and replacing what lies between them, a bound of the distance."""
    x, y, at, before = a.split(b" "), b.split(b" "), {}, []
    # what both begin and end with needs no search
    k = next((k for k, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))  # noqa: B905
    x, y = x[k:], y[k:]
    k = next((k for k, (v, w) in enumerate(zip(reversed(x), reversed(y))) if v != w), min(len(x), len(y)))  # noqa: B905
    x, y = x[: len(x) - k], y[: len(y) - k]
    for j, w in enumerate(y):
        at[w] = at.get(w, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for w in x:
        before.append(v)
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
    before.append(v)
    # backwards: a bit of nought tells that the common subsequence grows with that word of y
    i, j, cost, gaps = len(x), len(y), 0, [0, 0]
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            cost, gaps, i, j = cost + max(gaps), [0, 0], i - 1, j - 1
        elif j and (not i or before[i] >> j - 1 & 1):
            j -= 1
            gaps[1] += len(y[j]) + 1
        else:
            i -= 1
            gaps[0] += len(x[i]) + 1
    return cost + max(gaps)


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether the edit similarity, 1 - distance / longer length, is percent at least."""
    most = (100 - percent) * max(len(a), len(b))
    way = replaced(a, b)
    return way is not None and 100 * way <= most or 100 * abs(len(a) - len(b)) <= most and 100 * edit_distance(a, b, percent) <= most


def near_ones(lines: list[bytes], x: int, others: list[int], percent: int, likely: set[int] | None = None) -> list[int]:
    """Those of others whose edit similarity with line x, 1 - distance / longer length, is percent at least; likely ones are aligned by words first."""
    near = lambda y, d: 100 * d <= (100 - percent) * max(len(lines[x]), len(lines[y]))
    # words that are replaced settle most; the distances of the others come together
    blanks = lines[x].count(b" ")
    found = [y for y in others if lines[y].count(b" ") == blanks and near(y, replaced(lines[x], lines[y])) or likely and y in likely and near(y, aligned(lines[x], lines[y]))]
    met = set(found)
    left = [y for y in others if y not in met]
    if len(left) == 1:
        return found + [y for y in left if similar(lines[x], lines[y], percent)]
    at = np.cumsum([len(lines[y]) for y in left]) // LANE_BITS if left else np.zeros(0, np.int64)
    for k in np.unique(at).tolist():
        some = [y for y, c in zip(left, at.tolist()) if c == k]  # noqa: B905
        found += [y for y, d in zip(some, edit_distances(lines[x], [lines[y] for y in some], percent)) if near(y, d)]  # noqa: B905
    return found


def link_lines(lines: list[bytes], percent: int, group: np.ndarray, sims: list[np.ndarray], apart: np.ndarray | None = None) -> np.ndarray:
    """The connected group of each line, as the index of its first, among those of its group that share a SimHash block with it.

    Where apart is given, lines with the same mark of 0 or more aren't
    compared: another task does it.

    Lines that share most blocks go first: what is joined with one of them by
    then isn't compared again, so near copies cost about one comparison each.
    An edit changes four 4-grams at most, so lines whose counts of 4-grams
    differ by more aren't compared, nor are those whose counts of bytes differ
    by more than the edits may be.
    """
    n, root, size = len(lines), np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines))
    owner, blocks = np.repeat(np.arange(n), [len(x) for x in sims]), np.concatenate(sims)
    order = np.lexsort((blocks, group[owner]))
    owner, blocks = owner[order], blocks[order]
    new = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (group[owner[1:]] != group[owner[:-1]])))
    times = np.diff(np.append(new, len(owner)))
    of_key = np.repeat(np.arange(len(new)), times)
    weight = np.bincount(owner, weights=times[of_key] - 1, minlength=n)
    by_line = np.argsort(owner, kind="stable")
    low, high = new[of_key[by_line]], (new + times)[of_key[by_line]]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    starts = ends - np.bincount(owner, minlength=n)
    todo, grams, letters_of = weight > 0, {}, {}

    def gram_counts(k: int) -> np.ndarray:
        if k not in grams:
            raw = np.frombuffer(lines[k], np.uint8).astype(np.uint32)
            grams[k] = np.bincount((raw[:-3] * 7919 + raw[1:-2] * 1009 + raw[2:-1] * 97 + raw[3:]) % BINS, minlength=BINS).astype(np.int16 if len(raw) < 1 << 14 else np.int32)
        return grams[k]

    def byte_counts(k: int) -> np.ndarray:
        if k not in letters_of:
            letters_of[k] = np.bincount(np.frombuffer(lines[k], np.uint8), minlength=256)
        return letters_of[k]

    def edits(counts: Callable[[int], np.ndarray], x: int, z: np.ndarray) -> np.ndarray:
        """How many counts of x must go, or come, to make those of each of z."""
        differ = np.stack([counts(k) for k in z.tolist()]) - counts(x)
        more = np.maximum(differ, 0).sum(1, dtype=np.int64)
        return np.maximum(more, more - differ.sum(1, dtype=np.int64))

    at = -1
    for x in np.lexsort((-weight, group)).tolist():
        if not todo[x]:
            continue
        if group[x] != at:
            at = group[x]
            grams.clear()
            letters_of.clear()
        todo[x] = False
        spans = sorted(set(zip(low[starts[x] : ends[x]].tolist(), high[starts[x] : ends[x]].tolist())))  # noqa: B905
        z = np.unique(np.concatenate([owner[a:b] for a, b in spans]))
        z = z[todo[z] & (root[z] != root[x]) & (np.minimum(size[z], size[x]) * 100 >= percent * np.maximum(size[z], size[x]))]
        if apart is not None:
            z = z[(apart[z] != apart[x]) | (apart[z] < 0)]
        if not len(z):
            continue
        most, changed = (100 - percent) * np.maximum(size[z], size[x]), 100 * edits(gram_counts, x, z)
        likely = set(z[changed <= LIKELY * 4 * most].tolist())
        z, most = z[changed <= 4 * most], most[changed <= 4 * most]
        z = z[100 * edits(byte_counts, x, z) <= most] if len(z) else z
        for y in near_ones(lines, x, z.tolist(), percent, likely) if len(z) else []:
            a, b = sorted((root[x], root[y]))
            if a != b:
                root[root == b] = a
    return root


class Lines:
    """The lines of a block that have letters or digits, and what a block sends and learns about them."""

    def __init__(self, row: dict) -> None:
        self.block, self.ids = int(row["block"]), packed.ids_of(row)
        raw, at, texts = packed.unpack(row["data"]), 0, []
        for n in np.asarray(row["lens"]).tolist():
            texts.append(raw[at : at + n])
            at += n
        self.folded = (b"\n".join(texts) + b"\n").translate(FOLD)
        self.words = Words(self.folded)
        self.number, self.one, two = self.words.lines()
        # lines by document: a line feed ends each
        firsts = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
        self.place = (np.searchsorted(firsts, self.number, side="right") - 1).astype(np.int32)
        self.nth = (self.number - firsts[self.place]).astype(np.int32)
        self.keys = np.stack([self.one, two], axis=1) if len(self.one) else np.zeros((0, 2), np.uint64)
        # the first of equal lines stands for them
        self.value, self.first, self.of, self.times = np.unique(self.one, return_index=True, return_inverse=True, return_counts=True)
        self.choice = two[self.first]

    def send(self, buckets: int, frequent: np.ndarray) -> list[tuple]:
        """Fingerprints of the distinct lines, and of the SimHash blocks with the lines that own them."""
        w = self.words
        standing = np.full(len(w.feeds), -1)
        standing[self.number[self.first]] = np.arange(len(self.first))
        of = standing[w.line]
        use = np.flatnonzero(of >= 0)
        line, sim = simhash_blocks(of[use], w.hash[use], (w.end - w.start)[use], len(self.first), frequent)
        return [*packed.send(self.block, 0, self.value, self.choice, buckets, 8), *packed.send_owned(self.block, 1, sim, line, buckets)]

    def text(self, k: int) -> bytes:
        """Line k, normalised."""
        n = int(self.number[k])
        return b" ".join(self.folded[int(self.words.feeds[n - 1]) + 1 if n else 0 : int(self.words.feeds[n])].split())

    def listed(self, flags: pd.DataFrame, buckets: int) -> tuple[np.ndarray, pa.Array]:
        """The lines that occur more often or may have a near one, and the shared SimHash blocks of the latter by the blocks' leads; null for copies."""
        copies = packed.received(flags, 0, self.choice, buckets)
        line, sim, lead = packed.received_owned(flags, 1)
        use = copies[line] != 1
        order = np.lexsort((lead[use], line[use]))
        line, sim, lead = line[use][order], sim[use][order].view(np.int64), lead[use][order].view(np.int64)
        new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (lead[1:] != lead[:-1]))) if len(line) else np.zeros(0, np.int64)
        ends = np.searchsorted(line[new], np.arange(len(self.first) + 1))
        near = np.diff(ends) > 0
        wanted = np.flatnonzero(((copies > 0) | (self.times > 1) | near)[self.of])
        stands = (self.first[self.of[wanted]] == wanted) & near[self.of[wanted]]
        sims = pa.ListArray.from_arrays(pa.array(np.append(new, len(line)), pa.int32()), pa.array(sim))
        parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(lead[new]), sims], ["lead", "sims"]))
        return wanted, parts.take(pa.array(self.of[wanted], pa.int64(), mask=~stands))


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) that connect what nodes and their lists of hubs do within a batch, each node with one b: fewer edges, the same components."""
    workers.enter("blocks")
    for batch in batches:
        hubs = batch.column("hubs")
        kind = batch.column("node").type
        ends = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.asarray(hubs.value_lengths()))
        nodes, of = np.unique(np.concatenate([ends, hubs.flatten().to_numpy(zero_copy_only=False)]), return_inverse=True)
        root = np.arange(len(nodes))
        a, b = of[: len(ends)], of[len(ends) :]
        while len(a):
            # the larger root takes the smaller one, then paths are halved until they end
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while not np.array_equal(root, root[root]):
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        use = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[use], kind), pa.array(nodes[root[use]], kind)], ["a", "b"])


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sorted hashes of words that are too frequent for anchors, as so many of them would meet by chance, and the bytes of all texts.

    With n lines a word is frequent if it occurs more than
    n / (blocks of a line * n) ** (1 / PART) times, MOST * n at most and
    RARE_LINES at least; so there are no more than a line's words times 3.3
    times the cube root of n. Each task sends the words that occur eight times.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("blocks")
        held, n_lines, n_bytes, counted = [], 0, 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def merge() -> tuple[np.ndarray, np.ndarray]:
            words, of = np.unique(np.concatenate([counted[0], *(w for w, _ in held)]), return_inverse=True)
            held_counts = np.concatenate([counted[1], *(c for _, c in held)])
            held.clear()
            return words, np.bincount(of, weights=held_counts, minlength=len(words)).astype(np.int64)

        for batch in batches:
            texts, k = batch.column("text").cast(pa.binary()).to_pylist(), 0
            while k < len(texts):
                some, size = [], 0
                while k < len(texts) and (not some or size < packed.BLOCK_BYTES):
                    some.append(texts[k])
                    size += len(texts[k])
                    k += 1
                words = Words((b"\n".join(some) + b"\n").translate(FOLD))
                n_lines += len(np.unique(words.line))
                n_bytes += size
                held.append(np.unique(words.hash, return_counts=True))
                if sum(len(w) for w, _ in held) > 2_000_000:
                    counted = merge()
        counted = merge()
        use = counted[1] >= 8
        yield pa.RecordBatch.from_arrays([pa.array(np.append(counted[0][use].view(np.int64), [0, 1])), pa.array(np.append(counted[1][use], [n_lines, n_bytes])), pa.array(np.append(np.zeros(use.sum(), bool), [True, True]))], ["word", "n", "total"])

    counts = docs.filter("text is not null").select("text").mapInArrow(count, "word bigint, n bigint, total boolean").groupBy("total", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("total") | (F.col("n") > RARE_LINES)))
    totals = {r.word: r.n for r in counts.filter("total").collect()}
    n = totals.get(0) or 1
    blocks = ANCHORS * (ANCHORS - 1) * (ANCHORS - 2) // 6
    least = max(RARE_LINES, min(MOST, (blocks * n) ** (-1 / PART)) * n)
    words = np.sort(np.array([r.word for r in counts.filter((~F.col("total")) & (F.col("n") > least)).select("word").collect()], np.int64).view(np.uint64))
    return words, totals.get(1, 0)


def fuzzy_duplicates(docs: DataFrame, total: int, frequent: np.ndarray, percent: int = 80) -> DataFrame:
    """(block, place, line) of the lines that aren't the first of their connected group, blocks being those that carry; total is the bytes of text.

    Lines are linked if they are equal when normalised, or if they share a
    SimHash block and their edit similarity is percent or more. The first is that of the smallest doc_id (nulls last),
    then block, place and line. Lines without letters or digits belong to no
    group.
    """
    buckets = packed.bucket_count(total / BYTES_A_KEY)
    blocks = packed.pack_blocks(docs, carry=True).drop("rest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("blocks")
        for batch in batches:
            for row in batch.to_pylist():
                yield packed.sent_batch(Lines(row).send(buckets, frequent))

    def wanted(left: pa.Table, flags: pa.Table) -> pa.Table:
        workers.enter("blocks")
        out = []
        for row in left.to_pylist():
            t = Lines(row)
            at, parts = t.listed(flags.to_pandas(), buckets)
            ids = t.ids.take(t.place[at])
            keys = t.keys[at]
            columns = [pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(ids, pa.int64(), from_pandas=True), pa.array(np.full(len(at), t.block)), pa.array(t.place[at]), pa.array(t.nth[at]), parts, pa.array([t.text(k) if near else None for k, near in zip(at.tolist(), parts.is_valid().to_pylist())], pa.binary())]  # noqa: B905
            out.append(pa.Table.from_arrays(columns, ["key", "doc_id", "block", "place", "line", "parts", "text"]))
        return pa.concat_tables(out)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        return packed.shared(rows) if rows["round"].iloc[0] else packed.judged(rows, 8, packed.repeated_or_first)

    ranks = packed.pack_blocks(docs, carry=True, run=scan, kind=packed.SENT).groupBy("round", "bucket").applyInPandas(answer, packed.FLAGS)
    listed = cut(blocks.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(wanted, "key binary, doc_id bigint, block bigint, place int, line int, parts array<struct<lead:bigint,sims:array<bigint>>>, text binary"))
    # what a lead's number merges by chance is told apart by the blocks
    texts = listed.filter("parts is not null").select("key", "text", "parts")
    sizes = cut(texts.select(F.length("text").alias("bytes"), F.explode("parts.lead").alias("lead")).groupBy("lead").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    groups = int((sizes.agg(F.sum("bytes")).first()[0] or 0) / GROUP_BYTES) + 1
    # at most one lead in SHARE_LINES rows is that large, so they may be broadcast
    large = sizes.select("lead", F.greatest(F.ceil(F.col("n") / SHARE_LINES), F.ceil(F.col("bytes") / SHARE_BYTES)).cast("int").alias("m")).filter("m > 1")
    held = texts.select("key", "text", F.explode("parts").alias("part")).select("key", "text", "part.lead", "part.sims").join(F.broadcast(large), "lead", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("m")).cast("int")
    held = held.select("lead", "key", "text", "sims", "m", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    dealt = held.select("lead", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "key", "m", "text", "sims")
    # small leads go to a task together, a pair of shares alone
    task = F.when(F.col("m") == 1, F.pmod(F.xxhash64("lead"), F.lit(groups))).otherwise(F.xxhash64("lead", "i", "j"))
    tasks = dealt.withColumn("task", task).drop("m").repartition(groups, "task")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        workers.enter("blocks")
        # a line whose block only its own copies have meets nobody
        rows = rows[rows.duplicated(["lead", "i", "j"], keep=False)]
        if rows.empty:
            return pd.DataFrame({"a": [], "b": []})
        rows = rows.assign(n=rows["text"].map(len)).sort_values(["lead", "i", "j", "n", "key"])
        keys = rows["key"].to_numpy()
        group = np.cumsum((rows[["lead", "i", "j"]].diff() != 0).any(axis=1).to_numpy())
        apart = np.where(rows["i"] != rows["j"], rows["own"], -1)
        first = link_lines(rows["text"].tolist(), percent, group, rows["sims"].tolist(), apart)
        linked = first != np.arange(len(rows))
        return pd.DataFrame({"a": keys[linked], "b": keys[first][linked]})

    links = cut(tasks.groupBy("task").applyInPandas(verify, "a binary, b binary"))
    linked = components(links.select(F.col("a").alias("node"), F.array("b").alias("hubs")).mapInArrow(stars, "a binary, b binary")).filter("node <> root").select(F.col("node").alias("key"), "root")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "block", "place", "line")
    rooted = listed.select(at.alias("at"), "key").join(linked, "key", "left").select("at", F.coalesce("root", "key").alias("root"))
    # firsts are written, so that the join can split the rows of a common line
    firsts = cut(rooted.groupBy("root").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return rooted.join(firsts, "root").filter(F.col("at") != F.col("first")).select("at.block", "at.place", "at.line")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with text rid of lines that aren't the first of their group, and n_lines and removed (array of line numbers) added.

    Lines end at line feeds. One occurrence of each group stays, in the
    document of the smallest id. Null texts stay null and have no lines, nor
    have empty ones; all rows and other columns stay as they are; columns
    named n_lines or removed are replaced. Of repeated rows one keeps its
    lines.
    """
    docs = docs.drop("n_lines", "removed")
    blocks = packed.pack_blocks(docs, carry=True)
    frequent, total = frequent_words(docs)
    gone = fuzzy_duplicates(docs, total, frequent, percent)

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        workers.enter("blocks")
        drop: dict[int, set[int]] = {}
        for place, line in zip(right["place"].to_pylist(), right["line"].to_pylist()):  # noqa: B905
            drop.setdefault(place, set()).add(line)
        out = []
        for row in left.drop_columns("rest").to_pylist():
            raw, at, texts, counts = packed.unpack(row["data"]), 0, [], []
            for place, n in enumerate(row["lens"]):
                lines = raw[at : at + n].split(b"\n") if n else []
                at += n
                gone = drop.get(place, ())
                texts.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else raw[at - n : at])
                counts.append(len(lines))
            removed = [sorted(drop.get(place, ())) for place in range(len(texts))]
            out.append([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.int32()))])
        rest = left["rest"].combine_chunks().flatten()
        return pa.Table.from_arrays([*(pa.chunked_array(x) for x in zip(*out)), rest], ["text", "n_lines", "removed", "rest"])  # noqa: B905

    fields = StructType().add("text", "string").add("n_lines", "long").add("removed", ArrayType(IntegerType())).add("rest", blocks.schema["rest"].dataType.elementType)
    done = blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(strip, fields)
    return packed.unpack_rest(done, docs, "n_lines", "removed")


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): n_lines, n_removed, the removed lines' numbers and kept_sha256 of what stays."""
    done = dedup_lines(docs.select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), sha.alias("kept_sha256"))
