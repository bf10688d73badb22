"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits of the lower-cased text; a shingle is five
of them (the whole item if it is shorter).  Every window of a document that is
as long as a benchmark item and shares a shingle with it gets a 64-bit SimHash;
windows without a common shingle have similarity 0 and need none.  A
multi-index over blocks of the fingerprint, one block more than the radius,
finds every item fingerprint within the radius: equal in all but ``RADIUS``
bits means equal in at least one block.  Where rare shingles changed, similar
windows lie outside the radius, so those that can reach the similarity by the
weight of the shingles they share go on as well.  Weighted shingle similarity
(sum of minima over sum of maxima of term frequency times the item-side rarity
weight) then decides, exactly: no window at or over it is lost.

The benchmark table goes to the workers only below ``MAX_ITEM_BYTES`` a chunk;
a larger one is taken in chunks, one pass over the documents each.  Rarity
weights are those of the whole benchmark whatever the chunks; a shingle of one
item or none has the largest, so only repeated ones are sent.  Null and
empty items and texts match nothing.  Items of equal text are all reported, as
are repeated rows; of equally similar windows the first is named.
"""
from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut, map_arrow
from srcgraph.llm.words import STEP, Runs, Texts, U, hashes_of, mix, slices, windows

SHINGLE = 5
RADIUS = 20
SIMILARITY = 0.8
MAX_ITEM_BYTES = 16 << 20
BLOCK = 1 << 14
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingled(texts: pa.Array):
    """(number of words, shingle length, shingles) of each text; None without words."""
    # the documents' lower case, which is not Python's for every character
    for text in pc.utf8_lower(texts).to_pylist():
        words = [w.encode() for w in TOKEN.findall(text)]
        if not words:
            yield None
            continue
        h = hashes_of(words)
        k = min(SHINGLE, len(h))
        yield len(h), k, windows(h, np.array([0, len(h)]), k)[1]


class Items:
    """Benchmark items ready for look-up; ``counts`` has the items and the repeated shingles of the benchmark they are part of."""

    def __init__(self, rows: list[tuple[int, str]], radius: int = RADIUS, counts: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.radius = radius
        self.items = []
        rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        for (item, _), found in zip(rows, shingled(pa.array([r[1] for r in rows], pa.large_string()))):
            if found:
                self.items.append((item, *found))
        if counts is None:
            each = [np.unique(grams) for _, _, _, grams in self.items]
            counts = len(each), *np.unique(np.concatenate([np.empty(0, U), *each]), return_counts=True)
        n = max(1, counts[0])
        self.known, self.weight = counts[1], 1 + np.log(n / counts[2])
        self.rare = 1 + math.log(n)
        pairs = sorted((g, i, o) for i, (_, _, _, grams) in enumerate(self.items) for o, g in enumerate(grams.tolist()))
        self.sizes = sorted({k for _, _, k, _ in self.items})
        self.keys = np.array([p[0] for p in pairs], U)
        self.of_item = np.array([p[1] for p in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> U(44)).astype(np.int64)] = True
        self.prints = np.array([self.fingerprints(g, len(g))[0] for _, _, _, g in self.items], U) if self.items else np.empty(0, U)
        # radius + 1 blocks of bits; per block, items by value
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(U(a), U((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.index = []
        for shift, mask in self.blocks:
            value = (self.prints >> shift) & mask
            self.index.append({v: set(np.flatnonzero(value == v).tolist()) for v in np.unique(value).tolist()})

    def weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(grams), self.rare)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, self.weight[at], self.rare)

    def fingerprints(self, grams: np.ndarray, length: int) -> np.ndarray:
        """SimHash of every run of ``length`` shingles: signs of weighted bit sums, by prefix sums."""
        bits = ((mix(grams ^ U(STEP))[:, None] >> np.arange(64, dtype=U)) & U(1)).astype(np.int8)
        weight = self.weights(grams)
        total = np.zeros((len(grams) + 1, 64))
        np.cumsum((2.0 * bits - 1) * weight[:, None], axis=0, out=total[1:])
        positive = (total[length:] - total[:-length]) > 1e-9
        return (positive.astype(U) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)

    def near(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Which fingerprints share a block with the item's and lie within the radius."""
        candidate = np.zeros(len(prints), bool)
        for (shift, mask), table in zip(self.blocks, self.index):
            for value in np.unique((prints >> shift) & mask).tolist():
                if item in table.get(value, ()):
                    candidate |= ((prints >> shift) & mask) == value
        return candidate & (self.distance(prints, item) <= self.radius)

    def reach(self, grams: np.ndarray, item: int, similarity: float) -> np.ndarray:
        """Which windows of the item's length may have the similarity: at most all shingles that the item holds count as shared."""
        own = self.items[item][3]
        weight, m = self.weights(grams), len(own)

        def sums(x):
            total = np.concatenate([[0.0], np.cumsum(x)])
            return total[m:] - total[:-m]
        mine = self.weights(own).sum()
        shared = np.minimum(sums(np.where(np.isin(grams, own), weight, 0.0)), mine)
        return shared >= similarity * (mine + sums(weight) - shared) - 1e-6

    def distance(self, prints: np.ndarray, item: int) -> np.ndarray:
        return np.bitwise_count(prints ^ self.prints[item]).astype(int)

    def similarity(self, window: list[int], item: int) -> float:
        one, two = Counter(window), Counter(self.items[item][3].tolist())
        both = list(one.keys() | two.keys())
        w = dict(zip(both, self.weights(np.array(both, U)).tolist()))
        low = math.fsum(w[g] * min(c, two[g]) for g, c in one.items() if g in two)
        high = math.fsum(w[g] * max(one[g], two[g]) for g in both)
        return low / high

    def matches(self, hashes: np.ndarray, hits: np.ndarray, item: int, similarity: float) -> list[tuple[int, int, float]]:
        """Windows (start, hamming, similarity) at or over the similarity that do not overlap, the best first taken, of equal ones the first."""
        _, n, k, grams = self.items[item]
        m, out = len(grams), []
        hits = np.unique(hits)
        for run in np.split(hits, np.flatnonzero(np.diff(hits) >= n) + 1):
            first, last = max(0, int(run[0]) - m + 1), min(int(run[-1]), len(hashes) - n)
            found = []
            # a run may be as long as the text, its fingerprints are held for one block of windows
            for low in range(first, last + 1, BLOCK):
                high = min(low + BLOCK - 1, last)
                _, local = windows(hashes[low:high + n], np.array([0, high + n - low]), k)
                prints = self.fingerprints(local, m)
                distance = self.distance(prints, item)
                for i in np.flatnonzero(self.near(prints, item) | self.reach(local, item, similarity)).tolist():
                    s = self.similarity(local[i:i + m].tolist(), item)
                    if s >= similarity:
                        found.append((low + i, int(distance[i]), s))
            taken = []
            for start, gap, s in sorted(found, key=lambda x: (-x[2], x[0])):
                at = bisect.bisect(taken, start)
                if (at == 0 or start - taken[at - 1] >= n) and (at == len(taken) or taken[at] - start >= n):
                    taken.insert(at, start)
                    out.append((start, gap, s))
        return out

    def search(self, texts: Texts, similarity: float) -> list[tuple]:
        """(text, item, start, n, hamming, similarity) of a slice of texts."""
        first = texts.words[2]
        hashes = texts.word_hashes()
        out = []
        for k in self.sizes:
            at, grams = windows(hashes, first, k)
            some = np.flatnonzero(self.filter[(grams >> U(44)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, grams[some], "left"), np.searchsorted(self.keys, grams[some], "right")
            many = high - low
            which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            place, item = np.repeat(at[some], many), self.of_item[which]
            size = np.array([x[2] for x in self.items])
            place, item = place[size[item] == k], item[size[item] == k]
            text = np.searchsorted(first, place, "right") - 1
            order = np.lexsort((place, item, text))
            place, item, text = place[order], item[order], text[order]
            new = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
            for part in np.split(np.arange(len(place)), new) if len(place) else []:
                t, i = int(text[part[0]]), int(item[part[0]])
                base = first[t]
                for start, gap, s in self.matches(hashes[base:first[t + 1]], place[part] - base, i, similarity):
                    out.append((t, self.items[i][0], start, self.items[i][1], gap, s))
        return out


def chunks(benchmark: DataFrame, limit: int = MAX_ITEM_BYTES):
    """Item rows in bounded chunks: most benchmarks are one."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def repeated_shingles(benchmark: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of items with words, the shingles of two items or more, and how many items hold each."""
    def each(batch):
        found = [np.unique(x[2]) for x in shingled(batch.column(0)) if x]
        if found:
            # one null per item, so that the same count tells the number of items
            yield pa.record_batch([pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(np.concatenate(found).view(np.int64))])], ["gram"])

    counts = (map_arrow(benchmark.where("text IS NOT NULL").select("text"), each, "gram long").groupBy("gram").count()
              .where("gram IS NULL OR count > 1").toArrow())
    items = pc.is_null(counts["gram"])
    total = pc.sum(counts["count"].filter(items)).as_py() or 0
    counts = counts.filter(pc.invert(items))
    gram, many = counts["gram"].to_numpy().view(U), counts["count"].to_numpy()
    order = np.argsort(gram)
    return total, gram[order], many[order]


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS,
          limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row per document, item and place: windows that do not overlap, the most similar taken first."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    counts = repeated_shingles(benchmark)
    for rows in chunks(benchmark, limit):
        items = Items(rows, radius, counts)
        if not items.items:
            continue

        def find(batch, items=items):
            for a, b, texts in slices(pc.utf8_lower(pc.fill_null(batch.column(1), ""))):
                found = items.search(Runs(texts.data, texts.bounds), similarity)
                if found:
                    ids = batch.column(0).slice(a, b - a).cast(pa.int64())
                    text, item, start, n, gap, s = zip(*found)
                    yield pa.record_batch(
                        [ids.take(pa.array(text)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                         pa.array(gap, pa.int32()), pa.array(s, pa.float64())],
                        ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])
        # written at once, so that the driver holds one chunk's index at a time
        out = out.unionByName(cut(map_arrow(docs.select("doc_id", "text"), find, SCHEMA))[0])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_ids, n_places, similarity): documents that hold a benchmark item."""
    return leaks(docs, benchmark).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_places"),
        F.max("similarity").alias("similarity"))
