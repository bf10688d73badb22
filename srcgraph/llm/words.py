"""Words, lines and hashes of whole text batches as NumPy arrays.

Texts stay in the Arrow buffer; words are byte spans in it.  Hashes are 64-bit
polynomial sums over a random byte table, computed by prefix sums and mixed at
the end, so no Python runs per word.  Null texts count as empty.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes handled at once; a longer single text is one slice.
SLICE_BYTES = 2 << 20
U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
TABLE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = TABLE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        held = _powers[base] = (both[0], both[1])
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[s:e] for each span, not yet mixed."""
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, U)
    total[0] = 0
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Texts:
    """A slice of texts: bytes, text bounds, and words found on demand."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        self._words = None

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text."""
        if self._words is None:
            inside = ~SPACE[self.data]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = self.bounds[1:] > self.bounds[:-1]
            a, z = self.bounds[:-1][full], self.bounds[1:][full] - 1
            first[a], last[z] = inside[a], inside[z]
            starts = np.flatnonzero(first)
            self._words = starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.bounds)
        return self._words

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        starts, ends, _ = self.words
        sums = span_sums((LOWER_TABLE if lower else TABLE)[self.data], BASE, starts, ends)
        return mix(sums + (ends - starts).astype(U) * U(0xA0761D6478BD642F))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Number of set byte flags per text."""
        return prefix(flags)[self.bounds[1:]] - prefix(flags)[self.bounds[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the ``\\n``-split lines that have a word, and the first line of each text."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, self.bounds[1:]]))
        seen = prefix(~SPACE[self.data])
        keep = seen[ends] > seen[starts]
        starts, ends = starts[keep], ends[keep]
        return starts, ends, np.searchsorted(starts, self.bounds)


PART = np.zeros(256, bool)
PART[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


class Runs(Texts):
    """Texts whose words are runs of digits, lower-case letters and characters beyond ASCII."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(np.where(PART[data], data, np.uint8(32)), bounds)


def prefix(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The hashes that ``word_hashes`` gives these words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    return mix(span_sums(TABLE[data], BASE, starts, ends) + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each item, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start item and mixed hash of every run of ``k`` items within a text."""
    if len(hashes) < k:
        return np.empty(0, np.int64), np.empty(0, U)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + k <= last)
    return at, mix(span_sums(hashes, STEP, at, at + k) + U(k))


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a string column with their texts, a bounded number of bytes and rows at a time."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    bounds = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
        end = min(end, len(column), begin + rows)
        yield begin, end, Texts(data[bounds[begin]:bounds[end]], bounds[begin:end + 1] - bounds[begin])
        begin = end
