"""Windows of a fixed number of items (words or bytes) that also start in an earlier document.

Every window names an anchor: its run of ``gram`` items with the least hash.
Equal windows name equal anchors, so only texts that share an anchor are ever
compared.  The windows that name the same anchor occurrence form a segment.

1. Each task finds the segments of its texts.  Segments with equal content are
   settled on the spot: all but those of the least document repeat it.  One
   entry per anchor and task goes on to the task that owns the anchor's hash,
   where the same rule is applied over all tasks.
2. An anchor with segments of different content (the ends of a shared passage)
   is open: the windows of its segments are compared one by one in the same
   way, first within a task, then by the owner of the window's hash.

An anchor or window that a third of all documents share so sends one entry per
task, and nothing is gathered by document group.  Entries travel packed in
NumPy arrays, a few bytes each.  The result is exact up to equal hashes of
different content (more than 70 bits for segments, 64 for windows).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut, parts
from srcgraph.llm.words import STEP, Texts, U, mix, powers, slices

PLACE_BITS = U(28)
FLUSH = 1_000_000
SHARE = 200_000  # entries an owner settles at a time
ASK, DONE, OPEN = 0, 1, 2
ROWS = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["bucket", "kind", "a", "b", "c", "d", "e"]
FOUND = "doc_id long, kind int, spans binary"


class Hasher:
    """Hashes of any spans of a sequence from one array of prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(STEP, len(values) + 1)
        self.total = np.empty(len(values) + 1, U)
        self.total[0] = 0
        np.cumsum(values * up[:-1], out=self.total[1:])

    def of(self, starts, ends) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (np.asarray(ends) - starts).astype(U))


def segments(hasher: Hasher, first: np.ndarray, gram: int, window: int):
    """(anchor hash, content hash, text, start, windows) of each segment; starts count from the text's first item."""
    n = len(hasher.total) - 1
    if n < window:
        return [np.empty(0, t) for t in (U, U, np.int64, np.int64, np.int64)]
    at = np.arange(n - gram + 1)
    key = (hasher.of(at, at + gram) >> PLACE_BITS << PLACE_BITS) | at.astype(U)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        key[:-span] = np.minimum(key[:-span], key[span:])
        span *= 2
    least = np.minimum(key[:n - window + 1], key[width - span:width - span + n - window + 1])
    length = np.diff(first)
    fits = np.zeros(n + 1, np.int8)
    full = length >= window
    fits[first[:-1][full]] += 1
    fits[first[1:][full] - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(fits[:n - window + 1]))
    least = least[starts]
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(starts) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([begin, [len(starts)]]))
    start = starts[begin]
    place = (least[begin] & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    text = np.searchsorted(first, start, "right") - 1
    return [hasher.of(place, place + gram), hasher.of(start, start + count - 1 + window), text, start - first[text], count]


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs."""
    size = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    size = data[0]
    wide = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    return wide.reshape(-1).view("<u8").astype(U, copy=False).view(kind)


def as_docs(values: np.ndarray) -> np.ndarray:
    return values.view(U)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array([r[i] if i < len(r) else None for r in rows], t) for i, t in enumerate(kinds)], NAMES)


def joined(doc, start, count, source, source_start, keep_source: bool) -> list[np.ndarray]:
    """Spans sorted by document; spans that go on where the last one ended are one."""
    if not keep_source:
        source, source_start = np.zeros_like(doc), start
    shift = source_start - start
    order = np.lexsort((start, shift, source, doc))
    doc, start, count, source, shift = (x[order] for x in (doc, start, count, source, shift))
    end = start + count
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(end, head) if len(head) else end
    doc, start, source, shift = (x[head] for x in (doc, start, source, shift))
    return [doc, start, end - start] + ([source, start + shift] if keep_source else [])


def settle_segments(h, s, doc, start, count, flag):
    """Segments sorted by anchor and content: what repeats an earlier document, and what is left with its state.

    Returns (later, source, left, is_open, lead): positions of repeats and of
    what they repeat; positions left; whether each is open; whether it may
    speak for an open anchor.
    """
    order = np.lexsort((start, doc, s, h))
    h, s, doc = h[order], s[order], doc[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], s[1:] != s[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.flatnonzero(doc > doc[head])
    left = np.flatnonzero(doc == doc[head])
    anchor = np.cumsum(new_h) - 1
    a, d = anchor[left], doc[left]
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    several = np.add.reduceat(new[left].astype(int), edge) > 1
    mixed = several & (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge))
    # a repeat that goes may be the one that speaks for a task's other open segments
    mixed |= np.maximum.reduceat(flag[order].astype(int), np.flatnonzero(new_h)) > 0
    group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1
    is_open = mixed[group]
    # the entry of the least document speaks for its anchor
    rank = np.lexsort((d, group))
    lead = np.zeros(len(left), bool)
    lead[rank[np.searchsorted(group[rank], np.arange(len(edge)))]] = True
    return order[later], order[head[later]], order[left], is_open, lead


def settle_windows(h, doc, place):
    """(later, source, left): windows of a later document, the window they repeat, and the rest."""
    order = np.lexsort((place, doc, h))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later, left = np.flatnonzero(doc > doc[head]), np.flatnonzero(doc == doc[head])
    return order[later], order[head[later]], order[left]


def shares(h: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Positions in shares of about ``limit`` entries; entries of one hash are in one share."""
    n = -(-len(h) // limit)
    key = (mix(h.view(U)) % U(n)).astype(np.int32)
    order = np.argsort(key, kind="stable")
    edge = np.searchsorted(key[order], np.arange(n + 1))
    yield from (order[a:z] for a, z in zip(edge, edge[1:]) if a < z)


Items = Callable[[Texts], tuple[np.ndarray, np.ndarray]]


def repeated(docs: DataFrame, items: Items, gram: int, window: int, sources: bool = False,
             group_windows: Callable | None = None) -> DataFrame:
    """(doc_id, spans): windows that also start in a document with a smaller doc_id, in one or two rows per document.

    ``items`` gives the hash of every item of a slice of texts and each text's
    first item.  A span is a run of window starts (start, windows) and, with
    ``sources``, where the run starts in an earlier document (doc_id, start).
    ``group_windows`` may replace the way a task finds equal windows of its own
    open segments.
    """
    spark = docs.sparkSession
    buckets = parts(spark)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    kind_of = np.int64 if sources else np.int32
    width = 4 if sources else 2

    def to_owner(owner, kind, *columns) -> list[tuple]:
        order = np.argsort(owner, kind="stable")
        edge = np.searchsorted(owner[order], np.arange(buckets + 1))
        return [(p, kind, *(packed(c[i]) for c in columns)) for p in range(buckets) if len(i := order[edge[p]:edge[p + 1]])]

    def known(kind, *columns) -> list[tuple]:
        """Spans on their way to the task that gathers them by document."""
        doc, *rest = joined(*columns, sources)
        return to_owner(doc % buckets, kind, as_docs(doc), rest[0], rest[1], *map(as_docs, rest[2:]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = np.asarray(b.column(0))
            for low, high, part in slices(b.column(1)):
                values, first = items(part)
                h, s, text, start, count = segments(Hasher(values), first, gram, window)
                held.append((h, s, ids[low:high][text], start, count))
                size += len(h)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held) -> Iterator[pa.RecordBatch]:
        h, s, doc, start, count = (np.concatenate(x) for x in zip(*held))
        later, source, left, is_open, lead = settle_segments(h, s, doc, start, count, np.zeros(len(h), bool))
        rows = known(DONE, doc[later], start[later], count[later], doc[source], start[source])
        o = left[is_open]
        rows += known(OPEN, doc[o], start[o], count[o], doc[o], start[o])
        ask = lead | ~is_open
        i, flag = left[ask], is_open[ask].astype(np.int64)
        rows += to_owner(((h[i] >> U(40)) % U(buckets)).astype(np.int64), ASK, h[i] & U(0xFFFFFFFF), s[i] & U((1 << 40) - 1),
                         as_docs(doc[i]), start[i], count[i] * 2 + flag)
        yield batch(rows)

    def owners(settle):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = []
            for b in batches:
                asks = np.asarray(b.column(1)) == ASK
                for row in b.filter(pa.array(asks)).to_pylist():
                    asked.append([unpacked(row[c]) for c in "abcde" if row[c] is not None])
                if not asks.all():
                    yield b.filter(pa.array(~asks))
            if asked:
                columns = [np.concatenate(x) for x in zip(*asked)]
                asked.clear()
                for pick in shares(columns[0], SHARE):
                    yield batch([row for kind, found in settle(*(c[pick] for c in columns)) for row in known(kind, *found)])
        return run

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document and kind with all its spans."""
        held: dict[int, list] = {DONE: [], OPEN: []}
        for b in batches:
            for row in b.to_pylist():
                held[row["kind"]].append([unpacked(row[c]) for c in "abcde" if row[c] is not None])
        for kind, found in held.items():
            if not found:
                continue
            doc, start, count, *rest = (np.concatenate(x) for x in zip(*found))
            doc, *columns = joined(doc, start, count, *(rest or (doc, start)), sources)
            table = np.stack(columns, axis=1).astype(kind_of)
            edge = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), len(doc))
            for at in range(0, len(edge) - 1, 5000):
                part = edge[at:at + 5001]
                yield pa.record_batch([pa.array(doc[part[:-1]]), pa.array(np.full(len(part) - 1, kind, np.int32)),
                                       pa.array([table[a:z].tobytes() for a, z in zip(part[:-1], part[1:])], pa.binary())],
                                      ["doc_id", "kind", "spans"])

    def own_segments(h, s, doc, start, mixed_count):
        count, flag = mixed_count >> 1, (mixed_count & 1).astype(bool)
        later, source, left, is_open, _ = settle_segments(h, s, doc, start, count, flag)
        yield DONE, (doc[later], start[later], count[later], doc[source], start[source])
        o = left[is_open & ~flag[left]]
        yield OPEN, (doc[o], start[o], count[o], doc[o], start[o])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids, spans = np.asarray(b.column(0)), b.column(2).to_pylist()
            for low, high, part in slices(b.column(1)):
                values, first = items(part)
                starts = []
                for i in range(high - low):
                    runs = np.frombuffer(spans[low + i], kind_of).reshape(-1, width)
                    mark = np.zeros(first[i + 1] - first[i] + 1, np.int64)
                    np.add.at(mark, runs[:, 0], 1)
                    np.add.at(mark, runs[:, 0] + runs[:, 1], -1)
                    starts.append(first[i] + np.flatnonzero(np.cumsum(mark) > 0))
                at = np.concatenate(starts)
                text = np.searchsorted(first, at, "right") - 1
                if group_windows is not None:
                    h = group_windows(part, at, first)
                else:
                    h = Hasher(values).of(at, at + window)
                held.append((h, ids[low:high][text], at - first[text]))
                size += len(h)
                if size >= 2 * FLUSH:
                    yield from meet(held)
                    held, size = [], 0
        if size:
            yield from meet(held)

    def meet(held) -> Iterator[pa.RecordBatch]:
        h, doc, start = (np.concatenate(x) for x in zip(*held))
        later, source, i = settle_windows(h, doc, start)
        rows = known(DONE, doc[later], start[later], np.ones(len(later), np.int64), doc[source], start[source])
        rows += to_owner(((h[i] >> U(40)) % U(buckets)).astype(np.int64), ASK, h[i], as_docs(doc[i]), start[i])
        yield batch(rows)

    def own_windows(h, doc, start):
        later, source, _ = settle_windows(h.view(U), doc, start)
        yield DONE, (doc[later], start[later], np.ones(len(later), np.int64), doc[source], start[source])

    def stage(frame, first, second):
        return cut(frame.mapInArrow(first, ROWS).repartition(buckets, "bucket").mapInArrow(owners(second), ROWS)
                   .repartition(buckets, "bucket").mapInArrow(gather, FOUND))[0]

    one = stage(texts, find, own_segments)
    todo = one.where(F.col("kind") == OPEN).select("doc_id", "spans")
    two = stage(texts.join(todo.hint("merge"), "doc_id").select("doc_id", "text", "spans"), compare, own_windows)
    return one.where(F.col("kind") == DONE).unionByName(two).select("doc_id", "spans")
