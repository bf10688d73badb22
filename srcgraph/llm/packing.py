"""Packing token sequences by the sum-of-squares rule.

Each piece goes where the squared counts of open bins per residual gap become
smallest: moving a bin of gap g to gap g - s changes the sum by
``2 (N[g-s] - N[g]) + 2``, filling it by ``1 - 2 N[s]``, opening a new one by
``2 N[C-s] + 1``.  Ties prefer the fullest bin.  Pieces are dealt by a hash to
shards of about ``SHARD_TOKENS`` tokens, each packed in one task: the number of
shards grows with the data, a shard does not.  A shard is packed twice, in hash
order and longest first, and the packing with fewer sequences stays; the rule
leaves about one sequence in a thousand more than the tokens need.

A document is its token ids and the end id; only documents longer than a
sequence are cut.  Null and empty texts are the end id alone.  Repeated rows
(same doc_id) are packed as separate pieces; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut, map_arrow
from srcgraph.llm.tokens import default_path, encoder

CAPACITY = 4096
END_ID = 1
SHARD_TOKENS = 48 << 20
SHARD_PIECES = 1_000_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's token ids."""
    path = vocabulary or default_path()

    def encode(batch):
        coder = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = coder.ids(text) + end
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
    return map_arrow(docs.select("doc_id", "text"), encode, SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 stays 0
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), np.int64)
    bins = 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        now = count[size:capacity]
        change = np.where(now > 0, 2 * (count[:capacity - size] - now) + 2, far)
        if size < capacity and now[0]:
            change[0] = 1 - 2 * now[0]
        gap = size + int(change.argmin()) if size < capacity else capacity
        fresh = 1 + (2 * int(count[capacity - size]) if size < capacity else 0)
        if gap == capacity or fresh < change[gap - size]:
            gap, place = capacity, bins
            bins += 1
        else:
            place = held[gap].pop()
            count[gap] -= 1
        if gap > size:
            held[gap - size].append(place)
            count[gap - size] += 1
        out[i] = place
    return out


def pack(table: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with (sequence_id, offset): where each one lies, gapless from 0."""
    def place(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        doc, piece = group["doc_id"].to_numpy(), group["piece"].to_numpy()
        length = group["length"].to_numpy()
        mixed = np.lexsort((piece, doc, group["ids_crc32"].to_numpy()))
        orders = [mixed, mixed[np.argsort(-length[mixed], kind="stable")]]
        packed = [(order, sum_of_squares(length[order], capacity)) for order in orders]
        order, bins = min(packed, key=lambda x: int(x[1].max()))
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        before = np.cumsum(length[order]) - length[order]
        offset = before - before[np.searchsorted(bins, bins)]
        return (group.drop_columns(["shard"]).take(pa.array(order))
                .append_column("sequence_id", pa.array(bins * shards + shard, pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    dealt = table.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(place, SCHEMA + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
             shard_tokens: int = SHARD_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A shard has about ``shard_tokens`` tokens and ``shard_pieces`` pieces at most, so many empty texts fill no task.
    """
    found, seen = cut(pieces(docs, capacity, vocabulary), F.sum("length").alias("tokens"))
    return pack(found, max(1, -(-int(seen["tokens"] or 0) // shard_tokens), -(-seen["n"] // shard_pieces)), capacity)
