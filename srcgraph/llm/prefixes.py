"""Prefix trie of conversations by truncation peeling.

A turn becomes 16 bytes: 12 of a digest of role and text and 4 with the code
points of the text; a conversation is the string of its turns' bytes, so texts
are never grouped.  Spark sorts these strings over ranges of about ``PART_BYTES``.
In the sorted order the members of every node lie side by side, whatever share of
all conversations they are, and hot prefixes spread over as many ranges as they fill.

Each range is peeled from its greatest depth: conversations that end there join the
nodes that survived from below, nodes are closed and counted, their last turn is
stripped and neighbours with an equal rest become one node.  Nodes that the first or
the last conversation of a range belongs to may go on in the next range and stay
open; they are two paths a range, peeled together for ``FAN`` ranges at a time until
all are closed.  So one pass finds the nodes and sums up their subtrees.

Turns go by ``turn``, null first, equal turns by digest.  Rows without conv_id are
no conversation; null roles and texts are empty; other columns are ignored; an empty
table has no nodes.  Repeated rows are turns of their own.  The digests of one
conversation (16 bytes a turn) must fit a row.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut, parts

ITEM = 16
PART_BYTES = 16 << 20
FAN = 64
CHUNK_IDS = 2000
SHARED_TURNS = 6
FAMILY = 100
FAR = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
STATS = ["n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
# kind n: a closed node; o: an open node of a path, side 0 the first conversation's and side 1 the last one's; e: ids that end at an open node
SCHEMA = ("kind string, node string, parent string, part long, side int, item binary, seq long, ids binary, conv_id long, depth long, "
          "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
FIELDS = [tuple(f.split()) for f in SCHEMA.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    item = F.concat(F.left(digest, F.lit(2 * ITEM - 8)), F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    own = (turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", item.alias("item"))
           .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("turns"))
           .select("conv_id", F.transform("turns", lambda t: t["item"]).alias("items")))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    first = own.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("items", 1, SHARED_TURNS - 1).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    rebuilt = F.concat(F.slice(F.coalesce("shared", F.array().cast("array<string>")), F.lit(1), h),
                       F.slice("items", h + 1, F.greatest(F.size("items"), F.lit(1))))
    return (own.withColumn("base", base).join(first, "base", "left")
            .select("conv_id", F.unhex(F.array_join(rebuilt, "")).alias("key")))


def common_turns(keys: list[bytes], depths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns that each key shares with the one before (-1 for the first), all turns, and where each key's turns begin."""
    flat = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    begin = np.cumsum(depths) - depths
    shared = np.minimum(depths[1:], depths[:-1])
    pair = np.repeat(np.arange(len(shared)), shared)
    at = np.arange(shared.sum()) - np.repeat(np.cumsum(shared) - shared, shared)
    differ = np.flatnonzero((flat[begin[pair] + at] != flat[begin[pair + 1] + at]).any(axis=1))
    np.minimum.at(shared, pair[differ], at[differ])
    return np.r_[-1, shared], flat, begin


def names(key: bytes) -> list[str]:
    """Name of every prefix of a key."""
    running = hashlib.md5()
    out = [running.hexdigest()]
    for at in range(0, len(key), ITEM):
        running.update(key[at:at + ITEM])
        out.append(running.copy().hexdigest())
    return out


def peel(keys: list[bytes], at: np.ndarray, depth: np.ndarray, stats: dict[str, np.ndarray], part: int, last: bool,
         ends: dict[int, str] | None = None) -> dict[str, list]:
    """Close the nodes of sorted distinct keys from the greatest depth upwards.

    Entries are parts of nodes: the first ``depth`` turns of key ``at`` with what is
    known of them.  Nodes of the first or last key stay open unless this is the
    ``last`` range.  ``ends`` are digests of the ids that end at whole keys; without
    them the entries are open nodes of before, which have names.
    """
    depths = np.array([len(k) // ITEM for k in keys], np.int64)
    lcp, flat, begin = common_turns(keys, depths)
    points = flat.view(np.uint8).reshape(-1, ITEM)[:, 12:].copy().view(">u4").ravel().astype(np.int64)
    path_names = {i: names(keys[i]) for i in ({0, len(keys) - 1} if ends is not None else range(len(keys)))}
    out: dict[str, list] = {name: [] for name, _ in FIELDS}

    def emit(rows: int, **columns):
        for name in out:
            value = columns.get(name)
            out[name].extend(value if isinstance(value, list) else [value] * rows)

    order = np.argsort(-depth, kind="stable")
    at, depth, stats = at[order], depth[order], {k: v[order] for k, v in stats.items()}
    level = np.searchsorted(-depth, np.arange(-int(depth.max()), 2))  # entries of each depth, deepest first
    up = {k: np.zeros(0, np.int64) for k in ["start", "row", *STATS]}  # what survived from the depth below
    parents: dict[str, list[np.ndarray]] = {"row": [], "conv": []}
    open_parents: list[tuple[np.ndarray, str]] = []
    count = 0
    for n, d in enumerate(range(int(depth.max()), -1, -1)):
        new = slice(level[n], level[n + 1])
        start = np.r_[up["start"], at[new]]
        mixed = np.argsort(start, kind="stable")
        start = start[mixed]
        joined = {k: np.r_[up[k], stats[k][new]][mixed] for k in STATS}
        first = np.flatnonzero((lcp[start] < d) & np.r_[True, start[1:] != start[:-1]])
        whole = {k: (np.minimum if k == "conv_id" else np.add).reduceat(v, first) for k, v in joined.items()}
        node = start[first]
        closed = np.ones(len(first), bool)
        if not last:
            closed[0] &= depths[0] < d
            closed[-1] &= depths[-1] < d
        # parents of the nodes below
        row = np.r_[up["row"], np.full(len(at[new]), -1)][mixed]
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(start)]))
        known = (row >= 0) & closed[group]
        parents["row"].append(row[known])
        parents["conv"].append(whole["conv_id"][group[known]])
        for g in np.flatnonzero(~closed):
            below = row[(group == g) & (row >= 0)]
            side = 0 if g == 0 and depths[0] >= d else len(keys) - 1
            open_parents.append((below, path_names[side][d]))
            emit(1, kind="o", node=path_names[side][d], part=part, side=int(side > 0), depth=d,
                 item=keys[side][ITEM * (d - 1):ITEM * d] if d else b"", **{k: [int(whole[k][g])] for k in STATS})
            count += 1
        # closed nodes
        shut = np.flatnonzero(closed)
        whole["n_leaves"][shut] += whole["n_children"][shut] == 0
        if d:
            whole["saved_tokens"][shut] += (whole["n_convs"][shut] - 1) * points[begin[node[shut]] + d - 1]
        heads = node[shut].tolist()
        emit(len(shut), kind="n", depth=d, **{k: whole[k][shut].tolist() for k in STATS},
             **({"ends_sha256": [ends[i] if depths[i] == d else NO_ENDS for i in heads]} if ends is not None
                else {"node": [path_names[i][d] for i in heads]}))
        rows = np.full(len(first), -1)
        rows[shut] = np.arange(count, count + len(shut))
        count += len(shut)
        # strip the last turn: a closed node is one child, an open one adds nothing yet
        up = {"start": node, "row": rows, "n_convs": whole["n_convs"] * closed,
              "conv_id": np.where(closed, whole["conv_id"], FAR), "n_children": closed.astype(np.int64),
              "n_leaves": whole["n_leaves"] * closed, "saved_tokens": whole["saved_tokens"] * closed}
    above = np.full(count, -1)
    above[np.concatenate(parents["row"])] = np.arange(sum(map(len, parents["row"])))
    convs = np.concatenate(parents["conv"])
    out["parent_conv_id"] = [int(convs[i]) if i >= 0 else None for i in above.tolist()]
    for below, name in open_parents:
        for i in below.tolist():
            out["parent"][i] = name
    return out


def batch_of(out: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(out[name], KINDS[kind]) for name, kind in FIELDS], [name for name, _ in FIELDS])


def peel_range(batches):
    """Peel one sorted range of (key, conv_id)."""
    part = TaskContext.get().partitionId()
    keys, sizes, ids = [], [], []
    for batch in batches:
        ids.append(batch.column(1).to_numpy())
        for key in batch.column(0).to_pylist():
            if keys and keys[-1] == key:
                sizes[-1] += 1
            else:
                keys.append(key)
                sizes.append(1)
    if not keys:
        return
    convs, members = np.concatenate(ids), np.array(sizes, np.int64)
    begin = np.cumsum(members) - members

    def text(a, b):
        return ",".join(map(str, convs[a:b].tolist())).encode()

    zero = np.zeros(len(keys), np.int64)
    edges = {0, *(i for i, key in enumerate(keys) if keys[-1].startswith(key))}  # whole keys that are open nodes
    ends = {i: hashlib.sha256(text(a, a + n)).hexdigest()
            for i, (a, n) in enumerate(zip(begin.tolist(), sizes)) if i not in edges}
    stats = {"n_convs": members, "conv_id": convs[begin], "n_children": zero, "n_leaves": zero, "saved_tokens": zero}
    yield batch_of(peel(keys, np.arange(len(keys)), np.array([len(k) // ITEM for k in keys]), stats, part, False, ends))
    for i in sorted(edges):
        for seq, a in enumerate(range(int(begin[i]), int(begin[i] + members[i]), CHUNK_IDS)):
            row = {name: [None] for name, _ in FIELDS}
            row |= {"kind": ["e"], "node": [names(keys[i])[-1]], "part": [part], "seq": [seq],
                    "ids": [text(a, min(a + CHUNK_IDS, int(begin[i] + members[i])))]}
            yield batch_of(row)


def peel_paths(last: bool):
    """Peel the open paths of neighbouring ranges together."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("side", "ascending"), ("depth", "ascending")])
        column = {name: group[name].to_pylist() for name in ("part", "side", "depth", "item")}
        paths: list[bytes] = []
        path_of, previous = [], None
        for part, side, depth, item in zip(*column.values()):
            if (part, side) != previous:
                head = paths[-1] if side else b""  # the last path begins with the turns it shares with the first
                paths.append(head[:ITEM * (depth - 1)] if side else b"")
                previous = (part, side)
            paths[-1] += item
            path_of.append(len(paths) - 1)
        keys = sorted(set(paths))
        place = {key: i for i, key in enumerate(keys)}
        at = np.array([place[p] for p in paths])[path_of]
        out = peel(keys, at, group["depth"].to_numpy().copy(), {k: group[k].to_numpy().copy() for k in STATS},
                   group["super"][0].as_py(), last)
        return pa.Table.from_batches([batch_of(out)])
    return run


def hash_ends(batches):
    """Digest of the ids of each node, of chunks in order."""
    node, running = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != node:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
        if done:
            yield pa.record_batch([pa.array(list(c)) for c in zip(*done)], ["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node]), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def trie(turns: DataFrame, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    found, seen = cut(sequences(turns), F.sum(F.octet_length("key").cast("long") + 32).alias("bytes"))
    ranges = max(parts(turns.sparkSession), -(-(seen["bytes"] or 0) // part_bytes))
    order = found.select("key", "conv_id").repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    peeled, _ = cut(order.mapInArrow(peel_range, SCHEMA))
    nodes, paths = peeled.where("kind = 'n'"), peeled.where("kind = 'o'")
    finished = []
    while True:
        last = ranges <= fan
        closing, _ = cut(paths.withColumn("super", F.floor(F.col("part") / fan)).groupBy("super").applyInArrow(peel_paths(last), SCHEMA))
        finished.append(closing.where("kind = 'n'"))
        if last:
            break
        paths, ranges = closing.where("kind = 'o'"), -(-ranges // fan)
    once_open = finished[0]
    for more in finished[1:]:
        once_open = once_open.unionByName(more)
    once_open, _ = cut(once_open)  # at most two paths a range
    hashed = (peeled.where("kind = 'e'").select("node", "ids", "part", "seq").repartition("node")
              .sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(hash_ends, "node string, ends_sha256 string"))
    named = once_open.drop("ends_sha256").join(hashed, "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(nodes.columns)
    everything = nodes.unionByName(named)
    above = once_open.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_id"))
    under_open = everything.where("parent IS NOT NULL").join(above, "parent").withColumn("parent_conv_id", F.col("parent_id"))
    return everything.where("parent IS NULL").select(*COLUMNS).unionByName(under_open.select(*COLUMNS))
