"""Near duplicates by one-permutation hashing.

A document's set is its distinct four-word shingles (words lower-cased in A-Z);
with fewer words the whole sequence is one shingle.  One hash per shingle feeds
all bins: the high bits choose the bin, the least value stays.  Empty bins are
filled by optimal densification: each follows its own fixed random order of
bins to the first full one.  ``BANDS`` bands of ``ROWS`` bins give buckets.

Documents with equal sets form one class and only the class takes part.  A
bucket yields a star: its least class against all others, formed first within a
partition, then once more over the partitions' centres, so a bucket of any size
sends one row per partition.  Links are confirmed on the full sets with integer
arithmetic.  Where a bucket still joins different components after that, an
exact way settles the rest: the classes that such buckets tie together are
compared in blocks of at most about ``BLOCK``, those outside the largest
component against all, and only links leave a task.  No pair is capped or
dropped.

Null, empty and blank texts have no shingles: they are linked with nothing and
kept, and so are rows without doc_id, whose component is null.  Rows that
repeat a doc_id get the same component; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.components import components
from srcgraph.llm.tables import cut, map_arrow, parts
from srcgraph.llm.words import U, mix, slices, span_sums, windows, STEP

SHINGLE = 4
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
BLOCK = 256
PERCENT = 80
# Each bin's order of bins to borrow from when it is empty: rank of every bin, one row per bin.
BORROW = np.argsort(np.random.default_rng(7).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)


def shingle_sets(texts, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    first = texts.words[2]
    hashes = texts.word_hashes(lower=True)
    at, window = windows(hashes, first, k)
    bound = np.searchsorted(at, first)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = mix(span_sums(hashes, STEP, first[short], first[short + 1]) + n[short].astype(U))
    out = []
    for i in range(texts.n):
        s = np.sort(window[bound[i]:bound[i + 1]])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    for i, h in zip(short, whole):
        out[i] = np.array([h], U)
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Bucket key of each band for a sorted, non-empty set."""
    bins = ((shingles >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    full, least = np.unique(bins, return_index=True)
    values = np.zeros(BINS, U)
    values[full] = shingles[least]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        values[empty] = shingles[least][BORROW[np.ix_(empty, full)].argmin(axis=1)]
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1).astype(U) * U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key ^ rows[:, j])
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): set size, a 128-bit name of the set, bucket keys."""
    def sketch(batch):
        for a, b, texts in slices(batch.column(1)):
            sets = shingle_sets(texts)
            names = [((int(s.sum(dtype=U)) ^ len(s)) - (1 << 63), int(mix(s).sum(dtype=U)) - (1 << 63)) for s in sets]
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()),
                 pa.array([band_keys(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"])
    return map_arrow(docs.select("doc_id", "text"), sketch,
                     "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def by_bucket(keys: np.ndarray, *columns: np.ndarray):
    """Sort by key and the columns; the first position of each key, and each row's key number."""
    order = np.lexsort((*columns[::-1], keys))
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def packed(bucket, kind, *arrays) -> tuple:
    return (bucket, kind, *[a.tobytes() for a in arrays])


PACKED = "bucket int, kind int, keys binary, a binary, b binary"


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                           ["bucket", "kind", "keys", "a", "b"])


def star_edges(classes: DataFrame, buckets: int) -> DataFrame:
    """(a, b), a < b: the least class of every bucket with each other class of it, once per pair and task.

    classes: (rep, bands).  Stars form within a partition first; what meets in a
    reduce task is one centre per partition and bucket.
    """
    def local(batches):
        keys, reps = [], []
        for batch in batches:
            keys.append(np.asarray(batch.column(1).flatten()).view(U))
            reps.append(np.repeat(np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths())))
        if not keys:
            return
        keys, reps = np.concatenate(keys), np.concatenate(reps)
        order, first, group = by_bucket(keys, reps)
        keys, reps = keys[order], reps[order]
        centre = reps[first][group]
        pairs = np.unique(np.stack([centre, reps])[:, centre < reps], axis=1)
        rows = [packed(int(pairs[0, 0] % buckets), 1, np.empty(0, U), pairs[0], pairs[1])] if pairs.size else []
        keys, reps = keys[first], reps[first]
        to = (keys % U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for p in range(buckets):
            i = order[cuts[p]:cuts[p + 1]]
            if len(i):
                rows.append(packed(p, 0, keys[i], reps[i], np.empty(0, np.int64)))
        yield as_batch(rows)

    def meet(batches):
        keys, reps, pairs = [np.empty(0, U)], [np.empty(0, np.int64)], [np.empty((2, 0), np.int64)]
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"]:
                    pairs.append(np.stack([np.frombuffer(row[c], np.int64) for c in "ab"]))
                else:
                    keys.append(np.frombuffer(row["keys"], U))
                    reps.append(np.frombuffer(row["a"], np.int64))
        keys, reps = np.concatenate(keys), np.concatenate(reps)
        order, first, group = by_bucket(keys, reps)
        reps = reps[order]
        centre = reps[first][group]
        pairs.append(np.stack([centre, reps])[:, centre < reps])
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if found.size:
            yield pa.record_batch([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return (classes.select("rep", "bands").mapInArrow(local, PACKED).repartition(buckets, "bucket")
            .mapInArrow(meet, "a long, b long").distinct())


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) with the whole sorted set, of the documents named in ``ids``.

    The joins on whole sets are sort-merge joins at every size: their small side grows with the data.
    """
    def build(batch):
        for a, b, texts in slices(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(a, b - a).cast(pa.int64()),
                                   pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], ["doc_id", "shingles"])
    return map_arrow(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), build, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    def check(batch):
        a, b = batch.column("a"), batch.column("b")
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(keep))
    joined = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
              .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a"))
    return map_arrow(joined.select("a", "b", "sa", "sb"), check, "a long, b long")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    def of(side):
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    return (pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def open_clusters(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, cluster, rest): classes tied together by buckets that hold two components or more.

    ``rest`` marks those outside the cluster's largest component; two classes
    of that component are linked already.
    """
    marked = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = (marked.groupBy("key").agg(F.min("rep").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("key", "hub"))
    ties, _ = cut(marked.join(mixed, "key").select("hub", "rep", "component").distinct())
    clusters, _ = cut(components(ties.select(F.col("hub").alias("a"), F.col("rep").alias("b"))))
    members, _ = cut(ties.select("rep", "component").distinct().join(
        clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep"))
    largest = (members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("cluster").agg(F.max_by("component", F.struct("n", F.negative("component"))).alias("main")))
    return members.join(largest, "cluster").select("rep", "cluster", (F.col("component") != F.col("main")).alias("rest"))


def block_links(clusters: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the rest of each cluster and all of it, block against block."""
    sizes = clusters.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum(F.col("rest").cast("int")) / BLOCK).cast("int").alias("rest_blocks"))
    placed = clusters.join(sizes, "cluster")

    def block(count):
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    everyone = placed.select("cluster", "rep", F.lit(False).alias("rest"), block("blocks").alias("i"),
                             F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("j"))
    others = placed.where("rest").select("cluster", "rep", F.lit(True).alias("rest"),
                                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), block("rest_blocks").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        reps, rest = group["rep"].to_numpy(), group["rest"].to_numpy(zero_copy_only=False)
        found = [np.frombuffer(x.as_buffer(), U) for x in group["shingles"]]
        size = np.array([len(x) for x in found])
        left, right = np.flatnonzero(~rest), np.flatnonzero(rest)
        both = np.zeros(len(left) * len(right), np.int64)
        if both.size:
            hx, hy = (np.concatenate([found[i] for i in side]) for side in (left, right))
            ix, iy = (np.repeat(np.arange(len(side)), size[side]) for side in (left, right))
            order = np.argsort(hx, kind="stable")
            hx, ix = hx[order], ix[order]
            low, high = np.searchsorted(hx, hy, "left"), np.searchsorted(hx, hy, "right")
            many = high - low
            ends = np.cumsum(many)
            step, begin = 4_000_000, 0
            while begin < len(hy):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + step)))
                m = many[begin:stop]
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[begin:stop], m)
                both += np.bincount(ix[at] * len(right) + np.repeat(iy[begin:stop], m), minlength=both.size)
                begin = stop
        both = both.reshape(len(left), len(right))
        union = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (reps[left][:, None] != reps[right][None, :]))
        x, y = reps[left][x], reps[right][y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    rows = everyone.unionByName(others).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    spark = docs.sparkSession
    buckets = parts(spark)
    sketch, _ = cut(sketches(docs))
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps, _ = cut(reps)
    classes = some.select(F.col("doc_id").alias("rep"), "bands").join(reps.select("rep"), "rep")
    classes, _ = cut(classes)
    edges, _ = cut(star_edges(classes, buckets))
    members = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets, _ = cut(full_sets(docs, members))
    shared = classes.join(members.withColumnRenamed("doc_id", "rep"), "rep").select(F.explode("bands").alias("key"), "rep")
    # one centre per class first: most other edges then lie within a component
    links, _ = cut(confirmed(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets))
    labels, _ = cut(components(links))
    links = links.unionByName(cut(confirmed(apart(edges, labels), sets))[0])
    labels, _ = cut(components(links))
    rest, state = cut(open_clusters(shared, labels))
    if state["n"]:
        links = links.unionByName(cut(block_links(rest, sets))[0])
        labels, _ = cut(components(links))
    out = sketch.join(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                      .select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
