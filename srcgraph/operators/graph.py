"""Queries over edge tables (src, dst): degrees, cycles, reachability, components."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from srcgraph.operators.ranks import ranked
from srcgraph.operators.skew import grown, salted_join
from srcgraph.session import BROADCAST_ROWS, cut, dealt, new_path, remove_path

SLICE_ROWS = 1_000_000_000  # reached pairs that one pass over a graph may have by estimate
HOT_ARCS = 20_000  # arcs into one node that stay together; more are dealt over several slots


def dependents(edges: DataFrame) -> DataFrame:
    """Number of distinct files pointing at each file."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("file_path")).agg(
        F.count(F.lit(1)).alias("dependents"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(file_path, side, position, other): dependents and dependencies of each file in order, one row each."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    sides = pairs.select(F.col("dst").alias("file_path"), F.lit("dependents").alias("side"), F.col("src").alias("other")).unionByName(
        pairs.select(F.col("src").alias("file_path"), F.lit("dependencies").alias("side"), F.col("dst").alias("other")))
    return ranked(sides, ["file_path", "side"], ["other"])


def monoliths(edges: DataFrame, minimum: int) -> DataFrame:
    return dependents(edges).where(F.col("dependents") >= minimum)


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs that depend on each other, found without a self-join.

    Each edge names its pair in sorted order; a pair seen in both directions is
    mutual.  The grouping key is the pair, so no hub gathers in one group.
    """
    return (edges.where("src <> dst")
            .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                    (F.col("src") < F.col("dst")).alias("up"))
            .groupBy("a", "b").agg(F.max("up").alias("up"), F.min("up").alias("only_up"))
            .where(F.col("up") & ~F.col("only_up")).select("a", "b"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (file_path, ...) without any edge: one anti-join against all endpoints."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("file_path")).distinct()
    return nodes.join(touched, "file_path", "left_anti")


def reach(edges: DataFrame, start, directions=("upstream", "downstream"),
          max_depth: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(direction, node, hop): every node at its smallest distance from ``start``.

    Breadth-first by joins, all directions in one loop.  A frontier of counted
    size up to ``broadcast_rows`` is broadcast, so the edges are only scanned; a
    larger one takes a salted shuffle join, which keeps hub nodes balanced.
    What was reached is one table of many folders, so the plan of a hop and of
    the result stays as small in a deep graph as in a flat one.
    """
    spark = edges.sparkSession
    edges, counted = cut(edges.select("src", "dst").where("src <> dst"))
    ways = {"upstream": ("dst", "src"), "downstream": ("src", "dst")}
    arcs = None
    for name in directions:
        near, far = ways[name]
        part = edges.select(F.lit(name).alias("direction"), F.col(near).alias("node"), F.col(far).alias("next"))
        arcs = part if arcs is None else arcs.unionByName(part)
    arcs, _ = cut(dealt(arcs, len(directions) * counted["n"], "direction", "node", "next").distinct())
    node_type = arcs.schema["node"].dataType
    frontier = spark.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in directions])).alias("direction"),
        F.lit(start).cast(node_type).alias("node"), F.lit(0).alias("hop"))
    folders = [new_path(spark)]
    frontier, _ = cut(frontier, path=folders[0])
    reached = size = len(directions)
    hop = 0

    def known() -> DataFrame:
        return spark.read.schema(frontier.schema).parquet(*folders)

    while size and (max_depth is None or hop < max_depth):
        hop += 1
        here = frontier.select("direction", "node")
        if size <= broadcast_rows:
            stepped = arcs.join(F.broadcast(here), ["direction", "node"])
        else:
            stepped = salted_join(arcs, here, ["direction", "node"])
        old = known().select("direction", "node")
        fresh = (stepped.select("direction", F.col("next").alias("node")).distinct()
                 .join(F.broadcast(old) if reached <= broadcast_rows else grown(old), ["direction", "node"], "left_anti")
                 .withColumn("hop", F.lit(hop)))
        path = new_path(spark)
        frontier, seen = cut(fresh, path=path)
        size = seen["n"]
        reached += size
        folders.append(path)
    return known().where("hop > 0")


def impact_summary(reached: DataFrame) -> DataFrame:
    """Per direction: direct, indirect and total counts and the deepest hop."""
    return reached.groupBy("direction").agg(
        F.sum((F.col("hop") == 1).cast("long")).alias("direct"),
        F.sum((F.col("hop") > 1).cast("long")).alias("indirect"),
        F.count(F.lit(1)).alias("total"), F.max("hop").alias("max_depth"))


def slices_of(nodes: int, arcs: int, depth: int | None, slice_rows: int) -> int:
    """In how many passes reached nodes are counted: pairs by the mean number of arcs, none over a pair of nodes, a word at least."""
    within = nodes
    if depth is not None and nodes:
        within, step = 1, max(1.0, arcs / nodes)
        for _ in range(depth):
            within = min(nodes, within * step)
            if within in (1, nodes):
                break
    return max(1, min(-(-nodes // 64), -(-int(nodes * within) // slice_rows)))


def reach_sizes(edges: DataFrame, direction: str, depth: int | None = None, hot_arcs: int = HOT_ARCS,
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(node, hop, nodes): how many nodes lie exactly ``hop`` away from every node, for all nodes at once.

    Nodes are numbered, and what a node reaches is a sparse bit set: one row
    (node, word) per 64 numbers that hold a reached one.  A hop hands the bits
    that are new at a node to all nodes with an arc to it, and one grouping by
    (node, word) joins them with the bits seen before.  The arcs are dealt by
    their far end once and stay there; a far end with more than ``hot_arcs``
    arcs has several slots, and its bits go to each.  A word's bits never meet
    those of another, so the words of a large graph are counted slice by slice:
    the disks hold the state and the shuffled bits of one slice.  Null ends and arcs from a
    node to itself count for nothing; an empty table gives no rows.
    """
    spark = edges.sparkSession
    near, far = ("src", "dst") if direction == "downstream" else ("dst", "src")
    pairs, counted_arcs = cut(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).where("node <> next").distinct())
    ends = pairs.select(F.explode(F.array("node", "next")).alias("node")).distinct().withColumn("_all", F.lit(0))
    incoming = pairs.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    numbered, counted_nodes = cut(ranked(ends, ["_all"], ["node"], "id").join(incoming, "node", "left").select(
        "node", "id", F.ceil(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) / hot_arcs).cast("int").alias("slots")))
    begin = numbered.select("node", F.col("id").alias("from"), F.col("slots").alias("from_slots"))
    end = numbered.select(F.col("node").alias("next"), F.col("id").alias("to"), "slots")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs = (pairs.join(begin, "node").join(end, "next")
            .select("to", F.pmod(F.xxhash64("from"), F.col("slots")).cast("int").alias("slot"), "from", "from_slots")
            .repartition(tasks, "to", "slot").persist(StorageLevel.DISK_ONLY))
    arcs.count()  # only a finished cache tells the joins how its rows are dealt
    bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
    slices = slices_of(counted_nodes["n"], counted_arcs["n"], depth, slice_rows)
    layers = []
    for part in range(slices):
        path = new_path(spark)
        state, seen = cut(numbered.where(F.expr(f"(id div 64) % {slices} = {part}")).select(
            F.col("id").alias("at"), F.expr("id div 64").alias("word"), "slots", bit.alias("seen"), bit.alias("fresh")), path=path)
        hop, moving = 0, seen["n"]

        def counted(bits: DataFrame) -> DataFrame:
            found = bits.where("fresh <> 0").groupBy("at").agg(F.sum(F.bit_count("fresh").cast("long")).alias("nodes"))
            return cut(found.withColumn("hop", F.lit(hop)))[0]

        while moving and (depth is None or hop < depth):
            hop += 1
            moved = state.where("fresh <> 0").select(
                F.col("at").alias("to"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "word", "fresh")
            came = arcs.join(moved, ["to", "slot"]).select(
                F.col("from").alias("at"), "word", F.col("from_slots").alias("slots"), F.lit(0).cast("long").alias("seen"), F.col("fresh").alias("came"))
            merged = state.select("at", "word", "slots", "seen", F.lit(0).cast("long").alias("came")).unionByName(came).groupBy("at", "word").agg(
                F.max("slots").alias("slots"), F.bit_or("seen").alias("seen"), F.bit_or("came").alias("came"))
            fresh = F.col("came").bitwiseAND(F.bitwise_not("seen"))
            after = merged.select("at", "word", "slots", F.col("seen").bitwiseOR(F.col("came")).alias("seen"), fresh.alias("fresh"))
            before = path
            if hop == depth:  # nothing follows: the bits are counted and never written
                layers.append(counted(after))
            else:
                path = new_path(spark)
                state, seen = cut(after, F.coalesce(F.sum((F.col("fresh") != 0).cast("long")), F.lit(0)).alias("moving"), path=path)
                moving = seen["moving"]
                layers.append(counted(state))
            remove_path(spark, before)
        if hop != depth:
            remove_path(spark, path)
    arcs.unpersist()
    out = numbered.where("false").select(F.col("id").alias("at"), F.lit(0).cast("long").alias("nodes"), F.lit(0).alias("hop"))
    for layer in layers:
        out = out.unionByName(layer)
    if slices > 1:
        out = out.groupBy("at", "hop").agg(F.sum("nodes").alias("nodes"))
    return out.join(numbered.select("node", F.col("id").alias("at")), "at").select("node", "hop", "nodes")


def impact_sizes(edges: DataFrame, depth: int | None = None, directions=("upstream", "downstream"), hot_arcs: int = HOT_ARCS,
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(direction, node, direct, indirect, total, max_depth) of every node with an edge, up to ``depth`` hops.

    The summary of ``reach`` for all nodes; one that reaches nothing has zeros.
    """
    nodes = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = None
    for direction in directions:
        part = nodes.select("node", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("nodes")).unionByName(
            reach_sizes(edges, direction, depth, hot_arcs, slice_rows)).withColumn("direction", F.lit(direction))
        out = part if out is None else out.unionByName(part)

    def n(condition):
        return F.sum(F.when(condition, F.col("nodes")).otherwise(0))
    return out.groupBy("direction", "node").agg(
        n(F.col("hop") == 1).alias("direct"), n(F.col("hop") > 1).alias("indirect"), F.sum("nodes").alias("total"), F.max("hop").alias("max_depth"))


def near_nodes(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, other) of direct neighbours in either direction, each once, and how many there are at most."""
    pairs, seen = cut(edges.select("src", "dst").where("src <> dst"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
                                          F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
    return dealt(both, 2 * seen["n"], "node", "other").distinct(), 2 * seen["n"]


def blast_radius(edges: DataFrame) -> DataFrame:
    """Per node: number of distinct direct neighbours in either direction."""
    return near_nodes(edges)[0].groupBy("node").agg(F.count(F.lit(1)).alias("radius"))


def blast_lists(edges: DataFrame, keep: int = 4) -> DataFrame:
    """(node, names, more): the first ``keep`` direct neighbours in either direction and how many more there are."""
    near, rows = near_nodes(edges)
    placed = ranked(near, ["node"], ["other"], rows=rows)
    return placed.groupBy("node").agg(
        F.array_sort(F.collect_list(F.when(F.col("position") <= keep, F.col("other")))).alias("names"),
        F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("more"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, node) with undirected links (grp, a, b) -> (grp, node, component).

    The component is named after its smallest node.  Each round hangs every
    node on its smallest neighbour, follows these hooks to their roots, and
    keeps only links between different roots, so settled parts leave the loop.
    Hot roots are plain join keys, which adaptive execution splits.
    """
    def roots(frame: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
        named = hooks.select("grp", F.col("node").alias(column), F.col("root").alias("_root"))
        return frame.join(named, ["grp", column], "left").withColumn(column, F.coalesce("_root", column)).drop("_root")

    def ordered(frame: DataFrame) -> DataFrame:
        return frame.where("a <> b").select("grp", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    rest, seen = cut(ordered(links))
    layers = []
    while seen["n"]:
        hooks, _ = cut(rest.groupBy("grp", F.col("a").alias("node")).agg(F.min("b").alias("root")))
        while True:
            above = hooks.select("grp", F.col("node").alias("root"), F.col("root").alias("top"))
            hooks, state = cut(
                hooks.join(above, ["grp", "root"], "left").select(
                    "grp", "node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")),
                F.sum(F.col("moved").cast("long")).alias("moved"))
            hooks = hooks.drop("moved")
            if not state["moved"]:
                break
        layers.append(hooks)
        rest, seen = cut(ordered(roots(roots(rest, hooks, "a"), hooks, "b")))
    out = nodes.select("grp", "node", F.col("node").alias("component"))
    for hooks in layers:
        out = roots(out, hooks, "component")
    return out.select("grp", "node", "component")
