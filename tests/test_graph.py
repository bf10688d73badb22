import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import graph, views

CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]
CYCLE = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def reached(spark, pairs, start, **options):
    return {(r.direction, r.node): r.hop for r in graph.reach(edges_of(spark, pairs), start, **options).collect()}


def test_chain(spark):
    assert reached(spark, CHAIN, "a", directions=("downstream",)) == {("downstream", n): h for n, h in zip("bcd", (1, 2, 3))}
    assert reached(spark, CHAIN, "d", directions=("upstream",)) == {("upstream", n): h for n, h in zip("cba", (1, 2, 3))}
    assert reached(spark, CHAIN, "a", directions=("upstream",)) == {}
    both = reached(spark, CHAIN, "c")
    assert sum(d == "upstream" for d, _ in both) == 2 and sum(d == "downstream" for d, _ in both) == 1


def test_max_depth_and_cycle(spark):
    assert ("downstream", "d") not in reached(spark, CHAIN, "a", max_depth=2)
    assert reached(spark, CYCLE, "a", directions=("downstream",)) == {("downstream", "b"): 1, ("downstream", "c"): 2}
    assert reached(spark, CHAIN, "a", max_depth=0) == {}


def plain_bfs(pairs, start):
    out, hops, todo = defaultdict(set), {start: 0}, deque([start])
    for s, d in pairs:
        out[s].add(d)
    while todo:
        n = todo.popleft()
        for m in out[n]:
            if m not in hops:
                hops[m] = hops[n] + 1
                todo.append(m)
    return {n: h for n, h in hops.items() if n != start}


@pytest.mark.parametrize("seed,broadcast_rows", [(1, 1000), (2, 0)])
def test_random_graph(spark, seed, broadcast_rows):
    """Both join strategies agree with a plain breadth-first search, hub node included."""
    rng = random.Random(seed)
    pairs = [(str(rng.randint(0, 60)), str(rng.randint(0, 60))) for _ in range(90)] + [("hub", str(i)) for i in range(40)] + [("3", "hub")]
    found = reached(spark, pairs, "3", broadcast_rows=broadcast_rows)
    expected = {("downstream", n): h for n, h in plain_bfs(pairs, "3").items()}
    expected |= {("upstream", n): h for n, h in plain_bfs([(d, s) for s, d in pairs], "3").items()}
    assert found == expected


@pytest.mark.parametrize("depth,hot_arcs", [(None, 20_000), (2, 7), (0, 7)])
def test_impact_sizes_of_all_nodes(spark, depth, hot_arcs):
    """Every node's counts agree with a plain search from it: hub in several slots, more nodes than one word, loops, nulls."""
    rng = random.Random(9)
    pairs = [(str(rng.randint(0, 150)), str(rng.randint(0, 150))) for _ in range(220)]
    pairs += [(str(i), "hub") for i in range(0, 60)] + [("hub", "3"), ("hub", "hub")] + pairs[:5]
    frame = spark.createDataFrame(pairs + [(None, "3"), ("4", None)], "src string, dst string")
    found = {(r.direction, r.node): (r.direct, r.indirect, r.total, r.max_depth) for r in graph.impact_sizes(frame, depth, hot_arcs=hot_arcs).collect()}
    wanted = {}
    for direction, arcs in (("downstream", pairs), ("upstream", [(d, s) for s, d in pairs])):
        for node in {n for pair in pairs if pair[0] != pair[1] for n in pair}:
            hops = [h for h in plain_bfs(arcs, node).values() if depth is None or h <= depth]
            wanted[direction, node] = (hops.count(1), sum(h > 1 for h in hops), len(hops), max(hops, default=0))
    assert found == wanted
    assert graph.impact_sizes(frame.where("false"), depth).count() == 0


def test_degrees_cycles_isolated(spark):
    edges = edges_of(spark, CYCLE + [("d", "b"), ("e", "b"), ("d", "b")])
    assert {r.file_path: r.dependents for r in graph.dependents(edges).collect()} == {"a": 2, "b": 3, "c": 1}
    assert [r.file_path for r in graph.monoliths(edges, 3).collect()] == ["b"]
    assert [(r.a, r.b) for r in graph.mutual_pairs(edges).collect()] == [("a", "b")]
    nodes = spark.createDataFrame([(n,) for n in "abcdexy"], "file_path string")
    assert sorted(r.file_path for r in graph.isolated(nodes, edges).collect()) == ["x", "y"]
    assert {r.node: r.radius for r in graph.blast_radius(edges).collect()} == {"a": 2, "b": 4, "c": 2, "d": 1, "e": 1}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    nodes = [(g, n) for g in "gh" for n in range(80)]
    links = [(g, rng.randint(0, 79), rng.randint(0, 79)) for g in "gh" for _ in range(45)]
    links += [("g", i, i + 1) for i in range(20, 50)] + [("h", 0, i) for i in range(30, 60)]
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for g, a, b in links:
        x, y = find((g, a)), find((g, b))
        parent[max(x, y)] = min(x, y)
    found = graph.components(spark.createDataFrame(nodes, "grp string, node int"), spark.createDataFrame(links, "grp string, a int, b int"))
    assert {(r.grp, r.node): (r.grp, r.component) for r in found.collect()} == {n: find(n) for n in nodes}


def test_short_lists(spark):
    rows = spark.createDataFrame([("up", f"n{i}", 1) for i in range(5)] + [("up", "z", 5)], "direction string, node string, hop int")
    short = views.first_per_hop(rows).collect()
    assert [(r.hop, list(r.nodes), r.more) for r in short] == [(1, ["n0", "n1", "n2"], 2)]
    names = spark.range(1).select(views.shortened(F.array(*[F.lit(f"d/{c}") for c in "abcdef"]), 4).alias("t")).first().t
    assert names == "a, b, c, d +2 more"


def test_deep_graph_keeps_a_small_plan(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    for broadcast_rows in (100, 0):
        found = graph.reach(chain, 0, ("downstream",), broadcast_rows=broadcast_rows)
        assert sorted((r.node, r.hop) for r in found.collect()) == [(i, i) for i in range(1, 13)]
        # one scan of all hops, not one per hop
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_tasks_grow_with_rows(spark):
    from srcgraph.session import TASK_ROWS, dealt
    frame = spark.range(10).withColumnRenamed("id", "a")
    assert dealt(frame, 40 * TASK_ROWS, "a").rdd.getNumPartitions() == 40
    assert dealt(frame, 10, "a").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_sizes_leave_no_state_behind(spark):
    import os
    from srcgraph.session import shared_folder
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    place = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place))
    sizes = graph.impact_sizes(edges, 2, ("downstream",))
    assert sorted((r.node, r.direct, r.indirect) for r in sizes.collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0)]
    columns = [spark.read.parquet(f"{place}/{new}").columns for new in set(os.listdir(place)) - before if new.startswith("table-")]
    assert not any("seen" in c for c in columns)


def test_impact_sizes_in_slices(spark, monkeypatch):
    """Counts summed over slices of the reached nodes are those of one pass, and no pass writes the state of all."""
    rng = random.Random(4)
    frame = spark.createDataFrame([(rng.randint(0, 299), rng.randint(0, 299)) for _ in range(700)], "src int, dst int")
    rows = lambda found: sorted(map(tuple, found.collect()))
    whole = rows(graph.impact_sizes(frame, 2))
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda part, *metrics, **options: written.append((part.columns, cut(part, *metrics, **options))) or written[-1][1])
    assert rows(graph.impact_sizes(frame, 2, slice_rows=600)) == whole
    first = [seen["n"] for columns, (_, seen) in written if columns[:2] == ["at", "word"]]
    assert len(first) > 4 and max(first) < sum(first) / 4
    assert [graph.slices_of(*case, 100) for case in ((0, 0, 3), (10, 40, 2), (1000, 10_000, None), (1000, 1000, 5), (1000, 2000, 3))] == [1, 1, 16, 10, 16]
