"""The trie of conversations against a plain one."""
import hashlib
import random
import zlib

import pytest

from srcgraph.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = {}
    ended = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt = own.get(c - c % 100, [])[:h] + turns[h:]
        ended.setdefault(tuple(rebuilt), []).append(c)
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves.setdefault(node, 0)
        leaves[node] += node not in children
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node],
                   saved[node], sha(ended.get(node, []))) for node, m in members.items())


def key(row):
    return tuple((v is not None, v) for v in row)


def compare(spark, rows, parts=3, **sizes):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in prefixes.trie(frame, **sizes).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def some_rows(seed, convs=150, turns=9, words=3):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(400), convs):
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "é😀", "word " * 3][:words]))
                for t in range(rng.randint(1, turns))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_plain_trie(spark, seed):
    compare(spark, some_rows(seed, words=2 + seed % 3))


def test_ranges_cut_hot_prefixes(spark):
    """Many ranges and a small fan: paths close in several rounds, copies and first turns span ranges."""
    rows = some_rows(5, convs=60)
    for c in range(1000, 1100):  # copies of one conversation, a third of the rows
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    for c in range(2000, 2060):  # one first turn
        rows += [(c, 0, "system", "hello"), *((c, t, "user", f"{c} {t}") for t in range(1, 8))]
    compare(spark, rows, part_bytes=600, fan=3)


def test_long_conversations_and_snapshots(spark):
    rows = [(100 * c + 7, t, "user", f"turn {t}") for c in range(40) for t in range(10 * c % 170 + 1)]
    compare(spark, rows, part_bytes=3000, fan=4)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "gone"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (101, 1, None, "x"),
            (-5, 0, "user", "negative"), (7, 0, "", "")]
    # Python and Spark differ in the remainder of negative numbers
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows if r[0] != -5], SCHEMA)
    assert sorted([tuple(r) for r in prefixes.trie(frame).collect()], key=key) == sorted(plain([r for r in rows if r[0] != -5]), key=key)
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    turnless = [(c, 0, "user", f"{c}") for c in range(301, 340)]
    compare(spark, turnless)
    one = prefixes.trie(spark.createDataFrame([(-5, 0, "user", "negative", 1, "")], SCHEMA)).collect()
    assert {r.n_convs for r in one} == {1}
