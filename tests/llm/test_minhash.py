import random

from cases import awkward, linked, table

from srcgraph.llm import minhash
from srcgraph.llm.components import components
from srcgraph.llm.tables import table as read

FOLDER = "/root/testdata/sf0.01"


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}


def test_awkward_documents(spark):
    rows = awkward(6)
    assert result(table(spark, rows)) == linked(rows)


def test_all_documents(spark):
    docs = read(spark, FOLDER, "documents")
    assert result(docs) == linked([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_group_near_the_bound(spark):
    """Hundreds of near copies of one text whose similarity lies on both sides of the bound."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(own)))
    assert result(table(spark, rows, 7)) == linked(rows)


def test_rows_without_id(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")]
    found = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert found == [(-1, -1, True), (3, 3, True), (4, 3, False), (4, 3, False)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + \
        [(1000, 1000 + i) for i in range(200)]
    root = {n: n for e in links for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {n: find(n) for e in links if e[0] != e[1] for n in e}


def test_borrowing_keeps_similarity():
    """Filled bins of similar sets agree about as often as the sets do, small sets included."""
    import numpy as np
    rng = np.random.default_rng(3)
    for size in (10, 60, 900):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            one, two = np.unique(both[:int(size * 0.9)]), np.unique(both[int(size * 0.1):])
            agree.append((minhash.band_keys(one) == minhash.band_keys(two)).mean())
        assert abs(np.mean(agree) - 0.8 ** minhash.ROWS) < 0.09, size
