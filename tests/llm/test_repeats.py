import random

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, removed, table, words

from srcgraph.llm import phrases, repeats, suffixes
from srcgraph.llm.repeats import Hasher
from srcgraph.llm.words import TABLE, Texts, hashes_of, slices


def test_phrases_match_a_dictionary_of_windows(spark):
    for seed in (1, 2):
        rows = awkward(seed)
        want = removed(rows, words, 13, b" ".join)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digest(phrases.removed(table(spark, rows))).collect()}
        assert got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}


def test_whole_rows_come_back(spark):
    rows = awkward(3)
    got = phrases.removed(table(spark, rows)).select("row.*", "kept").collect()
    assert sorted((r.doc_id, r.text or "", r.cluster) for r in got) == sorted((i, t or "", 4) for i, t in rows)


def test_suffixes_match_a_dictionary_of_strings(spark):
    for seed in (1, 4):
        rows = awkward(seed) + [(1000, "ab" * 200), (1001, "ba" * 120), (1002, "x" * 49), (1003, "y" + "x" * 49), (1004, "x" * 60)]
        want = removed(rows, lambda t: (t or "").encode(), 50, bytes)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
               for r in suffixes.digest(suffixes.removed(table(spark, rows))).collect()}
        assert got == want


def test_rows_without_id_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (5, long), (5, long), (7, long)]
    found = sorted((r.doc_id or -1, r.n_removed) for r in phrases.digest(phrases.removed(table(spark, rows))).collect())
    assert found == [(-1, 0), (5, 0), (5, 0), (7, 30)]
    size = len(long)
    found = sorted((r.doc_id or -1, r.n_removed) for r in suffixes.digest(suffixes.removed(table(spark, rows))).collect())
    assert found == [(-1, 0), (5, 0), (5, 0), (7, size)]


def test_a_passage_in_every_document(spark):
    """One passage that all documents hold, each between words of its own."""
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(3, 30)))
    common = own() + " " + " ".join(f"common{i}" for i in range(25))
    rows = [(i, f"{own()} {common} {own()}") for i in range(400)]
    want = removed(rows, words, 13, b" ".join)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digest(phrases.removed(table(spark, rows, 8))).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}
    want = removed(rows, lambda t: t.encode(), 50, bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.removed(table(spark, rows, 8))).collect()}
    assert got == want


def apart(spark, rows):
    """The first document in one task, the others in another."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")


def test_an_open_anchor_spoken_for_by_a_repeat(spark):
    """Document 3 holds two segments around one anchor; 5 and 7 of another task repeat one each."""
    rng = random.Random(5)
    own = lambda k: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(k)]
    gram = min((own(5) for _ in range(5000)), key=lambda g: Hasher(hashes_of([w.encode() for w in g])).of([0], [5])[0])
    one, two = (" ".join(own(8) + gram + own(8)) for _ in range(2))
    rows = [(3, " ".join([one, *own(30), two])), (5, one), (7, two)]
    want = removed(rows, words, 13, b" ".join)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digest(phrases.removed(apart(spark, rows))).collect()}
    assert want[5][1] == want[7][1] == 21 and got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}

    own = lambda k: "".join(rng.choices("abcdefgh", k=k))
    gram = min((own(20) for _ in range(5000)), key=lambda g: Hasher(TABLE[np.frombuffer(g.encode(), np.uint8)]).of([0], [20])[0])
    one, two = (own(30) + gram + own(30) for _ in range(2))
    rows = [(3, one + own(100) + two), (5, one), (7, two)]
    want = removed(rows, lambda t: t.encode(), 50, bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.removed(apart(spark, rows))).collect()}
    assert want[5][1] == want[7][1] == 80 and got == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_is_the_order_of_suffixes(seed):
    """Dictionary and parse ranks order all suffixes of all stretches as sorting them does."""
    rng = np.random.default_rng(seed)
    block = rng.integers(97, 100, 400)
    data = np.concatenate([block, rng.integers(97, 100, 200), block[:300], block, np.full(90, 97)])
    bounds = np.concatenate([[0], np.sort(rng.choice(np.arange(10, len(data)), 6, replace=False)), [len(data)]])
    key, following = suffixes.suffix_order(data, bounds)
    ends = bounds[np.searchsorted(bounds, np.arange(len(data)), "right")]
    found = [i for i in np.lexsort((following, key)) if ends[i] - i > suffixes.TRIGGER]
    suffix = {i: bytes(data[i:ends[i]].astype(np.uint8)) + b"\0" for i in found}
    assert [suffix[i] for i in found] == sorted(suffix[i] for i in found)


def test_slices_cover_all_texts():
    texts = ["", None, "é" * 50, "x", "y" * 500, ""] * 5
    whole = pa.array(["skip", *texts, "skip"])[1:-1]
    seen = []
    for a, b, part in slices(whole, 64, 4):
        assert isinstance(part, Texts) and b - a == part.n <= 4
        seen += [part.data[part.bounds[i]:part.bounds[i + 1]].tobytes().decode() for i in range(part.n)]
    assert seen == [t or "" for t in texts]


def test_owners_settle_a_bounded_number_of_entries(spark, monkeypatch):
    """Shares of few entries give the same rows, and entries of one hash stay in one share."""
    h = np.array([5, 9, 5, -3, 9, 7, -3, 5] * 10)
    picks = list(repeats.shares(h, 20))
    assert len(picks) > 1 and sorted(np.concatenate(picks).tolist()) == list(range(80))
    assert sum(len(set(h[p].tolist())) for p in picks) == 4
    monkeypatch.setattr(repeats, "SHARE", 5)
    rows = awkward(6)
    want = removed(rows, lambda t: (t or "").encode(), 50, bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(suffixes.removed(table(spark, rows))).collect()}
    assert got == want
    want = removed(rows, words, 13, b" ".join)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digest(phrases.removed(table(spark, rows))).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}


@pytest.mark.parametrize("top", [0, 1, 255, 256, 65_536, (1 << 24) - 1, 1 << 24, (1 << 40) - 1, (1 << 63) + 5, (1 << 64) - 1])
def test_numbers_travel_in_as_few_bytes_as_the_largest_needs(top):
    values = np.array([top, 0, top // 3, top], np.uint64)
    data = repeats.packed(values)
    assert len(data) == 1 + 4 * max(1, (top.bit_length() + 7) // 8)
    assert (repeats.unpacked(data, np.uint64) == values).all()
    assert (repeats.unpacked(repeats.packed(values.view(np.int64).view(np.uint64))) == values.view(np.int64)).all()
    assert not len(repeats.unpacked(repeats.packed(np.empty(0, np.uint64))))


def test_suffix_ranks_take_few_sorts(monkeypatch):
    """The first key holds as many symbols as fit, so the order needs fewer rounds and is the plain one."""
    rng, rounds, plain_ranks = np.random.default_rng(3), [], suffixes.ranks
    monkeypatch.setattr(suffixes, "ranks", lambda keys: rounds.append(1) or plain_ranks(keys))
    for top, n, most in ((2, 300, 2), (258, 300, 2), (100_000, 50, 5)):
        rounds.clear()
        size = np.array([n // 3, n // 3, n - 2 * (n // 3)])
        symbols = np.tile(rng.integers(0, top, n // 3), 4)[:n].astype(np.int64)
        stop = np.repeat(np.cumsum(size), size)
        found = suffixes.suffix_ranks(symbols, stop, n + 1)
        order = {s: i for i, s in enumerate(sorted({tuple(symbols[i:stop[i]]) for i in range(n)}), 1)}
        assert found.tolist() == [order[tuple(symbols[i:stop[i]])] for i in range(n)]
        assert len(rounds) <= most


@pytest.mark.parametrize("size", [1, 7, 8, 13, 50])
def test_bytes_are_compared_in_words(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    data[200:] = data[:200]
    data[260] ^= 1
    one = np.concatenate([np.arange(0, 150), rng.integers(0, 350, 200)])
    other = np.concatenate([np.arange(200, 350), rng.integers(0, 350, 200)])
    plain = [bytes(data[a:a + size]) == bytes(data[b:b + size]) for a, b in zip(one, other)]
    assert suffixes.agree(data, one, other, size).tolist() == plain and any(plain) and not all(plain)
