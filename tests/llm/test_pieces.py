"""Piece ids and texts against the sentencepiece library."""
import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from srcgraph.llm import pieces

PATH = pieces.default_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def compare(library, texts):
    flat, counts = pieces.model(PATH).encode(texts)
    texts_back = pieces.model(PATH).decode(flat, counts)
    for text, end, n, back in zip(texts, np.cumsum(counts), counts, texts_back):
        ids = library.encode(text or "")
        assert flat[end - n:end].tolist() == ids
        assert back == library.decode(ids)


def some_texts(seed, count):
    rng = random.Random(seed)
    letters = ["ab ", "aA bcdet\n", "the ing▁ \t", " ", "éèç àñ", "0123 .,", "日本語 中文字", "😀‍<s>\u0000x",
               "".join(map(chr, range(32, 127))), "in er on th"]
    return ["".join(rng.choice(rng.choice(letters) if rng.random() < .1 else a) for _ in range(rng.choice([0, 1, 2, 5, 20, 200])))
            for a in letters for _ in range(count)]


def test_equal_to_the_library(library):
    compare(library, [None, "", " ", "\n", "▁", "<s></s><unk><0x0A>", *some_texts(1, 300)])


def test_words_made_of_pieces(library):
    rng = random.Random(2)
    names = [library.id_to_piece(i) for i in range(259, len(library))]
    compare(library, ["".join(rng.choice(names) for _ in range(rng.choice([1, 3, 10, 60]))).replace("▁", rng.choice(["▁", " ", ""]))
                      for _ in range(3000)])


def test_runs_and_long_words(library):
    compare(library, [" " * 5000, "a" * 5000, "abc" * 3000, "the" * 2000 + " " * 700 + "x", "x" + " " * 17,
                      *(" " * n + "x" for n in range(60)), *("=" * n for n in range(60)), "é" * 1000])


def test_rounds_equal_the_heap(library, monkeypatch):
    texts = some_texts(3, 60)
    flat, counts = pieces.model(PATH).encode(texts)
    monkeypatch.setattr(pieces, "LONG", 1)
    again, sizes = pieces.model(PATH).encode(texts)
    assert flat.tolist() == again.tolist() and counts.tolist() == sizes.tolist()


def test_slices_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 40)
    compare(library, [*some_texts(4, 60), " " * 500, "a" * 500, "aé" * 300])


def test_rounds_merge_several_words_at_once(monkeypatch, library):
    """The heap is not what short words take."""
    monkeypatch.setattr(pieces.PieceModel, "one_by_one", None)
    compare(library, some_texts(5, 100))


def test_decoding_any_ids(library):
    rng = random.Random(6)
    ids = [rng.choices([*range(3, 259), *range(259, 300), 2], k=rng.randint(0, 30)) for _ in range(3000)]
    got = pieces.model(PATH).decode(np.array(sum(ids, [])), np.array([len(i) for i in ids]))
    assert got == [library.decode(i) for i in ids]
    with pytest.raises(ValueError):
        pieces.model(PATH).decode(np.array([10 ** 6]), np.array([1]))


def test_tables(spark, library):
    texts = [None, "", "Hello  world\n", "Hello  world\n", "ünï ▁ 😀", "x" * 3000]
    docs = spark.createDataFrame([(i // 2, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    encoded = pieces.encode(docs)
    rows = [(r.doc_id, r.ids) for r in encoded.collect()]
    assert rows == [(i // 2, library.encode(t or "")) for i, t in enumerate(texts)]
    assert [r.text for r in pieces.decode(encoded).collect()] == [library.decode(library.encode(t or "")) for t in texts]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [tuple(r) for r in pieces.round_trip(docs).collect()] == [
        (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in rows]
    assert pieces.round_trip(docs.limit(0)).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0].text == ""
