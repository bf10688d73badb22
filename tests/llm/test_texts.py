"""Quality, decontamination, packing and lengths, languages, toxicity, archives."""
import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward, table, words
from pyspark.sql import functions as F

from srcgraph.llm import decontaminate, langid, lengths, packing, quality, toxicity, warc
from srcgraph.llm.queries import QUERIES
from srcgraph.llm.tables import cut, held_out
from srcgraph.llm.tables import table as read
from srcgraph.llm.tokens import WordEncoder, default_path

FOLDER = "/root/testdata/sf0.01"


# --- quality -------------------------------------------------------------------
def base_counts(text):
    w = words(text)
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            duplicates += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered), failed)


def test_base_counts(spark):
    rows = awkward(8) + [(900, "a|b <c> #é\na|b <c> #é\n\na|b <c> #é"), (901, "x y z " * 30)]
    found = quality.quality(table(spark, rows), None).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found} == {
        i: base_counts(t) for i, t in rows}
    assert all(r.kept == (not r.base_failed) for r in found)  # without a model every line is content


def test_viterbi_and_marginals_match_enumeration():
    rng = np.random.default_rng(5)
    first = np.array([0, 4, 4, 5, 11])
    score, move, start = rng.normal(size=(11, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    marks = quality.viterbi(score, first, move, start)
    marginal, pairs, _ = quality.forward_backward(score, first, move, start)
    seen = np.zeros((2, 2))
    for a, z in zip(first, first[1:]):
        if a == z:
            continue
        value = {m: start[m[0]] + sum(score[a + i, k] for i, k in enumerate(m)) + sum(move[i, j] for i, j in zip(m, m[1:]))
                 for m in itertools.product((0, 1), repeat=int(z - a))}
        assert tuple(marks[a:z]) == max(value, key=value.get)
        total = sum(np.exp(v) for v in value.values())
        for i in range(z - a):
            assert np.isclose(marginal[a + i, 1], sum(np.exp(v) for m, v in value.items() if m[i]) / total)
        for m, v in value.items():
            for i, j in zip(m, m[1:]):
                seen[i, j] += np.exp(v) / total
    assert np.allclose(pairs, seen)


def test_line_model_on_labels_it_has_not_seen(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(bad) <= 0.4 * len(bad)
    kept = {r.doc_id for r in quality.keep(docs, model).collect()}
    assert kept == {r.doc_id for r in quality.quality(docs, model).where("kept").collect()}


# --- decontamination -------------------------------------------------------------
def test_windows_match_a_scan_of_all(spark):
    """Every window as long as an item, scored exactly; edits, order, short and empty items included."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate((5, 18, 30, 60, 3))] + [(7, None), (8, ""), (9, "?!")]
    own = lambda k: rng.choices(vocabulary, k=k)
    rows = []
    for n in range(60):
        item = items[n % 5][1].split()
        if n % 3 == 0 and len(item) > 10:
            item[-1] = "changed"
        if n % 7 == 0 and len(item) > 20:
            item[len(item) // 2] = "other"
        rows.append((n, " ".join(own(20)) + " " + ", ".join(item).upper() + "! " + " ".join(own(15)) if n % 4 else " ".join(own(40))))
    rows += [(100, None), (101, ""), (102, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.leaks(table(spark, rows), bench).collect()}
    search = decontaminate.Items(items)
    names = {item: i for i, (item, *_) in enumerate(search.items)}
    want = {}
    for doc, text in rows:
        w = [x.encode() for x in decontaminate.TOKEN.findall((text or "").lower())]
        for item, i in names.items():
            _, n, k, grams = search.items[i]
            best = (-1, 0.0)
            for at in range(len(w) - n + 1):
                h = decontaminate.hashes_of(w[at:at + n])
                s = search.similarity(decontaminate.windows(h, np.array([0, n]), k)[1].tolist(), i)
                if s > best[1]:
                    best = (at, s)
            if best[1] >= 0.8:
                want[doc, item] = best
    assert want and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_items_and_documents_share_one_lower_case(spark):
    for text in ("İstanbul", "ΟΔΟΣ"):
        item = " ".join([*(f"a{i}" for i in range(9)), text, *(f"b{i}" for i in range(10))])
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        got = decontaminate.leaks(table(spark, [(0, f"x y {item} z"), (1, f"x y {item.lower()[:20]} z")]), bench).collect()
        assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in got] == [(0, 1, 2, 1.0)], text


def test_chunks_do_not_change_similarities(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(200)]
    common = rng.choices(vocabulary, k=25)
    items = [(i, " ".join(common + rng.choices(vocabulary, k=8))) for i in range(12)] + [(20, " ".join(rng.choices(vocabulary, k=30)))]
    rows = [(i, " ".join(["x", *t.split()[:-1], "changed", "y"])) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(tuple, decontaminate.leaks(table(spark, rows), bench, 0.5, 64, limit).collect())) for limit in (1 << 20, 300))
    assert len(whole) >= len(items) and parts == whole


def test_every_place_is_reported(spark):
    """Copies side by side, more of them than a block of windows holds, and one with a change, each once."""
    item = [f"word{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    many = 2 * decontaminate.BLOCK // 20 + 3
    rows = [(0, " ".join(item * 2)), (1, " ".join(["x", *item, *(f"y{i}" for i in range(50)), *item])), (2, " ".join(item * many)),
            (3, " ".join([*item, *item[:-1], "changed", *item]))]
    got = {}
    for r in decontaminate.leaks(table(spark, rows), bench).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.similarity))
    assert sorted(got[0]) == [(0, 1.0), (20, 1.0)] and sorted(got[1]) == [(1, 1.0), (71, 1.0)]
    assert sorted(got[2]) == [(20 * i, 1.0) for i in range(many)]
    assert [s for s, _ in sorted(got[3])] == [0, 20, 40] and min(got[3], key=lambda x: x[1])[0] == 20
    assert {r.doc_id: r.n_places for r in decontaminate.contaminated(table(spark, rows), bench).collect()} == {0: 2, 1: 2, 2: many, 3: 3}


def test_rare_endings_of_a_common_template_are_found(spark):
    """Items that differ in the last word only: similarity 0.85 by weight, but fingerprints far apart."""
    template = " ".join(f"word{i}" for i in range(69))
    items = [(i, f"{template} end{i}") for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, [(1, f"{template} other")]), bench).collect()
    assert sorted(r.item_id for r in got) == [i for i, _ in items]
    assert all(0.8 < r.similarity < 0.9 for r in got) and max(r.hamming for r in got) > decontaminate.RADIUS


def test_blocks_find_all_within_the_radius():
    items = decontaminate.Items([(i, " ".join(f"a{i}b{j}" for j in range(20))) for i in range(30)], radius=9)
    rng = np.random.default_rng(1)
    flips = rng.integers(0, 64, (400, 12))
    prints = items.prints[3] ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1)
    assert (items.near(prints, 3) == (np.bitwise_count(prints ^ items.prints[3]) <= 9)).all()


# --- tokens, packing, lengths ------------------------------------------------------
TRICKY = ["a'S b's it'll they'd", "x_y__z a\tb\x0bc\x1cd", "ÀÉ İstanbul ΣΑΣ straße ªº ×÷", "<|endoftext|> a<|startoftext|>b", "", "  ",
          "é e ́x", "日本語 テスト 123٣", "!!!'s ''s  x y", " \n\n a ", "Thnd*** a$b 12.5%", "ẞ ŸÿŠ"]


def test_word_by_word_is_the_whole_encoding():
    coder = WordEncoder(default_path())
    for text in TRICKY + [t for _, t in awkward(2) if t]:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rows = awkward(5) + list(zip(range(500, 600), TRICKY)) + [(700, "long " * 9000)]
    coder = WordEncoder(default_path())
    want = {}
    for doc, text in rows:
        ids = coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want[doc, n] = (at, len(part), zlib.crc32(part.tobytes()))
    many = packing.best_fit(table(spark, rows), shard_pieces=50).collect()
    assert len({(r.doc_id, r.piece) for r in many}) == len(many) and max(r.offset + r.length for r in many) <= 4096
    places = {}
    for r in many:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(l for _, l in sorted(p)[:i]) == o for p in places.values() for i, (o, _) in enumerate(sorted(p)))
    found = packing.best_fit(table(spark, rows), shard_tokens=20_000).collect()
    assert len(found) == len(many)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_sum_of_squares_rule():
    """The same bins as trying every choice and adding up the squares."""
    rng = random.Random(6)
    lengths_ = [rng.randint(1, 30) for _ in range(300)]
    bins = packing.sum_of_squares(np.array(lengths_), 30)
    fill, count = {}, Counter()
    for size, place in zip(lengths_, bins.tolist()):
        def cost(gap):
            after = count.copy()
            if gap < 30:
                after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            return sum(v * v for v in after.values())
        gap = 30 - fill.get(place, 0)
        choices = [g for g in count if count[g] > 0 and g >= size] + [30]
        assert cost(gap) == min(map(cost, choices))
        if gap < 30:
            count[gap] -= 1
        if gap > size:
            count[gap - size] += 1
        fill[place] = fill.get(place, 0) + size
    assert max(fill.values()) <= 30 and len(fill) <= 1.1 * sum(lengths_) / 30


def test_few_sequences(spark):
    found = QUERIES["op8_packing"](spark, FOLDER).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert found.n <= 1.02 * found.tokens / 4096 + 2


def test_length_histogram(spark):
    rows = [(i, "word " * (i * 37 % 50)) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 3000)]
    counts = lengths.lengths(table(spark, rows))
    n = {r.doc_id: r.n_tokens for r in counts.collect()}
    assert n == {i: len((t or "").split()) for i, t in rows}
    found = {r.n_tokens: r for r in lengths.limits(lengths.histogram(counts)).collect()}
    assert set(found) == set(n.values())
    for limit, r in found.items():
        assert (r.docs, r.docs_over, r.tokens_over) == (
            sum(v == limit for v in n.values()), sum(v > limit for v in n.values()), sum(v for v in n.values() if v > limit))
        assert r.tokens_kept == sum(min(v, limit) for v in n.values())
        assert r.tokens_lost == sum(n.values()) - r.tokens_kept and abs(r.share - sum(v <= limit for v in n.values()) / len(n)) < 1e-12
    ordered = sorted(n.values())
    found = lengths.quantiles(lengths.limits(lengths.histogram(counts)), [0.1, 0.5, 1.0]).collect()
    assert [r.n_tokens for r in found] == [ordered[max(0, -(-len(ordered) * q // 10) - 1)] for q in (1, 5, 10)]


# --- languages and toxicity -------------------------------------------------------
def test_languages_held_out(spark):
    docs = read(spark, FOLDER, "documents")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the thing")], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_unlisted_and_single_languages(spark):
    rows = [(i, f"aa{i % 5} bb cc", "xx", "s") for i in range(40)] + [(100 + i, f"zz{i % 5} yy ww", None, "s") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()} == {"xx"}


def test_toxicity_held_out(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hits = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert sum(false) <= 0.05 * len(false) and sum(hits) >= 0.5 * len(hits)
    plain, scaled = (toxicity.fit(docs, x) for x in (labels, labels.withColumn("toxic", F.col("toxic") * (1 + F.col("doc_id") % 3))))
    assert plain["lexicon"] == scaled["lexicon"] and (plain["values"] == scaled["values"]).all(), "any positive label counts as 1"
    model = toxicity.fit(docs, labels.where("false"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 5000)], "doc_id long, text string")
    assert [(r.score, r.predicted) for r in toxicity.score(odd, model).collect()] == [(0.0, 0)] * 3


def test_isotonic_is_monotone_and_pools():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]), np.ones(6))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and np.isclose(np.interp(2.5, knots, values), 0.5)


# --- archives ------------------------------------------------------------------------
def expected(rows, least=0):
    payload = {i: (h or "").encode() for i, h in rows}
    last = {}
    for i, p in payload.items():
        last[p] = max(i, last.get(p, i))
    return {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if len(p) < least or last[p] == i else "revisit",
                None if len(p) < least or last[p] == i else last[p]) for i, p in payload.items()}


@pytest.mark.parametrize("split,least", [(1 << 20, 0), (97, 0), (1000, 20)])
def test_archives_round_trip(spark, split, least):
    """Ranges much smaller than records, payloads that hold gzip magic and WARC headers, equal and empty payloads."""
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(0, 255)) for _ in range(30_000))
    fake = "\x1f\x8b\x08 WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    html = [None, "", "<p>a</p>", "<p>a</p>", fake * 20, noise, noise, "é" * 1000, "\r\n\r\n", "x" * 100_000] + [f"<p>{i}</p>" for i in range(30)]
    rows = list(enumerate(html))
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nZ: y", h, "more") for i, h in rows], "page_id long, url string, html string, digest string")
    found = warc.round_trip(pages, least, split).collect()
    assert len(found) == len(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == expected(rows, least)
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in found if r.record_type == "response")


def test_stored_gzip_bytes_are_no_record(spark, tmp_path):
    """A member whose compressed bytes hold a whole other member is one record."""
    inner = gzip.compress(warc.record(1, "u", b"inner", None, False))
    data = warc.record(2, "u", inner, None, False)
    outer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the inner bytes appear as they are
    raw = outer.compress(data) + outer.flush() + warc.member(warc.record(3, "u", b"next", None, False))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(raw)
    files = spark.createDataFrame([(str(path), len(raw))], "path string, size long")
    assert sorted(r.page_id for r in warc.read(files, 1 << 20).collect()) == [2, 3]


# --- all queries on empty tables -------------------------------------------------------
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        read(spark, "/root/testdata/sf0.001", t).where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_cut_and_held_out(spark):
    frame, seen = cut(spark.range(10).withColumn("h", held_out(F.col("id"))))
    assert seen["n"] == 10 and {r.id: r.h for r in frame.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(10)}
