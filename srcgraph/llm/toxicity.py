"""Toxicity by boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: density of lexicon words, plain and after undoing
digit and symbol disguises, their closeness to second-person words, capitals,
punctuation, and rates of disguised words.  The lexicon is a short list of
insults and what is learned: words whose document frequency is much higher
among toxic documents.

Everything is learned on at most ``PER_CLASS`` labelled documents of each class
that are not held out, chosen by a hash and split by another hash into a part
for the lexicon and a part for the trees.  The calibration learns from scores
that trees of other folds gave, so nothing judges what it has learned from, and
weighs the classes as they occur among all labelled rows.  Only the text is an input of a score.  Null and empty texts
get the score of a text without words.  Without both classes every score is
the share of toxic labels (0 if there are none).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import held_out, labelled_sample, map_arrow
from srcgraph.llm.words import PART, Runs, U, owner, prefix, slices, hashes_of

PER_CLASS = 4000
LEXICON = 256
NEAR = 5
THRESHOLD = 0.3
DEPTH, TREES, RATE, LEAF, FOLDS = 3, 60, 0.15, 20, 3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
# fixed values: second-person words, and what digits and signs stand for
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros"]
# fixed values: insults that the learned lexicon starts from
INSULTS = ["idiot", "idiots", "idiotic", "moron", "morons", "stupid", "dumb", "fool", "clown", "loser", "losers", "scum", "trash",
           "garbage", "pathetic", "worthless", "disgusting", "jerk", "bastard", "bitch", "asshole", "dumbass", "shit", "fuck",
           "fucking", "crap", "retard", "freak", "creep", "vermin", "dummkopf", "arschloch", "scheisse", "trottel", "abschaum",
           "cretin", "crétin", "connard", "merde", "salaud", "imbécile", "imbécil", "idiota", "estúpido", "mierda", "cabrón", "basura"]
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in DISGUISE.items():
    PLAIN[ord(_sign)] = ord(_letter)
LETTER = np.zeros(256, bool)
LETTER[list(range(97, 123)) + list(range(128, 256))] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


class Flat(Runs):
    """Runs after undoing disguises; signs that stand for nothing are blanks."""

    def __init__(self, data, bounds):
        super().__init__(PLAIN[data], bounds)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return table[at] == values if len(table) else np.zeros(len(values), bool)


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where(UPPER[data], data + 32, data).astype(np.uint8)


def features(texts, lexicon: np.ndarray) -> np.ndarray:
    """One row per text; ``lexicon`` holds sorted hashes of words."""
    low = lowered(texts.data)
    runs = Runs(low, texts.bounds)
    starts, ends, first = runs.words
    hashes = runs.word_hashes()
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)

    def per_text(marks, bound=first):
        total = prefix(marks)
        return (total[bound[1:]] - total[bound[:-1]]).astype(float)

    hit = among(hashes, lexicon)
    second = among(hashes, YOU)
    # lexicon words with a second-person word at most NEAR words away in the same text
    seen = prefix(second)
    doc = owner(first)
    a = np.maximum(np.arange(len(hashes)) - NEAR, first[:-1][doc])
    z = np.minimum(np.arange(len(hashes)) + NEAR + 1, first[1:][doc])
    close = hit & (seen[z] > seen[a])
    flat = Flat(low, texts.bounds)
    flat_first = flat.words[2]
    flat_hits = np.diff(prefix(among(flat.word_hashes(), lexicon))[flat_first]).astype(float)
    data, chars = texts.data, np.maximum(np.diff(texts.bounds), 1).astype(float)
    letters = np.maximum(texts.sums(LETTER[low]), 1).astype(float)
    digits = (low >= 48) & (low <= 57)
    # blank-separated words with a letter that also hold digits or signs between letters
    w0, w1, wf = texts.words
    mixed_sign = np.zeros(len(low), bool)
    mixed_sign[1:-1] = ~LETTER[low[1:-1]] & LETTER[low[:-2]] & LETTER[low[2:]] & (low[1:-1] > 32)
    inner = prefix(mixed_sign)
    caps = prefix(UPPER[data])
    long_caps = (caps[w1] - caps[w0] >= 3) & (caps[w1] - caps[w0] == prefix(LETTER[low])[w1] - prefix(LETTER[low])[w0])
    three = np.zeros(len(low), bool)
    three[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & LETTER[low[2:]]
    hits = per_text(hit)
    pieces = np.maximum(np.diff(wf), 1).astype(float)
    return np.column_stack([
        np.log1p(n), hits / some, np.log1p(hits), hits > 0, np.maximum(flat_hits - hits, 0), (flat_hits / some),
        per_text(close), per_text(close) / np.maximum(hits, 1), per_text(second) / some,
        texts.sums(UPPER[data]) / letters, np.diff(prefix(long_caps)[wf]) / pieces,
        texts.sums(data == ord("!")) / chars, texts.sums(data == ord("?")) / chars,
        texts.sums(~PART[low] & (low > 32)) / chars, texts.sums(digits) / chars,
        np.diff(prefix(inner[w1] > inner[w0])[wf]) / pieces, texts.sums(three) / chars, texts.sums(low >= 128) / chars,
        chars / some])


YOU = np.sort(hashes_of([w.encode() for w in SECOND_PERSON]))


def boosted(x: np.ndarray, y: np.ndarray) -> dict:
    """Gradient boosting of the logistic loss with complete trees of fixed depth on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    margin = np.full(len(y), base)
    leaf = min(LEAF, max(3, len(y) // 60))
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, np.inf)
        for level in range(DEPTH):
            width, offset = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-6)
            split = np.full(width, 1 << 30)
            for f, e in enumerate(edges):
                cell = node * 33 + binned[:, f]
                g, h, c = (np.bincount(cell, v, width * 33).reshape(width, 33).cumsum(axis=1) for v in (slope, curve, np.ones(len(y))))
                gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g ** 2 / (h + 1) + gr ** 2 / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < leaf) | (cr < leaf)] = -1
                gain[:, len(e):] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], split[k] = top[k], at[k]
                    feature[offset + k], threshold[offset + k] = f, e[at[k]]
            here = offset + node
            node = 2 * node + (x[np.arange(len(y)), feature[here]] > threshold[here])
        leaves = 2 ** DEPTH
        value = RATE * np.bincount(node, slope, leaves) / (np.bincount(node, curve, leaves) + 1)
        margin += value[node]
        trees.append((feature, threshold, value))
    return {"base": base, "feature": np.stack([t[0] for t in trees]), "threshold": np.stack([t[1] for t in trees]),
            "value": np.stack([t[2] for t in trees])}


def margins(x: np.ndarray, trees: dict) -> np.ndarray:
    out = np.full(len(x), trees["base"])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(trees["feature"], trees["threshold"], trees["value"]):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            here = 2 ** level - 1 + node
            node = 2 * node + (x[rows, feature[here]] > threshold[here])
        out += value[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from margin to share."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, sum of w, least and greatest margin
    for m, t, w in zip(margin[order], y[order], weight[order]):
        blocks.append([w * t, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2], high]
    knots, values = [], []
    for s, w, low, high in blocks:
        knots += [low, high]
        values += [s / w] * 2
    return np.array(knots), np.array(values)


def learn_lexicon(sample: DataFrame, counts: dict[int, int], size: int = LEXICON) -> list[str]:
    """Words much more frequent among toxic documents, by smoothed log odds of document frequency."""
    def words(batch):
        texts, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = lowered(np.frombuffer((text or "").encode(), np.uint8))
            own = {w.decode("utf-8", "replace") for w in np.where(PART[raw], raw, np.uint8(32)).tobytes().split()}
            texts += own
            toxic += [int(label)] * len(own)
        yield pa.record_batch([pa.array(texts, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    one, zero = counts.get(1, 0), counts.get(0, 0)
    found = map_arrow(sample.select("text", "toxic"), words, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log(((F.col("t") + 0.5) / (one + 1)) / ((F.col("n") - F.col("t") + 0.5) / (zero + 1)))
    least = max(4, one // 200)
    return [r.word for r in found.withColumn("odds", odds).where((F.col("t") >= least) & (F.col("odds") > 1.2))
            .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word").limit(size).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    total = {int(r[0] > 0): r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = labelled_sample(known, "toxic", per_class)
    # a tenth is a hash digit: 0-3 lexicon, 4-9 trees and calibration
    tenth = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(10)).cast("int")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", tenth.alias("tenth"))
    first = sample.where("tenth < 4")
    counts = {int(r[0] > 0): r[1] for r in first.groupBy("toxic").count().collect()}
    lexicon = learn_lexicon(first, counts)
    lexicon = sorted({*INSULTS, *lexicon})
    table = np.sort(hashes_of([w.encode() for w in lexicon]))
    share = total.get(1, 0) / max(1, sum(total.values()))
    model = {"lexicon": lexicon, "table": table, "trees": None, "share": share}

    def rows(batch):
        for a, b, texts in slices(batch.column(1), rows=1024):
            x = features(texts, table)
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a),
                                   pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "tenth", "x"])

    got = sorted(map_arrow(sample.where("tenth >= 4"), rows, "doc_id long, toxic int, tenth int, x array<double>").collect())
    y = np.array([float(r.toxic > 0) for r in got])
    if len(set(y.tolist())) < 2:
        return model
    x, part = np.array([r.x for r in got]), np.array([r.tenth % FOLDS for r in got])
    model["trees"] = boosted(x, y)
    apart = np.empty(len(y))
    for k in range(FOLDS):
        apart[part == k] = margins(x[part == k], boosted(x[part != k], y[part != k]))
    each = [total.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)]
    model["knots"], model["values"] = isotonic(apart, y, np.where(y > 0, each[1], each[0]))
    return model


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    def predict(batch):
        for a, b, texts in slices(batch.column(1), rows=1024):
            if model["trees"] is None:
                p = np.full(b - a, float(model["share"]))
            else:
                p = np.interp(margins(features(texts, model["table"]), model["trees"]), model["knots"], model["values"]).clip(0, 1)
            yield pa.record_batch([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a), pa.array(p),
                                   pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), predict, SCHEMA)
