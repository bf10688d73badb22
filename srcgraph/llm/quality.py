"""Line sequence labelling for document quality.

A linear-chain conditional random field marks each line of a text as content or
boilerplate; Viterbi decoding finds the best sequence of marks and the share of
word characters in content lines decides whether the document stays.

The model is trained here by maximum likelihood (forward-backward, L2) on at
most ``PER_CLASS`` documents of either quality label, whose lines take the
label of their document.  Lines that look alike in good and bad documents so
come out as content.  Without both labels nothing can be learned; every line
then counts as content.

Null and empty texts have no lines: zero counts, ``base_failed`` (fewer than
ten words), not kept.  Repeated rows are scored alike; more columns of the
input are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import labelled_sample, map_arrow
from srcgraph.llm.words import SPACE, Texts, mix, owner, prefix, slices, span_sums, windows, BASE, TABLE, U

PER_CLASS = 1500
MIN_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")


def flags(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


SYMBOLS = flags("#*$%&|<>")
UPPER = flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
DIGIT = flags("0123456789")
STOP = flags(".?!:;\"')")


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, the first line of each text, duplicate marks, word characters."""
    starts, ends, first = texts.lines()
    data = texts.data
    word_starts, word_ends, _ = texts.words
    word = texts.word_hashes()

    def count(marks: np.ndarray) -> np.ndarray:
        total = prefix(marks)
        return (total[ends] - total[starts]).astype(float)

    inside = ~SPACE[data]
    chars = count(inside & ((data & 0xC0) != 0x80))
    w0, w1 = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    words = (w1 - w0).astype(float)
    upper = UPPER[data].copy()
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    again = np.zeros(len(word) + 1, bool)
    again[1:-1] = word[1:] == word[:-1]
    repeats = prefix(again)
    line = mix(span_sums(TABLE[data], BASE, starts, ends) + (ends - starts).astype(U))
    doc = owner(first)
    same = mix(line ^ mix(doc.astype(U) + U(1)))
    order = np.argsort(same, kind="stable")
    duplicate = np.zeros(len(line), bool)
    duplicate[order[1:]] = same[order[1:]] == same[order[:-1]]
    some = np.maximum(chars, 1)
    letters = np.maximum(count(LETTER[data] & ((data & 0xC0) != 0x80)), 1)
    bars, loud = count(data == ord("|")), count(data == ord("!"))
    last = data[word_ends[np.maximum(w1 - 1, 0)] - 1] if len(starts) else np.empty(0, np.uint8)
    features = np.column_stack([
        np.ones(len(starts)), words >= 3, words >= 10, words >= 40, np.minimum(chars / np.maximum(words, 1) / 10, 2),
        count(upper) / letters, count(upper) > 0.5 * letters, count(SYMBOLS[data]) / some, count(SYMBOLS[data]) > 0.08 * some,
        bars / np.maximum(words, 1), loud / np.maximum(words, 1), count(DIGIT[data]) / some,
        (repeats[w1] - repeats[np.minimum(w0 + 1, len(again))]) / np.maximum(words, 1), duplicate, STOP[last],
        1 - (letters / some).clip(0, 1)]).astype(np.float64)
    return features, first, duplicate, chars


N_FEATURES = 16


def forward_backward(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Marginals of marks and of moves; texts advance together, one line a step."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    deepest = int(length.max(initial=0))
    alive = [int(np.searchsorted(-length[order], -t, "left")) for t in range(deepest)]
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    at = first[:-1][order]
    for t in range(deepest):
        i = at[:alive[t]] + t
        alpha[i] = score[i] + (start if t == 0 else np.logaddexp.reduce(alpha[i - 1][:, :, None] + move, axis=1))
    for t in range(deepest - 2, -1, -1):
        i = at[:alive[t + 1]] + t
        beta[i] = np.logaddexp.reduce(move[None] + (score[i + 1] + beta[i + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(alpha + beta, axis=1)
    marginal = np.exp(alpha + beta - total[:, None])
    follows = np.ones(len(score), bool)
    follows[first[:-1][length > 0]] = False
    j = np.flatnonzero(follows)
    pair = np.exp(alpha[j - 1][:, :, None] + move + (score[j] + beta[j])[:, None, :] - total[j][:, None, None])
    return marginal, pair.sum(axis=0), j


def train(features: np.ndarray, first: np.ndarray, marks: np.ndarray, steps: int = 120, l2: float = 1e-3) -> dict:
    """Maximum-likelihood weights by gradient ascent with per-weight rates (Adam)."""
    theta = np.zeros(2 * N_FEATURES + 6)
    speed, square = np.zeros_like(theta), np.zeros_like(theta)
    truth = np.eye(2)[marks]
    length = np.diff(first)
    heads = first[:-1][length > 0]
    for step in range(1, steps + 1):
        w, move, start = theta[:2 * N_FEATURES].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        marginal, pair, j = forward_backward(features @ w, first, move, start)
        gap = truth - marginal
        seen = np.zeros((2, 2))
        np.add.at(seen, (marks[j - 1], marks[j]), 1)
        slope = np.concatenate([(features.T @ gap).ravel(), (seen - pair).ravel(), gap[heads].sum(axis=0)]) / len(marks) - l2 * theta
        speed, square = 0.9 * speed + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        theta = theta + 0.1 * (speed / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return {"w": theta[:2 * N_FEATURES].reshape(-1, 2), "move": theta[-6:-2].reshape(2, 2), "start": theta[-2:]}


def viterbi(score: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best mark (1 content) of each line; a tie goes to content."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    deepest = int(length.max(initial=0))
    alive = [int(np.searchsorted(-length[order], -t, "left")) for t in range(deepest)]
    at = first[:-1][order]
    best, back = np.zeros_like(score), np.zeros(score.shape, np.int8)
    for t in range(deepest):
        i = at[:alive[t]] + t
        if t == 0:
            best[i] = score[i] + start
            continue
        via = best[i - 1][:, :, None] + move
        back[i] = via[:, 1] >= via[:, 0]
        best[i] = score[i] + via.max(axis=1)
    mark = np.zeros(len(score), np.int8)
    for t in range(deepest - 1, -1, -1):
        i = at[:alive[t]] + t
        ends = length[order[:alive[t]]] == t + 1
        mark[i[ends]] = best[i[ends], 1] >= best[i[ends], 0]
        if t:
            mark[i - 1] = back[i, mark[i]]
    return mark


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Train on the lines of a bounded sample of labelled documents."""
    sample = labelled_sample(labels, "quality", per_class)

    def lines(batch):
        for a, b, texts in slices(batch.column(1)):
            features, first, _, _ = line_features(texts)
            quality = batch.column(2).slice(a, b - a)
            cells = [features[first[i]:first[i + 1]].astype(np.float32).tobytes() for i in range(b - a)]
            yield pa.record_batch([quality, pa.array(cells, pa.binary())], ["quality", "cells"])

    rows = map_arrow(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), lines,
                     "quality int, cells binary").collect()
    rows = sorted(((int(r[0]), bytes(r[1])) for r in rows if len(r[1])))
    if len({q for q, _ in rows}) < 2:
        return None
    found = [np.frombuffer(c, np.float32).reshape(-1, N_FEATURES) for _, c in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    marks = np.repeat([int(q > 0) for q, _ in rows], np.diff(first))
    return train(np.concatenate(found).astype(float), first, marks)


def measures(texts: Texts, model: dict | None, min_share: float = MIN_SHARE) -> dict[str, np.ndarray]:
    features, first, duplicate, chars = line_features(texts)
    starts, _, word_first = texts.words
    inside = ~SPACE[texts.data]
    n_words = np.diff(word_first)
    at, window = windows(texts.word_hashes(), word_first, WINDOW)
    doc = owner(word_first)
    key = mix(window ^ mix(doc[at].astype(U) + U(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    n_repeat = np.diff(prefix(np.cumsum(edge[:-1]) > 0)[word_first])
    if model is None:
        mark = np.ones(len(features), np.int8)
    else:
        mark = viterbi(features @ model["w"], first, model["move"], model["start"])
    share_all = np.diff(np.concatenate([[0.0], np.cumsum(chars)])[first])
    share_good = np.diff(np.concatenate([[0.0], np.cumsum(chars * mark)])[first])
    share = share_good / np.maximum(share_all, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": texts.sums(inside & ((texts.data & 0xC0) != 0x80)),
            "n_symbols": texts.sums(SYMBOLS[texts.data]), "n_dup_lines": np.diff(prefix(duplicate)[first]),
            "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & (share >= min_share),
            "n_lines": np.diff(first), "n_content_lines": np.diff(prefix(mark)[first]), "content_share": share}


def quality(docs: DataFrame, model: dict | None, min_share: float = MIN_SHARE) -> DataFrame:
    """Counts and verdict of each document."""
    def score(batch):
        for a, b, texts in slices(batch.column(1)):
            found = measures(texts, model, min_share)
            yield pa.record_batch([batch.column(0).slice(a, b - a).cast(pa.int64()), *map(pa.array, found.values())],
                                  ["doc_id", *found])
    return map_arrow(docs.select("doc_id", "text"), score, SCHEMA)


def keep(docs: DataFrame, model: dict | None, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows of ``docs``, all columns, whose text passes; decided in one pass without a join."""
    def choose(batches):
        for batch in batches:
            texts_of = batch.column(batch.schema.get_field_index("text"))
            kept = [measures(texts, model, min_share)["kept"] for _, _, texts in slices(texts_of)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))
    return docs.mapInArrow(choose, docs.schema)
