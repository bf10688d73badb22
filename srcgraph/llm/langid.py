"""Language identification in two steps.

A linear support vector machine per family (one against the rest) chooses the
language family; within it, one-versus-one machines for every pair of its
languages vote, ties going to the larger sum of margins and then to the first
code.  Features are hashed letter trigrams and whole words of the entire text.

The machines are trained here on at most ``SAMPLE`` documents that carry a
language and are not held out, as many of each language, chosen by a hash.
Only texts are features.  A text that is null or has no letter is ``und`` with
score 0; a language seen alone in its family needs no second step.  Without
any labelled row everything is ``und``.  Repeated rows are scored alike.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import held_out, labelled_sample, map_arrow
from srcgraph.llm.words import PART, Runs, U, owner, slices

SAMPLE = 2400
BINS = 2048
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, family string"

# fixed values: families of language codes; a code not listed is a family of its own
FAMILIES = {
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(texts: Runs) -> np.ndarray:
    """Unit vectors of log counts: trigram bins, then word bins."""
    data = texts.data.astype(np.uint32)
    where = owner(texts.bounds)
    out = np.zeros((texts.n, 2 * BINS), np.float32)
    if len(data) > 2:
        tri = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
        tri = (tri ^ (tri >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        ok = (where[:-2] == where[2:]) & (PART[texts.data[1:-1]])
        cell = where[:-2][ok] * BINS + (tri[ok] >> np.uint32(21)).astype(np.int64)
        out[:, :BINS] = np.bincount(cell, minlength=texts.n * BINS).reshape(texts.n, BINS)
    first = texts.words[2]
    cell = owner(first) * BINS + (texts.word_hashes() >> U(53)).astype(np.int64)
    out[:, BINS:] = np.bincount(cell, minlength=texts.n * BINS).reshape(texts.n, BINS)
    np.log1p(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 20) -> np.ndarray:
    """L2-regularised squared-hinge machine by dual coordinate descent; y is +1 or -1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    size = (x.astype(float) ** 2).sum(axis=1) + 0.5 / cost
    order = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - slope / size[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    chosen = labelled_sample(known, "lang", max(1, sample // len(languages)))

    def vectors(batch):
        for a, b, texts in slices(pc.utf8_lower(pc.fill_null(batch.column(1), "")), rows=1024):
            x = features(Runs(texts.data, texts.bounds)).astype(np.float16)
            yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                                   pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "lang", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang")
    rows = sorted(((r[0], r[1], bytes(r[2])) for r in map_arrow(joined, vectors, "doc_id long, lang string, x binary").collect()))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    lang = np.array([r[1] for r in rows])
    groups: dict[str, list[str]] = {}
    for code in sorted(set(lang.tolist())):
        groups.setdefault(FAMILY_OF.get(code, code), []).append(code)
    family = np.array([FAMILY_OF.get(c, c) for c in lang])
    names = sorted(groups)
    model = {"families": names, "groups": groups, "pairs": {}}
    model["family_w"] = np.stack([train_svm(x, np.where(family == f, 1.0, -1.0)) for f in names]) if len(names) > 1 else None
    for f in names:
        for one, two in itertools.combinations(groups[f], 2):
            part = (lang == one) | (lang == two)
            model["pairs"][one, two] = train_svm(x[part], np.where(lang[part] == one, 1.0, -1.0))
    return model


def decide(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Family, language and score of each vector."""
    names = model["families"]
    if model["family_w"] is None:
        chosen, sure = np.zeros(len(x), int), np.ones(len(x))
    else:
        margin = x @ model["family_w"][:, :-1].T + model["family_w"][:, -1]
        chosen = margin.argmax(axis=1)
        odds = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
        sure = (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
    lang, score = np.empty(len(x), object), np.zeros(len(x))
    for f, name in enumerate(names):
        at = np.flatnonzero(chosen == f)
        codes = model["groups"][name]
        votes, margins = np.zeros((len(at), len(codes))), np.zeros((len(at), len(codes)))
        for (one, two), w in model["pairs"].items():
            if one in codes:
                m = x[at] @ w[:-1] + w[-1]
                i, j = codes.index(one), codes.index(two)
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margins[:, i] += m
                margins[:, j] -= m
        best = (votes + margins / (1 + np.abs(margins).max(initial=0)) / 2).argmax(axis=1)
        lang[at] = [codes[k] for k in best]
        own = margins[np.arange(len(at)), best] / max(1, len(codes) - 1)
        score[at] = sure[at] * (1 / (1 + np.exp(-3 * own)) if len(codes) > 1 else 1.0)
    return np.array(names, object)[chosen], lang, score


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    def predict(batch):
        plain = pc.fill_null(batch.column(1), "")
        letters = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False)
        for a, b, texts in slices(pc.utf8_lower(plain), rows=1024):
            if model is None:
                family, lang, score = np.full(b - a, None, object), np.full(b - a, "und", object), np.zeros(b - a)
            else:
                family, lang, score = decide(features(Runs(texts.data, texts.bounds)), model)
            family, lang = np.where(letters[a:b], family, None), np.where(letters[a:b], lang, "und")
            yield pa.record_batch([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a),
                                   pa.array(lang, pa.string()), pa.array(np.where(letters[a:b], score, 0.0)),
                                   pa.array(family, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "family"])
    return map_arrow(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), predict, SCHEMA)
