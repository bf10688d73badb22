"""Removal of repeated passages of words with Aho-Corasick automata.

Recurring passages are confirmed first: ``repeats`` finds the runs of 13-word
windows that an earlier document holds as well.  Their word sequences, fetched
from that earlier document, are the patterns.  They are sharded with the
documents they concern: a task compiles automata over the passages of a bounded
batch of documents and streams every document of the batch through its
automaton, which locates all occurrences word for word.  A word is removed if a
located passage covers it whose document has a smaller doc_id.

Null, empty and short texts lose nothing.  Of equal texts the one with the
smallest doc_id stays whole.  Rows without doc_id lose nothing and are never a
passage's source; rows that repeat a doc_id are the same document.
"""
from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from srcgraph.llm.repeats import repeated
from srcgraph.llm.tables import cut, map_arrow
from srcgraph.llm.words import Texts

WINDOW, GRAM = 13, 5
# Characters of patterns in one automaton; a single document may need more.
SHARD_CHARS = 600_000


def word_items(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    return texts.word_hashes(), texts.words[2]


def exploded(runs: DataFrame, window: int) -> DataFrame:
    """(doc_id, source, start, n_words): the passage of each run in the document it repeats."""
    def rows(batch):
        docs = np.asarray(batch.column(0))
        tables = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in batch.column(1)]
        found = np.concatenate(tables)
        yield pa.record_batch([pa.array(np.repeat(docs, [len(t) for t in tables])), pa.array(found[:, 2]), pa.array(found[:, 3]),
                               pa.array(found[:, 1] - 1 + window)], ["doc_id", "source", "start", "n_words"])
    return map_arrow(runs.select("doc_id", "spans"), rows, "doc_id long, source long, start long, n_words long").distinct()


def passages(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(source, start, n_words, passage): the words of each place, joined by blanks."""
    wanted = places.select("source", "start", "n_words").distinct().groupBy("source").agg(
        F.collect_list(F.struct("start", "n_words")).alias("places"))

    def cut_out(batch):
        sources, starts, sizes, texts = [], [], [], []
        for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = text.encode().split()
            for p in found:
                sources.append(doc)
                starts.append(p["start"])
                sizes.append(p["n_words"])
                texts.append(b" ".join(words[p["start"]:p["start"] + p["n_words"]]).decode())
        yield pa.record_batch([pa.array(sources, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                               pa.array(texts, pa.string())], ["source", "start", "n_words", "passage"])

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("source"), "text").join(wanted.hint("merge"), "source")
    return map_arrow(rows.select("source", "text", "places"), cut_out, "source long, start long, n_words long, passage string")


class Shard:
    """One automaton over the passages of a batch of documents."""

    def __init__(self, patterns: dict[str, tuple[int, int]]):
        self.automaton = ahocorasick.Automaton()
        for text, value in patterns.items():
            self.automaton.add_word(f" {text} ", value)
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def locate(self, doc: int | None, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Which words a passage of an earlier document covers, and how many passages were located."""
        edge = np.zeros(len(words) + 1, np.int64)
        found = 0
        if not self.empty and words and doc is not None:
            line = b" ".join(words).decode()
            size = np.fromiter((len(w) for w in line.split(" ")), np.int64, len(words))
            stops = np.cumsum(size + 1)  # place of the blank after each word, in the line with a leading blank
            for end, (source, n) in self.automaton.iter(f" {line} "):
                if source < doc:
                    last = int(np.searchsorted(stops, end))
                    edge[last + 1 - n] += 1
                    edge[last + 1] -= 1
                    found += 1
        return np.cumsum(edge[:-1]) > 0, found


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row, kept, n_words, n_removed, n_passages): each whole row of ``docs`` and the words left of its text, joined by blanks."""
    runs = repeated(docs, word_items, gram, window, sources=True)
    places, _ = cut(exploded(runs, window))
    texts, _ = cut(passages(docs, places))
    lists = places.join(texts.hint("merge"), ["source", "start", "n_words"]).groupBy("doc_id").agg(
        F.collect_list(F.struct("source", "n_words", "passage")).alias("passages"))
    counts = ["n_words", "n_removed", "n_passages"]
    schema = StructType([StructField("row", docs.schema), StructField("kept", StringType()), *[StructField(c, LongType()) for c in counts]])

    def stream(batches):
        held, size = [], 0
        for batch in batches:
            kind = batch.column(0).type
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(row)
                size += sum(len(p["passage"]) for p in row[1] or ())
                if size >= SHARD_CHARS or len(held) >= 4000:
                    yield finish(held, kind)
                    held, size = [], 0
        if held:
            yield finish(held, kind)

    def finish(held, kind):
        patterns: dict[str, tuple[int, int]] = {}
        for _, found in held:
            for p in found or ():
                old = patterns.get(p["passage"])
                if old is None or p["source"] < old[0]:
                    patterns[p["passage"]] = (p["source"], p["n_words"])
        shard = Shard(patterns)
        kept, numbers = [], []
        for row, _ in held:
            words = (row["text"] or "").encode().split()
            gone, found = shard.locate(row["doc_id"], words)
            left = [w for w, g in zip(words, gone.tolist()) if not g] if found else words
            kept.append(b" ".join(left).decode())
            numbers.append((len(words), len(words) - len(left), found))
        return pa.record_batch([pa.array([r for r, _ in held], kind), pa.array(kept, pa.string()),
                                *[pa.array(list(c), pa.int64()) for c in zip(*numbers)]], ["row", "kept", *counts])

    rows = docs.select(F.col("doc_id").alias("_doc"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(lists.withColumnRenamed("doc_id", "_doc").hint("merge"), "_doc", "left")
    return joined.select("row", "passages").mapInArrow(stream, schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_passages)."""
    return cleaned.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "n_passages")
