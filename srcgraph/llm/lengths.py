"""Exact length histogram of token counts.

Documents are aggregated by their encoded length; sums over the longer lengths
then answer, for every context limit, how many documents are cut, how many
tokens stay and what is lost, and quantiles exactly.  Texts are encoded whole.
Null and empty texts have length 0.  Repeated rows count each time.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from srcgraph.llm.tables import cut, map_arrow
from srcgraph.llm.tokens import default_path, encoder

# Lengths summed together before the sums over longer lengths, so that no window holds all of them.
SPAN = 1024


def lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens)."""
    path = vocabulary or default_path()

    def count(batch):
        coder = encoder(path)
        yield pa.record_batch([batch.column(0).cast(pa.int64()),
                               pa.array([len(coder.ids(t)) // 4 for t in batch.column(1).to_pylist()], pa.int64())],
                              ["doc_id", "n_tokens"])
    return map_arrow(docs.select("doc_id", "text"), count, "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, docs): documents of each length."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per length that occurs, read as a context limit.

    docs_over and tokens_over are the documents longer than the limit and their
    tokens, tokens_kept what truncation to the limit leaves of all documents,
    tokens_lost what it cuts, and share the part of documents that fit: the
    quantile q of the lengths is the least limit whose share is at least q.
    """
    hist, _ = cut(hist)  # it is read twice below
    sized = hist.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    spans = sized.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spans = spans.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"),
                         F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
                         F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    longer = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(spans, "span").select(
        "n_tokens", "docs", "all_docs", "all_tokens",
        (F.coalesce(F.sum("docs").over(longer), F.lit(0)) + F.col("d")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t")).alias("tokens_over"))
    lost = F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")
    return rows.select("n_tokens", "docs", "docs_over", "tokens_over", (F.col("all_tokens") - lost).alias("tokens_kept"),
                       lost.alias("tokens_lost"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(q, n_tokens): the least limit that holds each share of the documents."""
    cells = [F.min(F.when(F.col("share") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    return table.agg(*cells).select(F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
