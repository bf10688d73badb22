"""One query per operator, over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcgraph.llm import (decontaminate, langid, lengths, minhash, packing, phrases, pieces, prefixes, quality, suffixes,
                          toxicity, warc, whitening)
from srcgraph.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op2_quality(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op10_near_duplicates(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op8_packing(spark, folder):
    return packing.best_fit(table(spark, folder, "documents"))


@query
def op5_token_counts(spark, folder):
    return lengths.limits(lengths.histogram(lengths.lengths(table(spark, folder, "documents"))))


@query
def op6_decontamination(spark, folder):
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_warc(spark, folder):
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_language(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.fit(docs))


@query
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op1_phrases(spark, folder):
    return phrases.digest(phrases.removed(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op3_suffixes(spark, folder):
    return suffixes.digest(suffixes.removed(table(spark, folder, "documents")))


@query
def op11_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_prefix_trie(spark, folder):
    return prefixes.trie(table(spark, folder, "conversations"))


@query
def op13_pieces(spark, folder):
    return pieces.round_trip(table(spark, folder, "documents"))


def base32_sql(hexadecimal: str) -> str:
    """Base32 of 40 hexadecimal digits: five digits are four letters."""
    letters = []
    for i in range(0, 40, 5):
        value = f"('0x' || substr({hexadecimal}, {i + 1}, 5))::INTEGER"
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({value} >> {bits}) & 31) + 1, 1)" for bits in (15, 10, 5, 0)]
    return " || ".join(letters)


ORACLES["op9_warc"] = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM p)
    SELECT page_id, strlen(body) AS payload_bytes, {base32_sql('hex')} AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM q"""

CRC32_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
                          lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

ORACLES["op12_prefix_trie"] = f"""
    WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns,
                        ({CRC32_SQL} % 6)::BIGINT AS h
                 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
                FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
    prefixes AS (SELECT conv_id, d AS depth, turns[1:d] AS node, d = len(turns) AS ends
                 FROM rebuilt, unnest(range(len(turns) + 1)) AS r(d)),
    nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                     coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
              FROM prefixes GROUP BY node, depth),
    kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
                    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.node[depth].text) END AS own_saved
             FROM nodes n LEFT JOIN kids k USING (node)),
    sums AS (SELECT node[1:a] AS node, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens
             FROM told, unnest(range(depth + 1)) AS r(a) GROUP BY 1)
    SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens,
           sha256(t.ids) AS ends_sha256
    FROM told t JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = t.node[1:t.depth - 1] AND p.depth = t.depth - 1"""
