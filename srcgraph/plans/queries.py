"""Queries over the test tables, each with the SQL that must give the same rows."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from srcgraph.functions.domains import domain_rows, domain_table
from srcgraph.functions.fixed import (
    CLUSTER_HINTS, FILE_NAME_ROWS, KEYWORD_ROWS, SPLIT_MIN_SYMBOLS, STRUCTURAL_TAGS,
)
from srcgraph.functions.languages import BUILTIN_LANGUAGES
from srcgraph.functions.purpose import exempt_from_dead, keyword_purpose, name_purpose, size_purpose
from srcgraph.functions.score import file_score, heat_label
from srcgraph.operators import compare, documents, graph, model, parse, refresh, resolve, splits, usage, views
from srcgraph.operators.skew import grown
from srcgraph.plans import derived
from srcgraph.plans.engine import Engine
from srcgraph.session import cut, dealt, new_path, remove_path, shared_folder, spread_small
from srcgraph.streaming.watch import state_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spread_small(table(spark, folder, name).select(*columns))


# --- shared inputs ------------------------------------------------------------
def line_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as symbols, orders as files."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("top_ord"), F.lit(0).alias("sub_ord"),
        F.lit(0).alias("depth"), "l_partkey", "l_suppkey", "l_shipdate", F.lit(1).alias("line_start"),
        F.col("l_quantity").cast("int").alias("line_end"), F.col("l_linenumber").alias("nesting_depth"),
        F.round(F.col("l_discount") * 100).cast("int").alias("branch_count"),
        F.round(F.col("l_tax") * 100).cast("int").alias("n_calls"),
        F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "function")
        .otherwise("css_rule").alias("kind"))


def score_sql(lines: str, nest: str, branches: str, calls: str) -> str:
    return (f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.2::DOUBLE * (least(({lines}) / 100.0::DOUBLE, 1.0::DOUBLE) * 100.0::DOUBLE)"
            f" + 0.3::DOUBLE * (least(({nest}) / 6.0::DOUBLE, 1.0::DOUBLE) * 100.0::DOUBLE)"
            f" + 0.3::DOUBLE * (least(({branches}) / 15.0::DOUBLE, 1.0::DOUBLE) * 100.0::DOUBLE)"
            f" + 0.2::DOUBLE * (least(({calls}) / 20.0::DOUBLE, 1.0::DOUBLE) * 100.0::DOUBLE)))")


def heat_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'Critical' WHEN {score} >= 60 THEN 'High' WHEN {score} >= 40 THEN 'Medium' ELSE 'Low' END"


def file_score_sql(avg: str, top: str, n: str) -> str:
    mix = f"(0.6::DOUBLE * {avg} + 0.4::DOUBLE * {top})"
    return (f"CASE WHEN {n} > 10 THEN least({mix} * 1.15::DOUBLE, 100.0::DOUBLE)"
            f" WHEN {n} > 5 THEN least({mix} * 1.05::DOUBLE, 100.0::DOUBLE) ELSE {mix} END")


LINE_SYMBOL_SQL = f"""
    sym AS (SELECT l_orderkey AS file_path, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_quantity AS INT) AS lines,
                   CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'function' ELSE 'css_rule' END AS kind,
                   {score_sql("CAST(l_quantity AS INT)", "l_linenumber", "CAST(round(l_discount * 100) AS INT)",
                              "CAST(round(l_tax * 100) AS INT)")} AS complexity FROM lineitem)"""


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Part -> next part of the same order, in line order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = items.count()
    lines = dealt(items, rows, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return dealt(lines.where("dst IS NOT NULL AND src <> dst"), rows, "src", "dst").distinct()


PART_EDGE_SQL = """
    edge AS (SELECT DISTINCT src, dst FROM (
        SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst FROM lineitem)
        WHERE dst IS NOT NULL AND src <> dst)"""


def customer_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customer -> customer of the next order of the same day."""
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    rows = orders.count()
    order = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    pairs = dealt(orders, rows, "o_orderdate").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(order).alias("dst"))
    return dealt(pairs.where("dst IS NOT NULL AND src <> dst"), rows, "src", "dst").distinct()


def customer_edge_sql() -> str:
    return f"""
    edge AS (SELECT DISTINCT src, dst FROM (
        SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS dst
        FROM orders) WHERE dst IS NOT NULL AND src <> dst)"""


# --- scores -------------------------------------------------------------------
@query("symbol_scores", f"""WITH {LINE_SYMBOL_SQL}
    SELECT file_path, l_linenumber AS top_ord, l_partkey, l_suppkey, round(complexity, 6) AS complexity,
           {heat_sql("complexity")} AS heat FROM sym""")
def symbol_scores(spark, folder):
    return model.score_symbols(line_symbols(spark, folder)).select(
        "file_path", "top_ord", "l_partkey", "l_suppkey", F.round("complexity", 6).alias("complexity"), "heat")


@query("hotspots", f"""WITH {LINE_SYMBOL_SQL}
    SELECT row_number() OVER (ORDER BY round(complexity, 9) DESC, file_path, l_linenumber, l_partkey, l_suppkey) AS rank,
           file_path, l_linenumber AS top_ord, l_partkey, kind, lines AS line_count, round(complexity, 6) AS complexity
    FROM sym ORDER BY rank LIMIT 10""")
def hotspots(spark, folder):
    scored = model.score_symbols(line_symbols(spark, folder)).withColumn("complexity", F.round("complexity", 9))
    return model.hotspots(scored, 10, ["file_path", "top_ord", "l_partkey", "l_suppkey"]).select(
        F.col("rank").cast("long").alias("rank"), "file_path", "top_ord", "l_partkey", "kind", "line_count",
        F.round("complexity", 6).alias("complexity"))


@query("heat_histogram", f"""WITH {LINE_SYMBOL_SQL}
    SELECT {heat_sql("complexity")} AS heat, count(*) AS n FROM sym GROUP BY 1""")
def heat_histogram(spark, folder):
    return model.heat_histogram(model.score_symbols(line_symbols(spark, folder)))


@query("file_scores", f"""WITH {LINE_SYMBOL_SQL},
    f AS (SELECT file_path, sum(complexity) / count(*) AS a, max(complexity) AS m, count(*) AS n FROM sym GROUP BY 1),
    s AS (SELECT file_path, n AS symbol_count, {file_score_sql("a", "m", "n")} AS complexity FROM f)
    SELECT file_path, symbol_count, round(complexity, 6) AS complexity FROM s""")
def file_scores(spark, folder):
    summary = model.score_aggregate(model.score_symbols(line_symbols(spark, folder)))
    return summary.select("file_path", "symbol_count", F.round(file_score(
        F.col("avg_score"), F.col("max_score"), F.col("symbol_count"), F.lit(0)), 6).alias("complexity"))


def documents_as_files(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id"), F.concat(F.lit("docs/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit("python").alias("adapter"), F.col("lang").alias("language"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("int").alias("line_count"))


DOCUMENT_FILE_SQL = f"""
    doc AS (SELECT doc_id, 'docs/' || source || '/d' || doc_id || '.py' AS file_path, lang AS language,
                   length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents),
    sym AS (SELECT doc_id, {score_sql("line_count", "quality", "toxic", "0")} AS score FROM doc JOIN labels USING (doc_id)),
    agg AS (SELECT doc_id, sum(score) / count(*) AS a, max(score) AS m, count(*) AS n FROM sym GROUP BY 1),
    filed AS (SELECT doc.*, coalesce(n, 0) AS symbol_count, CASE WHEN n IS NULL
              THEN least(line_count / 100.0::DOUBLE, 1.0::DOUBLE) * 30.0::DOUBLE ELSE {file_score_sql("a", "m", "n")} END AS complexity
              FROM doc LEFT JOIN agg USING (doc_id))"""


def described_documents(spark, folder):
    """Documents as files; a label row is the single symbol of its document."""
    files = documents_as_files(spark, folder)
    symbols = table(spark, folder, "labels").join(files, "doc_id").select(
        "file_path", F.lit(0).alias("top_ord"), F.lit(0).alias("sub_ord"), F.lit(0).alias("depth"),
        F.lit("labelled").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"),
        F.col("line_count").alias("line_end"), F.col("quality").alias("nesting_depth"),
        F.col("toxic").alias("branch_count"), F.lit(0).alias("n_calls"), F.lit(None).cast("string").alias("docstring"))
    return model.describe_files(files.drop("doc_id"), model.symbol_summary(model.score_symbols(symbols)))


@query("file_scores_without_symbols", f"""WITH {DOCUMENT_FILE_SQL}
    SELECT file_path, line_count, symbol_count, round(complexity, 6) AS complexity, {heat_sql("complexity")} AS heat FROM filed""")
def file_scores_without_symbols(spark, folder):
    return described_documents(spark, folder).select(
        "file_path", F.col("line_count").cast("long").alias("line_count"), "symbol_count", F.round("complexity", 6).alias("complexity"), "heat")


@query("metadata", f"""WITH {DOCUMENT_FILE_SQL}
    SELECT count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(symbol_count) AS BIGINT) AS total_symbols,
           round(avg(complexity), 6) AS avg_complexity,
           (SELECT file_path FROM filed ORDER BY complexity DESC, split_part(file_path, '/', 2), split_part(file_path, '/', 3) LIMIT 1) AS max_complexity_file,
           round(max(complexity), 6) AS max_complexity_score FROM filed""")
def metadata(spark, folder):
    return model.project_metadata(described_documents(spark, folder)).select(
        "total_files", "total_lines", "total_symbols", F.round("avg_complexity", 6).alias("avg_complexity"),
        "max_complexity_file", F.round("max_complexity_score", 6).alias("max_complexity_score"))


@query("language_counts", "SELECT lang AS language, count(*) AS n_files FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def language_counts(spark, folder):
    return model.language_counts(documents_as_files(spark, folder))


@query("language_filter", """SELECT 'docs/' || source || '/d' || doc_id || '.py' AS file_path, lang AS language
    FROM documents WHERE lang IN ('en', 'fr')""")
def language_filter(spark, folder):
    return views.with_languages(documents_as_files(spark, folder), ["en", "fr"]).select("file_path", "language")


def place_files(spark, folder):
    """Suppliers as files of nation folders, customers as files of segment folders below them."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"))
    suppliers = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("/", "place", "s_name").alias("file_path"), F.col("s_acctbal").alias("balance"), F.lit(1).alias("symbol_count"))
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("/", "place", "c_mktsegment", "c_name").alias("file_path"), F.col("c_acctbal").alias("balance"),
        F.lit(2).alias("symbol_count"))
    return suppliers.unionByName(customers).select(
        "file_path", F.lit("any").alias("adapter"), F.lit("Any").alias("language"), "symbol_count",
        F.floor(F.abs("balance")).cast("int").alias("line_count"),
        F.least(F.greatest(F.col("balance") / 100, F.lit(0.0)), F.lit(100.0)).alias("complexity"))


PLACE_SQL = """
    nat AS (SELECT n_nationkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
    raw AS (SELECT place AS dir, s_name AS name, s_acctbal AS balance, 1 AS symbols FROM supplier JOIN nat ON s_nationkey = n_nationkey
            UNION ALL
            SELECT place || '/' || c_mktsegment, c_name, c_acctbal, 2 FROM customer JOIN nat ON c_nationkey = n_nationkey),
    file AS (SELECT dir, dir || '/' || name AS file_path, name, symbols, CAST(floor(abs(balance)) AS INT) AS lines,
                    least(greatest(balance / 100, 0.0), 100.0) AS complexity FROM raw)"""


@query("module_rollup", f"""WITH {PLACE_SQL},
    upper AS (SELECT DISTINCT dir FROM file WHERE length(dir) - length(replace(dir, '/', '')) = 1),
    member AS (SELECT dir AS module, * FROM file UNION ALL
               SELECT u.dir, f.* FROM file f JOIN upper u ON f.dir LIKE u.dir || '/%')
    SELECT module, max(CASE WHEN parent IN (SELECT dir FROM upper) THEN parent END) AS parent_module, count(*) AS total_files,
           CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(symbols) AS BIGINT) AS total_symbols, round(avg(complexity), 6) AS avg_complexity
    FROM (SELECT *, regexp_replace(module, '/[^/]*$', '') AS parent FROM member) GROUP BY module""")
def module_rollup(spark, folder):
    return model.module_rollup(place_files(spark, folder)).select(
        "module", "parent_module", "total_files", "total_lines", "total_symbols", F.round("avg_complexity", 6).alias("avg_complexity"))


@query("graph_nodes", f"""WITH {PLACE_SQL},
    parts AS (SELECT DISTINCT unnest([split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) AS id FROM file)
    SELECT file_path AS id, name, 'file' AS type, dir AS parent, round(complexity + 1, 6) AS val, {heat_sql("complexity")} AS heat FROM file
    UNION ALL SELECT id, split_part(id, '/', -1), 'folder', CASE WHEN id LIKE '%/%' THEN regexp_replace(id, '/[^/]*$', '') ELSE 'root' END, 15, 'Low' FROM parts
    UNION ALL SELECT 'root', 'places', 'folder', NULL, 20, 'Optimal'""")
def graph_nodes(spark, folder):
    return views.graph_nodes(place_files(spark, folder), "places").select(
        "id", "name", "type", "parent", F.round("val", 6).alias("val"), "heat")


@query("structural_links", f"""WITH {PLACE_SQL},
    node AS (SELECT file_path AS target FROM file UNION
             SELECT unnest([split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) FROM file)
    SELECT CASE WHEN target LIKE '%/%' THEN regexp_replace(target, '/[^/]*$', '') ELSE 'root' END AS source, target FROM node""")
def structural_links(spark, folder):
    return views.structural_links(place_files(spark, folder)).select("source", "target")


# --- purpose ------------------------------------------------------------------
def case_sql(text: str, rows) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in keys.split()) + f" THEN '{label}'" for label, keys in rows)
    return f"CASE {whens} END"


@query("purpose_by_name", f"""SELECT p_partkey, {case_sql("lower(p_type || '/' || p_name)", FILE_NAME_ROWS)} AS purpose FROM part""")
def purpose_by_name(spark, folder):
    return table(spark, folder, "part").select("p_partkey", name_purpose(F.col("p_type"), F.col("p_name")).alias("purpose"))


@query("purpose_by_text", f"""SELECT doc_id, coalesce({case_sql("lower(text)", KEYWORD_ROWS)},
    CASE WHEN lines < 10 THEN '\U0001F4C4 Stub / Init' ELSE '\U0001F4C4 Source' END) AS purpose
    FROM (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents)""")
def purpose_by_text(spark, folder):
    return texts(spark, folder, "documents", "doc_id", "text").select("doc_id", F.coalesce(
        keyword_purpose(F.col("text")), size_purpose(F.regexp_count("text", F.lit("\n")) + 1)).alias("purpose"))


def order_files(spark, folder):
    """Orders as files, line items as their symbols named after parts; returned air items carry a docstring."""
    orders = table(spark, folder, "orders")
    files = orders.select(
        F.concat_ws("/", F.col("o_orderstatus"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py"))).alias("file_path"),
        F.col("o_orderkey"), F.lit("python").alias("adapter"), F.lit("Python").alias("language"),
        (F.col("o_orderkey") % 40).cast("int").alias("line_count"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, folder, "lineitem").withColumn("top_ord", F.row_number().over(place) - 1)
    parts = table(spark, folder, "part")
    symbols = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        files.select("o_orderkey", "file_path"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "file_path", "top_ord", F.lit(0).alias("sub_ord"), F.lit(0).alias("depth"),
        F.concat(F.substring_index("p_name", " ", -1), F.lit("_"), F.col("l_suppkey").cast("string")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "class").otherwise("function").alias("kind"), F.lit(1).alias("line_start"),
        F.col("l_quantity").cast("int").alias("line_end"), F.col("l_linenumber").alias("nesting_depth"),
        F.round(F.col("l_discount") * 100).cast("int").alias("branch_count"), F.round(F.col("l_tax") * 100).cast("int").alias("n_calls"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))).alias("docstring"))
    return files, symbols


ORDER_FILE_SQL = f"""
    sym AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ord,
                   split_part(p_name, ' ', -1) || '_' || l_suppkey AS name, CASE l_linestatus WHEN 'O' THEN 'class' ELSE 'function' END AS kind,
                   CASE l_returnflag WHEN 'A' THEN p_type || ' ' || p_name END AS doc,
                   {score_sql("CAST(l_quantity AS INT)", "l_linenumber", "CAST(round(l_discount * 100) AS INT)", "CAST(round(l_tax * 100) AS INT)")} AS score
            FROM lineitem JOIN part ON l_partkey = p_partkey),
    agg AS (SELECT l_orderkey, sum(score) / count(*) AS a, max(score) AS m, count(*) AS n, string_agg(lower(name), ' ' ORDER BY ord) AS names,
                   count(*) FILTER (kind = 'class') AS n_class, count(*) FILTER (kind = 'function') AS n_function,
                   list(name ORDER BY ord) AS listed,
                   first({case_sql("lower(doc)", KEYWORD_ROWS)} ORDER BY ord) FILTER ({case_sql("lower(doc)", KEYWORD_ROWS)} IS NOT NULL) AS doc_purpose
            FROM sym GROUP BY 1),
    ord AS (SELECT *, o_orderstatus || '/o' || o_orderkey || '.py' AS file_path, o_orderkey % 40 AS line_count,
                   CASE WHEN n IS NULL THEN least((o_orderkey % 40) / 100.0::DOUBLE, 1.0::DOUBLE) * 30.0::DOUBLE ELSE {file_score_sql("a", "m", "n")} END AS complexity
            FROM orders LEFT JOIN agg ON o_orderkey = l_orderkey),
    described AS (SELECT *, coalesce(n, 0) AS k, {heat_sql("complexity")} AS heat, coalesce(
                   {case_sql("lower(o_orderstatus || '/o' || o_orderkey)", FILE_NAME_ROWS)}, doc_purpose, {case_sql("names", KEYWORD_ROWS)},
                   CASE WHEN n_class >= 0.75 * n THEN '\U0001F4E6 Data Model' WHEN n_function >= 0.75 * n AND n > 8 THEN '\U0001F527 Utility'
                        WHEN line_count = 0 THEN '\U0001F4C1 Empty' WHEN line_count < 10 THEN '\U0001F4C4 Stub / Init' ELSE '\U0001F4C4 Source' END) AS purpose FROM ord)"""


def described_orders(spark, folder):
    files, symbols = order_files(spark, folder)
    return model.describe_files(files.drop("o_orderkey"), model.symbol_summary(model.score_symbols(symbols)))


@query("file_purpose", f"WITH {ORDER_FILE_SQL} SELECT file_path, purpose, heat, k AS n_top FROM described")
def file_purpose(spark, folder):
    return described_orders(spark, folder).select("file_path", "purpose", "heat", "n_top")


def badge_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 80 THEN '🔴' WHEN {score} >= 60 THEN '🟠' WHEN {score} >= 40 THEN '🟡' ELSE '🟢' END"
            f" || ' ' || CAST(round_even({score}, 0) AS BIGINT)")


SCORED_ORDER_SQL = f"""{ORDER_FILE_SQL},
    raw AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ord,
                   CAST(l_quantity AS INT) AS lines, l_linenumber AS nesting, CAST(round(l_discount * 100) AS INT) AS branches FROM lineitem),
    item AS (SELECT file_path, o_orderstatus AS module, ord, s.name, s.kind, s.doc, r.lines, r.nesting, r.branches, round(s.score, 6) AS score
             FROM sym s JOIN raw r USING (l_orderkey, ord) JOIN orders ON o_orderkey = l_orderkey
             JOIN (SELECT o_orderkey, file_path FROM described) USING (o_orderkey)),
    leaf AS (SELECT o_orderstatus AS module, file_path, 'o' || o_orderkey || '.py' AS name, line_count, k, heat, purpose,
                    round(complexity, 6) AS score FROM described)"""


def scored_orders(spark, folder, path):
    """Orders as described files and line items as their scored symbols, scores to six decimals; both are written below ``path``."""
    files, symbols = order_files(spark, folder)
    scored, _ = cut(model.score_symbols(symbols), path=f"{path}/symbols")
    described = model.describe_files(files.drop("o_orderkey"), model.symbol_summary(scored)).drop("n_top", "first_names", "narration")
    exact = F.round("complexity", 6)
    # like the SQL, labels of heat go by the score before it is rounded
    return cut(described.withColumn("complexity", exact), path=f"{path}/files")[0], scored.withColumn("complexity", exact)


@query("structure_tree", f"""WITH {SCORED_ORDER_SQL},
    node AS (SELECT '' AS module, '' AS file_path, -1 AS ord, 0 AS depth, '🌳 orders' AS label
             UNION ALL SELECT module, '', -1, 1, '📁 ' || module || '/  (' || count(*) || ' files, ' || CAST(sum(line_count) AS BIGINT) || ' lines)'
                       FROM leaf GROUP BY module
             UNION ALL SELECT module, file_path, -1, 2, '📄 ' || name || '  ' || {badge_sql("score")} || '  ' || line_count || 'L / ' || k || ' symbols  ' || purpose FROM leaf
             UNION ALL SELECT module, file_path, ord, 3, CASE kind WHEN 'class' THEN '🔷 ' ELSE '🔹 ' END || name || '  ' || {badge_sql("score")} || '  L1-' || lines FROM item)
    SELECT row_number() OVER (ORDER BY module, file_path, ord) AS position, depth, label FROM node""")
def structure_tree(spark, folder):
    path = new_path(spark)
    files, symbols = scored_orders(spark, folder, path)
    tree = documents.structure_tree(files, symbols, "orders").select(F.col("position").cast("long").alias("position"), "depth", "label")
    remove_path(spark, path)  # the tree is written
    return tree


def tenth_sql(score: str) -> str:
    return f"CAST(printf('%.1f', {score}) AS DOUBLE)"


def file_list_sql(rank: int, name: str, source: str, entry: str, place: str) -> str:
    """Lines of one list of each file: its begin, its entries, its end."""
    at = f"module, 1, 1, name, {rank}"
    return (f"UNION ALL SELECT DISTINCT 2, 1, {at}, 0, '', 0, '\"{name}\":[' FROM {source}"
            f" UNION ALL SELECT 2, 1, {at}, 1, {place}, {entry} FROM {source}"
            f" UNION ALL SELECT DISTINCT 2, 1, {at}, 9, '', 0, ']' FROM {source}")


SYMBOL_JSON_SQL = f"""'name', i.name, 'kind', i.kind, 'line_start', 1, 'line_end', lines, 'line_count', lines, 'complexity', {tenth_sql("score")},
    'heat', i.heat, 'nesting_depth', nesting, 'branch_count', branches"""


@query("project_lines", f"""WITH {SCORED_ORDER_SQL},
    sym_item AS (SELECT module, split_part(file_path, '/', 2) AS name, ord, CASE WHEN i.doc IS NULL THEN CAST(json_object({SYMBOL_JSON_SQL}) AS VARCHAR)
                 ELSE CAST(json_object({SYMBOL_JSON_SQL}, 'docstring', i.doc) AS VARCHAR) END AS json
                 FROM (SELECT *, {heat_sql("score")} AS heat FROM item) i),
    raw_item AS (SELECT module, split_part(file_path, '/', 2) AS name, ord, CAST(to_json(i.name) AS VARCHAR) AS json FROM item i),
    pair AS (SELECT file_path AS src, lag(file_path) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM described),
    needs AS (SELECT split_part(src, '/', 1) AS module, split_part(src, '/', 2) AS name, CAST(to_json(dst) AS VARCHAR) AS json FROM pair WHERE dst IS NOT NULL),
    needed AS (SELECT split_part(dst, '/', 1) AS module, split_part(dst, '/', 2) AS name, src, CAST(to_json(src) AS VARCHAR) AS json FROM pair WHERE dst IS NOT NULL),
    tag AS (SELECT o_orderstatus AS module, 'o' || o_orderkey || '.py' AS name, CAST(to_json(o_orderpriority) AS VARCHAR) AS json FROM orders),
    hot AS (SELECT row_number() OVER (ORDER BY score DESC, file_path, ord) AS rank, *, {heat_sql("score")} AS heat FROM item ORDER BY rank LIMIT 10),
    line(a, m0, m, b, f0, f, l, e, x, o, text) AS (
        SELECT 0, 0, '', 0, 0, '', 0, 0, '', 0, rtrim(CAST(json_object('name', 'orders', 'path', '/orders', 'metadata', json_object('total_files', count(*),
               'avg_complexity', {tenth_sql("avg(score)")}, 'max_complexity_score', {tenth_sql("max(score)")})) AS VARCHAR), '}}') || '}}' FROM leaf
        UNION ALL SELECT 2, 0, '', 0, 0, '', 0, 0, '', 0, '"modules":['
        UNION ALL SELECT 2, 9, '', 0, 0, '', 0, 0, '', 0, ']'
        UNION ALL SELECT 3, 0, '', 0, 0, '', 0, 0, '', 0, '"hotspots":['
        UNION ALL SELECT 3, 1, '', 0, 0, '', 0, 0, '', rank, CAST(json_object('rank', rank, 'file', file_path, 'symbol', name, 'kind', kind, 'language', 'Python',
               'complexity', {tenth_sql("score")}, 'heat', heat, 'line_start', 1, 'line_end', lines, 'line_count', lines) AS VARCHAR) FROM hot
        UNION ALL SELECT 3, 9, '', 0, 0, '', 0, 0, '', 0, ']'
        UNION ALL SELECT 9, 0, '', 0, 0, '', 0, 0, '', 0, '}}'
        UNION ALL SELECT 2, 1, module, 0, 0, '', 0, 0, '', 0, rtrim(CAST(json_object('name', module, 'relative_path', module, 'total_files', count(*),
               'total_lines', CAST(sum(line_count) AS BIGINT), 'total_symbols', CAST(sum(k) AS BIGINT), 'avg_complexity', {tenth_sql("avg(score)")}) AS VARCHAR), '}}')
               FROM leaf GROUP BY module
        UNION ALL SELECT DISTINCT 2, 1, module, 1, 0, '', 0, 0, '', 0, '"files":[' FROM leaf
        UNION ALL SELECT DISTINCT 2, 1, module, 1, 9, '', 0, 0, '', 0, ']' FROM leaf
        UNION ALL SELECT DISTINCT 2, 1, module, 9, 0, '', 0, 0, '', 0, '}}' FROM leaf
        UNION ALL SELECT 2, 1, module, 1, 1, name, 0, 0, '', 0, rtrim(CAST(json_object('name', name, 'relative_path', file_path, 'line_count', line_count,
               'symbol_count', k, 'complexity', {tenth_sql("score")}, 'heat', heat, 'purpose', purpose, 'language', 'Python') AS VARCHAR), '}}') FROM leaf
        UNION ALL SELECT 2, 1, module, 1, 1, name, 9, 0, '', 0, '}}' FROM leaf
        {file_list_sql(1, "symbols", "sym_item", "json", "'', ord")} {file_list_sql(2, "raw_imports", "raw_item", "json", "'', ord")}
        {file_list_sql(3, "dependencies", "needs", "json", "'', 0")} {file_list_sql(4, "dependents", "needed", "json", "src, 0")}
        {file_list_sql(5, "domains", "tag", "json", "'', 0")}),
    numbered AS (SELECT *, row_number() OVER (ORDER BY a, m0, m, b, f0, f, l, e, x, o) AS position FROM line)
    SELECT position, CASE WHEN position > 1 AND left(text, 1) NOT IN (']', '}}')
           AND NOT lag(text) OVER (ORDER BY position) LIKE '%[' THEN ',' ELSE '' END || text AS text FROM numbered""")
def project_lines(spark, folder):
    path = new_path(spark)
    files, symbols = scored_orders(spark, folder, path)
    symbols = symbols.withColumn("language", F.lit("Python")).withColumn("heat", heat_label(F.col("complexity")))
    # a file imports what its lines name, and depends on the customer's order before
    named = symbols.select("file_path", F.col("top_ord").alias("pos"), F.col("name").alias("raw"))
    orders = table(spark, folder, "orders").withColumn("file_path", F.concat_ws(
        "/", "o_orderstatus", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".py"))))
    before = F.lag("file_path").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = orders.select(F.col("file_path").alias("src"), before.alias("dst"), F.lit(0).alias("pos")).where("dst IS NOT NULL")
    totals = files.agg(F.count(F.lit(1)).alias("total_files"), F.avg("complexity").alias("avg_complexity"),
                       F.max("complexity").alias("max_complexity_score"))
    hot = model.hotspots(symbols, 10, ["file_path", "top_ord", "sub_ord"]).withColumnRenamed("name", "symbol")
    lines = documents.project_lines("orders", "/orders", files, symbols, named, edges,
                                    orders.select("file_path", F.col("o_orderpriority").alias("domain")), totals, hot).select(
        F.col("position").cast("long").alias("position"), "text")
    remove_path(spark, path)  # the lines are written
    return lines


@query("purpose_report", f"""WITH {ORDER_FILE_SQL}
    SELECT purpose, count(*) AS n_files, round(max(complexity), 6) AS worst FROM described WHERE purpose IS NOT NULL GROUP BY 1""")
def purpose_report(spark, folder):
    return described_orders(spark, folder).where("purpose IS NOT NULL").groupBy("purpose").agg(
        F.count(F.lit(1)).alias("n_files"), F.round(F.max("complexity"), 6).alias("worst"))


@query("narration", f"""WITH {ORDER_FILE_SQL}
    SELECT file_path, trim('This file functions primarily as a ' || lower(purpose) || ' module. ' ||
      CASE WHEN k = 0 THEN 'It exposes no distinct classes or functions, suggesting it acts as a configuration file, a script, or a re-export stub. '
           WHEN k = 1 THEN 'It encapsulates a single core component (`' || listed[1] || '`), adhering to the single-responsibility principle. '
           ELSE 'It exposes ' || k || ' primary objects (including `' || array_to_string(listed[1:3], '`, `') || '`' ||
                CASE WHEN k > 3 THEN ', and ' || (k - 3) || ' others' ELSE '' END || '). ' END ||
      CASE heat WHEN 'Critical' THEN 'Structurally it is deeply entangled and branches heavily — a strong refactoring candidate. '
                WHEN 'High' THEN 'It has a high complexity score, so it may be taking on too many responsibilities. '
                WHEN 'Low' THEN 'Its footprint is small, suggesting a clean, modular design. ' ELSE '' END) AS narration FROM described""")
def narration(spark, folder):
    return described_orders(spark, folder).select("file_path", "narration")


@query("dominant_kind", f"""WITH {LINE_SYMBOL_SQL},
    k AS (SELECT file_path, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY file_path) AS total FROM sym GROUP BY 1, 2)
    SELECT file_path, kind, CAST(total AS BIGINT) AS total FROM k WHERE n >= 0.75 * total""")
def dominant_kind(spark, folder):
    return model.dominant_kinds(line_symbols(spark, folder))


# --- imports, domains ---------------------------------------------------------
def word_imports(spark, folder):
    """Every word of a document as an import of that document."""
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_]+(?:[./][A-Za-z0-9_]+)*)"), 1)
    return texts(spark, folder, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("file_path"), F.explode_outer(words).alias("raw")).where("raw IS NOT NULL")


DOMAIN_SQL = "domain(key, domain) AS (VALUES " + ", ".join(f"('{k}', '{d}')" for k, d in domain_rows()) + ")"
WORD_SQL = f"""
    {DOMAIN_SQL},
    word AS (SELECT doc_id AS file_path, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+(?:[./][A-Za-z0-9_]+)*)')) AS raw FROM documents),
    form AS (SELECT raw, max_by(domain, length(key)) AS domain FROM (SELECT DISTINCT raw FROM word) JOIN domain
             ON lower(raw) = key OR starts_with(lower(raw), key || '.') OR starts_with(lower(raw), key || '/') GROUP BY raw)"""


@query("import_domains", f"""WITH {WORD_SQL}
    SELECT domain, count(*) AS n_imports, count(DISTINCT raw) AS n_words FROM word JOIN form USING (raw) GROUP BY domain""")
def import_domains(spark, folder):
    return resolve.classify_imports(word_imports(spark, folder), domain_table(spark)).groupBy("domain", "raw").agg(
        F.count(F.lit(1)).alias("n")).groupBy("domain").agg(F.sum("n").alias("n_imports"), F.count(F.lit(1)).alias("n_words"))


KEY_FORMS = ["", ".part", "/part", ":part", "\\part", "part", " \t"]  # "part" glued on is no prefix, unless of another key
KEY_LIST = [k for k, _ in domain_rows()]
FORM_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(KEY_FORMS))


@query("domain_keys", f"""WITH {DOMAIN_SQL},
    keys AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i FROM domain),
    form(i, tail) AS (VALUES {FORM_SQL}),
    import AS (SELECT upper(k.key) || f.tail AS raw FROM lineitem JOIN keys k ON k.i = l_partkey % {len(KEY_LIST)}
               JOIN form f ON f.i = (l_orderkey + l_linenumber) % {len(KEY_FORMS)}),
    trimmed AS (SELECT DISTINCT raw, lower(trim(raw, ' ' || chr(9))) AS t FROM import),
    best AS (SELECT raw, max_by(domain, length(key)) AS domain FROM trimmed JOIN domain ON t = key OR starts_with(t, key || '.')
             OR starts_with(t, key || '/') OR starts_with(t, key || ':') OR starts_with(t, key || chr(92)) GROUP BY raw)
    SELECT raw, domain, count(*) AS n FROM import JOIN best USING (raw) GROUP BY raw, domain""")
def domain_keys(spark, folder):
    """Every domain key, alone, with each separator, with letters glued on, and inside white space."""
    keys, forms = (F.array(*[F.lit(x) for x in xs]) for xs in (KEY_LIST, KEY_FORMS))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("file_path"),
        F.concat(F.upper(F.get(keys, (F.col("l_partkey") % len(KEY_LIST)).cast("int"))),
                 F.get(forms, ((F.col("l_orderkey") + F.col("l_linenumber")) % len(KEY_FORMS)).cast("int"))).alias("raw"))
    return resolve.classify_imports(lines, domain_table(spark)).groupBy("raw", "domain").agg(F.count(F.lit(1)).alias("n"))


EVENT_ROOTS = {"view": "react.dom.view", "signup": "bcrypt.hash", "click": "requests.adapters", "error": "logging.handlers", "purchase": "django.db.models"}
EVENT_DOMAINS = {"view": "ui", "signup": "auth", "click": "network", "error": "logging", "purchase": "database"}


def event_imports(spark, folder):
    """Events as imports: the file is a user's day, the event type decides what is imported."""
    raw = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_ROOTS.items()])
    return table(spark, folder, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("file_path"), raw.alias("raw"))


EVENT_DOMAIN_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_DOMAINS.items()) + " END"
EVENT_SQL = f"tag AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS file_path, {EVENT_DOMAIN_SQL} AS domain FROM events)"


@query("cross_cutting", f"""WITH {EVENT_SQL},
    f AS (SELECT file_path, count(*) AS domain_count, string_agg(domain, ', ' ORDER BY domain) AS domains FROM tag GROUP BY 1)
    SELECT file_path, domain_count, domains, 'This file mixes ' || domain_count || ' concerns (' || domains ||
           '). Consider splitting along domain boundaries.' AS suggestion FROM f WHERE domain_count >= 3""")
def cross_cutting(spark, folder):
    tags = resolve.file_domains(event_imports(spark, folder), domain_table(spark))
    return resolve.cross_cutting(tags, 3).select(
        "file_path", F.col("domain_count").cast("long").alias("domain_count"), F.array_join("domains", ", ").alias("domains"), "suggestion")


@query("domain_filter", f"WITH {EVENT_SQL} SELECT file_path FROM tag WHERE domain = 'database'")
def domain_filter(spark, folder):
    imports = event_imports(spark, folder)
    return views.with_domain(imports.select("file_path").distinct(), resolve.file_domains(imports, domain_table(spark)), "database")


def part_files(spark, folder):
    """Parts as files: <type>/<brand>/m<key>.<ext>, every fifth size a package folder."""
    ext = F.when(F.col("p_size") % 3 == 0, ".py").when(F.col("p_size") % 3 == 1, ".js").otherwise(".c")
    place = F.concat_ws("/", F.lower("p_type"), F.translate("p_brand", "#", "_"))
    base = F.concat(place, F.lit("/m"), F.col("p_partkey").cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey", place.alias("place"),
        F.when(F.col("p_size") % 5 == 0, F.concat(base, F.lit("/__init__.py"))).otherwise(F.concat(base, ext)).alias("file_path"))


def part_imports(spark, folder):
    """Each line item imports the next part of its order; the line number picks the spelling."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = dealt(items, items.count(), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey", F.lead("l_partkey").over(order).alias("to")).where("to IS NOT NULL")
    files = part_files(spark, folder)
    target = files.select(F.col("p_partkey").alias("to"), F.col("place").alias("to_place"))
    joined = pairs.join(files, F.col("l_partkey") == F.col("p_partkey")).join(target, "to")
    m = F.concat(F.lit("m"), F.col("to").cast("string"))
    brand, dotted = F.substring_index("to_place", "/", -1), F.translate("to_place", "/", ".")
    n = F.col("l_linenumber")
    raw = (F.when(n == 1, F.concat(F.lit("./"), m)).when(n == 2, F.concat(F.lit("../"), brand, F.lit("/"), m))
           .when(n == 3, F.concat_ws("/", "to_place", m)).when(n == 4, F.concat_ws(".", dotted, m))
           .when(n == 5, F.concat_ws(".", dotted, m, F.lit("Item"))).when(n == 6, m).otherwise(F.concat(m, F.lit(".py"))))
    return joined.select("file_path", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "to").alias("pos"), raw.alias("raw"))


PART_IMPORT_SQL = """
    file AS (SELECT p_partkey, lower(p_type) || '/' || replace(p_brand, '#', '_') AS place, p_size % 5 = 0 AS package,
                    CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.c' END AS ext FROM part),
    named AS (SELECT *, place || '/m' || p_partkey || CASE WHEN package THEN '/__init__.py' ELSE ext END AS file_path,
                     CASE WHEN package THEN place || '/m' || p_partkey ELSE place END AS dir FROM file),
    pair AS (SELECT l_linenumber, l_suppkey, l_quantity, l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem),
    imp AS (SELECT s.file_path AS src, t.file_path AS dst, CASE l_linenumber
                WHEN 1 THEN s.dir = t.place
                WHEN 2 THEN regexp_replace(s.dir, '/[^/]*$', '') || '/' || split_part(t.place, '/', 2) = t.place
                WHEN 6 THEN NOT t.package
                WHEN 7 THEN NOT t.package AND t.ext = '.py' ELSE true END AS hit,
                CASE l_linenumber WHEN 1 THEN './m' || nxt WHEN 2 THEN '../' || split_part(t.place, '/', 2) || '/m' || nxt
                     WHEN 3 THEN t.place || '/m' || nxt WHEN 4 THEN replace(t.place, '/', '.') || '.m' || nxt
                     WHEN 5 THEN replace(t.place, '/', '.') || '.m' || nxt || '.Item' WHEN 6 THEN 'm' || nxt ELSE 'm' || nxt || '.py' END AS raw
            FROM pair JOIN named s ON l_partkey = s.p_partkey JOIN named t ON nxt = t.p_partkey)"""


def resolved_edges(spark, folder, imports=None):
    files = part_files(spark, folder).select("file_path", model.file_order(F.lit("any"), F.col("file_path")).alias("file_ord"))
    return resolve.dependency_edges(resolve.resolve_imports(part_imports(spark, folder) if imports is None else imports, files))


@query("resolve_imports", f"WITH {PART_IMPORT_SQL} SELECT DISTINCT src, dst FROM imp WHERE hit AND src <> dst")
def resolve_imports(spark, folder):
    return resolved_edges(spark, folder).select("src", "dst")


@query("edge_usage", f"""WITH {PART_IMPORT_SQL},
    edge AS (SELECT DISTINCT src, dst FROM imp WHERE hit AND src <> dst),
    raws AS (SELECT src, list(raw) AS raws FROM imp GROUP BY src),
    label AS (SELECT *, split_part(dst, '/', -1) AS name FROM edge JOIN raws USING (src))
    SELECT src, dst, greatest(1, len(list_filter(raws, lambda r: contains(r, regexp_replace(name, '[.][^.]*$', ''))))) AS usage_count FROM label""")
def edge_usage(spark, folder):
    imports, _ = cut(part_imports(spark, folder))
    by_file = imports.groupBy("file_path").agg(F.collect_list("raw").alias("imports"))
    return resolve.edge_usage(resolved_edges(spark, folder, imports), by_file).select("src", "dst", F.col("usage_count").cast("long").alias("usage_count"))


@query("refresh_edges", f"""WITH {PART_IMPORT_SQL},
    stays AS (SELECT file_path FROM named JOIN part USING (p_partkey) WHERE p_size > 5)
    SELECT DISTINCT src, dst FROM imp WHERE hit AND src <> dst AND src IN (FROM stays) AND dst IN (FROM stays)""")
def refresh_edges(spark, folder):
    """Edges after two changes of a project of parts: the large ones are added, then the small ones go."""
    sizes = part_files(spark, folder).join(grown(table(spark, folder, "part").select("p_partkey", "p_size")), "p_partkey")
    files = sizes.select("file_path", "p_size", model.file_order(F.lit("any"), F.col("file_path")).alias("file_ord"))
    imports, _ = cut(part_imports(spark, folder).join(grown(files.select("file_path", "p_size")), "file_path"))  # read by both changes
    symbols = files.select("file_path", F.lit("f").alias("name"))

    def rows(condition):
        return [frame.where(condition) for frame in (files.select("file_path", "file_ord", "p_size"), symbols.join(grown(files), "file_path"), imports)]

    def told(frames):
        return frames[0].select("file_path", "file_ord"), frames[1].select("file_path", "name"), frames[2].select("file_path", "pos", "raw")

    state = refresh.first_state(*told(rows("p_size <= 40")))
    state, _ = refresh.refresh(state, files.where("false"), *told(rows("p_size > 40")))
    state, _ = refresh.refresh(state, files.where("p_size <= 5"), *told(rows("false")))
    return state.edges.select("src", "dst")


# --- graph --------------------------------------------------------------------
@query("monoliths", f"""WITH {PART_EDGE_SQL}
    SELECT dst AS file_path, count(*) AS dependents FROM edge GROUP BY dst HAVING count(*) >= 3""")
def monoliths(spark, folder):
    return graph.monoliths(part_edges(spark, folder), 3)


@query("circular", f"WITH {PART_EDGE_SQL} SELECT e.src AS a, e.dst AS b FROM edge e JOIN edge r ON e.src = r.dst AND e.dst = r.src WHERE e.src < e.dst")
def circular(spark, folder):
    return graph.mutual_pairs(part_edges(spark, folder))


@query("blast_radius", f"""WITH {PART_EDGE_SQL}
    SELECT node, count(*) AS radius FROM (SELECT src AS node, dst AS other FROM edge UNION SELECT dst, src FROM edge) GROUP BY node""")
def blast_radius(spark, folder):
    return graph.blast_radius(part_edges(spark, folder))


DEAD_LABEL_SQL = case_sql("lower(p_brand || '/' || p_name)", FILE_NAME_ROWS)


NEIGHBOUR_SQL = f"""{PART_EDGE_SQL},
    side AS (SELECT dst AS file_path, 'dependents' AS side, src AS other FROM edge UNION ALL SELECT src, 'dependencies', dst FROM edge),
    near AS (SELECT *, row_number() OVER (PARTITION BY file_path, side ORDER BY other) AS position FROM side)"""


@query("neighbours", f"WITH {NEIGHBOUR_SQL} SELECT file_path, side, position, other FROM near")
def neighbours(spark, folder):
    return graph.neighbours(part_edges(spark, folder)).withColumn("position", F.col("position").cast("long"))


@query("blast_lists", f"""WITH {PART_EDGE_SQL},
    near AS (SELECT src AS node, dst AS other FROM edge UNION SELECT dst, src FROM edge),
    placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS position FROM near)
    SELECT node, string_agg(other, ',' ORDER BY position) FILTER (position <= 4) AS names, greatest(count(*) - 4, 0) AS more FROM placed GROUP BY node""")
def blast_lists(spark, folder):
    """The first four files a change of each part may reach at once and how many more there are."""
    return graph.blast_lists(part_edges(spark, folder)).select("node", F.array_join(F.col("names").cast("array<string>"), ",").alias("names"), "more")


@query("neighbour_short_lists", f"""WITH {NEIGHBOUR_SQL}
    SELECT file_path, side, string_agg(other, ',' ORDER BY position) FILTER (position <= 4) AS names, greatest(count(*) - 4, 0) AS more
    FROM near GROUP BY file_path, side""")
def neighbour_short_lists(spark, folder):
    """The first four dependents and dependencies of each part and how many more there are."""
    short = views.short_lists(graph.neighbours(part_edges(spark, folder)), ["file_path", "side"], "other")
    return short.select("file_path", "side", F.array_join(F.col("names").cast("array<string>"), ",").alias("names"), "more")


@query("dead_files", f"""WITH {PART_EDGE_SQL},
    tied AS (SELECT e.src AS node FROM edge e JOIN edge f ON f.src = e.dst AND f.dst = e.src)
    SELECT p_partkey AS file_path FROM part WHERE p_partkey NOT IN (SELECT node FROM tied)
    AND NOT coalesce(contains(lower({DEAD_LABEL_SQL}), 'test'), false) AND coalesce({DEAD_LABEL_SQL}, '') <> '\U0001F680 Entry Point'""")
def dead_files(spark, folder):
    """Parts that depend on no part which depends on them too, over all line items."""
    files = table(spark, folder, "part").where(
        ~exempt_from_dead(name_purpose(F.col("p_brand"), F.col("p_name")))).select(F.col("p_partkey").alias("file_path"))
    pairs = graph.mutual_pairs(part_edges(spark, folder)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.isolated(files, pairs)


def first_customer(spark, folder):
    return table(spark, folder, "orders").agg(F.min("o_custkey")).first()[0]


def reach_sql(direction: str, bound: int) -> str:
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f"""SELECT '{direction}' AS direction, node, min(hop) AS hop FROM {direction} WHERE node <> (SELECT min(o_custkey) FROM orders) GROUP BY node""", \
        f"""{direction}(node, hop) AS (SELECT min(o_custkey), 0 FROM orders UNION
            SELECT e.{far}, r.hop + 1 FROM {direction} r JOIN edge e ON e.{near} = r.node WHERE r.hop < {bound})"""


UP_SQL, UP_CTE = reach_sql("upstream", 30)
DOWN_SQL, DOWN_CTE = reach_sql("downstream", 30)
DOWN2_SQL, DOWN2_CTE = reach_sql("downstream", 2)


@query("impact_upstream", f"WITH RECURSIVE {customer_edge_sql()}, {UP_CTE} {UP_SQL}")
def impact_upstream(spark, folder):
    return graph.reach(customer_edges(spark, folder), first_customer(spark, folder), ("upstream",))


@query("impact_downstream", f"WITH RECURSIVE {customer_edge_sql()}, {DOWN_CTE} {DOWN_SQL}")
def impact_downstream(spark, folder):
    return graph.reach(customer_edges(spark, folder), first_customer(spark, folder), ("downstream",))


@query("impact_max_depth", f"WITH RECURSIVE {customer_edge_sql()}, {DOWN2_CTE} {DOWN2_SQL}")
def impact_max_depth(spark, folder):
    return graph.reach(customer_edges(spark, folder), first_customer(spark, folder), ("downstream",), 2)


@query("impact_full", f"""WITH RECURSIVE {customer_edge_sql()}, {UP_CTE}, {DOWN_CTE},
    r AS ({UP_SQL} UNION ALL {DOWN_SQL})
    SELECT direction, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS indirect, count(*) AS total, max(hop) AS max_depth
    FROM r GROUP BY direction""")
def impact_full(spark, folder):
    return graph.impact_summary(graph.reach(customer_edges(spark, folder), first_customer(spark, folder)))


def sizes_sql(direction: str) -> str:
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return f"""SELECT '{direction}' AS direction, n.node, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS indirect,
               count(hop) AS total, coalesce(max(hop), 0) AS max_depth
        FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge) n LEFT JOIN (
            SELECT start, node, min(hop) AS hop FROM (
                SELECT {near} AS start, {far} AS node, 1 AS hop FROM edge
                UNION SELECT a.{near}, b.{far}, 2 FROM edge a JOIN edge b ON a.{far} = b.{near}
                UNION SELECT a.{near}, c.{far}, 3 FROM edge a JOIN edge b ON a.{far} = b.{near} JOIN edge c ON b.{far} = c.{near})
            WHERE start <> node GROUP BY start, node) r ON r.start = n.node
        GROUP BY n.node"""


@query("impact_sizes", f"WITH {customer_edge_sql()} {sizes_sql('upstream')} UNION ALL {sizes_sql('downstream')}")
def impact_sizes(spark, folder):
    """How many customers every customer reaches within three hops, in either direction."""
    return graph.impact_sizes(customer_edges(spark, folder), 3)


@query("impact_short_list", f"""WITH RECURSIVE {customer_edge_sql()}, {UP_CTE}, {DOWN_CTE}, r AS ({UP_SQL} UNION ALL {DOWN_SQL})
    SELECT direction, hop, array_to_string(list(node ORDER BY node)[1:3], ',') AS nodes, greatest(count(*) - 3, 0) AS more
    FROM r WHERE hop <= 4 GROUP BY direction, hop""")
def impact_short_list(spark, folder):
    short = views.first_per_hop(graph.reach(customer_edges(spark, folder), first_customer(spark, folder)))
    return short.select("direction", "hop", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), "more")


def supplier_parts(spark, folder):
    """Suppliers as files, their parts as symbols, linked where parts ship one after the other on a day."""
    lines = table(spark, folder, "lineitem")
    tops = lines.groupBy(F.col("l_suppkey").alias("file_path"), F.col("l_partkey").alias("key")).agg(
        F.min("l_orderkey").alias("top_ord"), F.min("l_linenumber").alias("line_start"), F.max("l_quantity").cast("int").alias("line_end"))
    named = tops.join(table(spark, folder, "part"), F.col("key") == F.col("p_partkey")).select(
        "file_path", "top_ord", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("key").cast("string")).alias("name"), "key",
        F.when(F.col("p_size") > 25, "class").otherwise("function").alias("kind"), "line_start", "line_end")
    day = Window.partitionBy("l_suppkey", "l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    links = lines.select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("a"), F.lead("l_partkey").over(day).alias("b")).where(
        "b IS NOT NULL AND a <> b").distinct()
    return named, links


SUPPLIER_SQL = """
    top AS (SELECT l_suppkey AS file_path, l_partkey AS node, min(l_orderkey) AS ord, min(l_linenumber) AS line_start,
                   CAST(max(l_quantity) AS INT) AS line_end FROM lineitem GROUP BY 1, 2),
    link AS (SELECT DISTINCT grp, a, b FROM (SELECT l_suppkey AS grp, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_suppkey, l_shipdate
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b),
    link2 AS (SELECT grp, a, b FROM link UNION SELECT grp, b, a FROM link),
    walk(grp, node, seen) AS (SELECT file_path, node, node FROM top UNION SELECT w.grp, w.node, e.b FROM walk w JOIN link2 e ON e.grp = w.grp AND e.a = w.seen),
    comp AS (SELECT grp, node, min(seen) AS component FROM walk GROUP BY grp, node)"""
HINT_SQL = "CASE " + " ".join(f"WHEN bool_or(contains(name, '{w}')) THEN '{l}'" for w, l in CLUSTER_HINTS) + " WHEN bool_or(p_size > 25) THEN 'data model' ELSE 'helpers' END"


@query("components", f"WITH RECURSIVE {SUPPLIER_SQL} SELECT grp, node, component FROM comp")
def components(spark, folder):
    tops, links = supplier_parts(spark, folder)
    return graph.components(tops.select(F.col("file_path").alias("grp"), F.col("key").alias("node")), links)


CLUSTER_SQL = f"""{SUPPLIER_SQL},
    member AS (SELECT t.*, c.component, p_size, replace(p_name, ' ', '_') || '_' || t.node AS name FROM top t JOIN comp c ON c.grp = t.file_path AND c.node = t.node
               JOIN part ON t.node = p_partkey WHERE t.file_path IN (SELECT file_path FROM top GROUP BY 1 HAVING count(*) >= {SPLIT_MIN_SYMBOLS})),
    cluster AS (SELECT file_path, component, count(*) AS size, min(line_start) AS line_start, max(line_end) AS line_end, {HINT_SQL} AS label
                FROM member GROUP BY file_path, component HAVING count(*) >= 2)"""


def clusters(spark, folder):
    tops, links = supplier_parts(spark, folder)
    keyed = tops.withColumn("label_name", F.col("name")).withColumn("name", F.col("key"))
    return splits.clusters_from(keyed, links, SPLIT_MIN_SYMBOLS, F.col("label_name"))


@query("split_clusters", f"""WITH RECURSIVE {CLUSTER_SQL}
    SELECT * FROM cluster WHERE file_path IN (SELECT file_path FROM cluster GROUP BY 1 HAVING count(*) >= 2)""")
def split_clusters(spark, folder):
    return clusters(spark, folder).drop("first_ord", "members")


@query("split_candidates", f"""WITH RECURSIVE {CLUSTER_SQL}
    SELECT file_path, count(*) AS n_clusters, round(any_value(s_acctbal) / 200, 1) AS complexity
    FROM cluster JOIN supplier ON file_path = s_suppkey GROUP BY 1 HAVING count(*) >= 2 ORDER BY complexity DESC, n_clusters DESC, file_path LIMIT 8""")
def split_candidates(spark, folder):
    files = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("long").alias("file_path"), F.lit("any").alias("adapter"), F.round(F.col("s_acctbal") / 200, 1).alias("complexity"), F.lit("Low").alias("heat"))
    return splits.split_candidates(clusters(spark, folder), files).select("file_path", "n_clusters", "complexity")


# --- symbol usage -------------------------------------------------------------
def usage_inputs(spark, folder):
    """Brands define one function per part; orders import and mention the parts they hold.

    The return flag picks the form: A imports the name, N the module, R a module
    that does not exist.
    """
    parts = table(spark, folder, "part")
    brand = F.concat(F.lit("b"), F.substring_index("p_brand", "#", -1))
    definitions = parts.select(F.concat(brand, F.lit(".py")).alias("file_path"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    # read by bindings, references and files, so it is joined once
    lines, _ = cut(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity").join(
        grown(parts.select("p_partkey", "p_brand")), F.col("l_partkey") == F.col("p_partkey")))
    use = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".py"))
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    flag = F.col("l_returnflag")
    bindings = lines.select(
        use.alias("file_path"), F.col("l_linenumber").alias("pos"), F.when(flag == "A", "from").otherwise("import").alias("form"),
        F.when(flag == "R", F.concat(F.lit("gone."), brand)).otherwise(brand).alias("module"), F.lit(0).alias("level"),
        F.when(flag == "A", name).alias("name"),
        F.when(flag == "A", name).when(flag == "N", brand).otherwise(F.concat(F.lit("x"), brand)).alias("local"))
    references = lines.select(
        use.alias("file_path"), F.when(flag == "A", name).when(flag == "N", brand).otherwise(F.concat(F.lit("x"), brand)).alias("base"),
        F.when(flag != "A", name).alias("attr"), F.col("l_quantity").cast("int").alias("line"))
    files = definitions.select("file_path").unionByName(lines.select(use.alias("file_path"))).distinct()
    return bindings, references, definitions, files


USAGE_SQL = """
    hit AS (SELECT 'b' || split_part(p_brand, '#', 2) || '.py' AS def_file, 'p' || l_partkey AS symbol, 'o' || l_orderkey || '.py' AS use_file,
                   CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N'))"""


@query("symbol_usages", f"WITH {USAGE_SQL} SELECT * FROM hit")
def symbol_usages(spark, folder):
    return usage.symbol_usages(*usage_inputs(spark, folder))


@query("symbol_impact", f"WITH {USAGE_SQL} SELECT def_file, symbol, count(*) AS usage_count, count(DISTINCT use_file) AS file_count FROM hit GROUP BY 1, 2")
def symbol_impact(spark, folder):
    return usage.symbol_impact(usage.symbol_usages(*usage_inputs(spark, folder)))


@query("impact_rows", f"""WITH {USAGE_SQL}
    SELECT def_file, symbol, row_number() OVER (PARTITION BY def_file, symbol ORDER BY use_file, line) AS position, use_file, line FROM hit""")
def impact_rows(spark, folder):
    return usage.impact_rows(usage.symbol_usages(*usage_inputs(spark, folder)))


@query("symbol_counts", f"""WITH {USAGE_SQL}
    SELECT 'b' || split_part(p_brand, '#', 2) || '.py' AS file_path, 'p' || p_partkey AS name, count(DISTINCT use_file) AS file_count
    FROM part LEFT JOIN hit ON symbol = 'p' || p_partkey GROUP BY 1, 2""")
def symbol_counts(spark, folder):
    bindings, references, definitions, files = usage_inputs(spark, folder)
    return usage.symbol_counts(definitions, usage.symbol_usages(bindings, references, definitions, files))


@query("usage_lines", f"""WITH {USAGE_SQL}
    SELECT def_file, symbol, use_file, array_to_string(list(line ORDER BY line)[1:4], ',') AS lines, greatest(count(*) - 4, 0) AS more
    FROM hit GROUP BY 1, 2, 3""")
def usage_lines(spark, folder):
    return usage.usage_lines(usage.symbol_usages(*usage_inputs(spark, folder))).select(
        "def_file", "symbol", "use_file", F.array_join(F.transform("lines", lambda l: l.cast("string")), ",").alias("lines"), "more")


# --- differences --------------------------------------------------------------
def part_scores(spark, folder, later: bool):
    """Hottest line item per part and supplier, shipped before or from mid-1998 on."""
    scored = model.score_symbols(line_symbols(spark, folder))
    split = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")
    return scored.where(split if later else ~split).groupBy(
        F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("file_path")).agg(
        F.max("complexity").alias("complexity"))


DIFF_SQL = f"""{LINE_SYMBOL_SQL},
    old AS (SELECT l_partkey || '/' || l_suppkey AS file_path, max(complexity) AS c FROM sym WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1),
    new AS (SELECT l_partkey || '/' || l_suppkey AS file_path, max(complexity) AS c FROM sym WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1),
    change AS (SELECT coalesce(old.file_path, new.file_path) AS file_path, CASE WHEN old.c IS NULL THEN 'ADDED' WHEN new.c IS NULL THEN 'DELETED'
               ELSE 'MODIFIED' END AS status, coalesce(new.c, 0) - coalesce(old.c, 0) AS delta, coalesce(new.c, 0) AS now
               FROM old FULL JOIN new ON old.file_path = new.file_path),
    kept AS (SELECT * FROM change WHERE status <> 'MODIFIED' OR abs(delta) > 0.5)"""


@query("diff_snapshots", f"WITH {DIFF_SQL} SELECT file_path, status, round(delta, 6) AS complexity_delta, round(now, 6) AS new_complexity FROM kept")
def diff_snapshots(spark, folder):
    changes = compare.diff_files(part_scores(spark, folder, False), part_scores(spark, folder, True))
    return changes.select("file_path", "status", F.round("complexity_delta", 6).alias("complexity_delta"), F.round("new_complexity", 6).alias("new_complexity"))


@query("diff_summary", f"""WITH {DIFF_SQL} SELECT count(*) FILTER (status = 'ADDED') AS files_added, count(*) FILTER (status = 'DELETED') AS files_deleted,
    count(*) FILTER (status = 'MODIFIED' AND delta > 0) AS got_worse, count(*) FILTER (status = 'MODIFIED' AND delta < 0) AS got_better FROM kept""")
def diff_summary(spark, folder):
    return compare.diff_summary(compare.diff_files(part_scores(spark, folder, False), part_scores(spark, folder, True)))


def listing(events: DataFrame) -> DataFrame:
    return events.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path")).agg(
        F.max("ts").alias("mtime"), F.count(F.lit(1)).alias("size"))


@query("changed_paths", """WITH
    cut AS (SELECT TIMESTAMP '2024-01-04' AS lo, TIMESTAMP '2024-01-25' AS hi),
    b AS (SELECT user_id || '/' || event_type AS path, max(ts) AS m, count(*) AS n FROM events, cut WHERE ts < hi GROUP BY 1),
    a AS (SELECT user_id || '/' || event_type AS path, max(ts) AS m, count(*) AS n FROM events, cut WHERE ts >= lo GROUP BY 1)
    SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM b FULL JOIN a ON a.path = b.path WHERE (b.m, b.n) IS DISTINCT FROM (a.m, a.n)""")
def changed_paths(spark, folder):
    events = table(spark, folder, "events")
    before = listing(events.where(F.col("ts") < F.lit("2024-01-25").cast("timestamp")))
    return compare.changed_paths(before, listing(events.where(F.col("ts") >= F.lit("2024-01-04").cast("timestamp"))))


ROUNDS = ["2024-01-04", "2024-01-25"]  # where one batch of file states ends and the next begins
ROUND_SQL = "CASE " + " ".join(f"WHEN ts < TIMESTAMP '{t}' THEN {i}" for i, t in enumerate(ROUNDS)) + f" ELSE {len(ROUNDS)} END"


@query("stream_changes", f"""WITH
    state AS (SELECT user_id || '/' || event_type AS path, {ROUND_SQL} AS round, max(ts) AS m, count(*) AS n FROM events GROUP BY 1, 2),
    pair AS (SELECT coalesce(a.path, b.path) AS path, b.m AS bm, b.n AS bn, a.m AS am, a.n AS an
             FROM state a FULL JOIN (SELECT path, round + 1 AS round, m, n FROM state WHERE round < {len(ROUNDS)}) b
             ON a.path = b.path AND a.round = b.round)
    SELECT path, CASE WHEN bm IS NULL THEN 'added' WHEN am IS NULL THEN 'removed' ELSE 'changed' END AS change FROM pair
    WHERE (am, an) IS DISTINCT FROM (bm, bn)""")
def stream_changes(spark, folder):
    """File states arrive in batches of a stream, files that went without size; the changes of all batches together."""
    place = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    turn = F.lit(len(ROUNDS))
    for i, t in reversed(list(enumerate(ROUNDS))):
        turn = F.when(F.col("ts") < F.lit(t).cast("timestamp"), F.lit(i)).otherwise(turn)
    states, _ = cut(table(spark, folder, "events").groupBy(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), turn.alias("turn")).agg(
        F.unix_micros(F.max("ts").cast("timestamp")).alias("mtime"), F.count(F.lit(1)).alias("size")))
    schema = "path string, mtime long, size long"
    for i in range(len(ROUNDS) + 1):
        here = states.where(F.col("turn") == i).select("path", "mtime", "size")
        gone = states.where(F.col("turn") == i - 1).join(here, "path", "left_anti").select(
            "path", F.unix_micros(F.lit(ROUNDS[i - 1]).cast("timestamp")).alias("mtime"), F.lit(None).cast("long").alias("size"))
        here.unionByName(gone).write.mode("append").parquet(os.path.join(place, "states"))
        stream = spark.readStream.schema(schema).parquet(os.path.join(place, "states"))
        state_changes(stream, place).awaitTermination()
    return spark.read.parquet(os.path.join(place, "changes")).select("path", "change")


def turns(spark, folder):
    talk = table(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.max_by("text", F.struct("role", "text")).alias("text"))
    return talk, talk.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")


TURN_SQL = """
    talk AS (SELECT conv_id, turn, max_by(text, (role, text)) AS text FROM conversations GROUP BY 1, 2),
    old AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM talk),
    new AS (SELECT conv_id, turn - 1 AS turn, line, pos FROM old),
    pair AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.turn, n.turn) AS turn, coalesce(o.pos, n.pos) AS pos, o.line AS was, n.line AS now
             FROM old o FULL JOIN new n ON o.conv_id = n.conv_id AND o.turn = n.turn AND o.pos = n.pos)"""


@query("line_diff", f"""WITH {TURN_SQL}
    SELECT conv_id, turn, pos, 'ctx' AS type, was AS text FROM pair WHERE was = now
    UNION ALL SELECT conv_id, turn, pos, 'remove', was FROM pair WHERE was IS NOT NULL AND was IS DISTINCT FROM now
    UNION ALL SELECT conv_id, turn, pos, 'add', now FROM pair WHERE now IS NOT NULL AND was IS DISTINCT FROM now""")
def line_diff(spark, folder):
    old, new = turns(spark, folder)
    return compare.line_diff(old, new, ["conv_id", "turn"]).withColumn("pos", F.col("pos").cast("long"))


@query("line_marks", f"""WITH {TURN_SQL}
    SELECT conv_id, turn, pos, CASE WHEN was IS NULL THEN 'added' ELSE 'modified' END AS mark FROM pair WHERE now IS NOT NULL AND was IS DISTINCT FROM now""")
def line_marks(spark, folder):
    old, new = turns(spark, folder)
    return compare.line_marks(old, new, ["conv_id", "turn"]).withColumn("pos", F.col("pos").cast("long"))


# --- text measures ------------------------------------------------------------
LANGUAGES = {l.adapter: l for l in BUILTIN_LANGUAGES}


BRANCH_WORDS = "IF|ELSEIF|ELSIF|CASE|WHEN|WHILE|LOOP|FOR"


@query("branch_count", rf"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:{BRANCH_WORDS})\b')) AS branches FROM documents""")
def branch_count(spark, folder):
    """Words bounded by ASCII letters and digits, the one notion of a word both engines share."""
    pattern = f"(?i)(?<![A-Za-z0-9_])(?:{BRANCH_WORDS})(?![A-Za-z0-9_])"
    return texts(spark, folder, "documents", "doc_id", "text").select("doc_id", parse.branch_count(F.col("text"), pattern).cast("long").alias("branches"))


@query("called_names", r"""SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(html, '([A-Za-z0-9_]+)\s*\(', 1)),
    lambda c: c NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function', 'class', 'return', 'typeof', 'instanceof', 'new', 'delete', 'void', 'throw'))), ',') AS calls
    FROM pages""")
def called_names(spark, folder):
    calls = parse.called_names(F.col("html"), replace(LANGUAGES["javascript"], name_chars="A-Za-z0-9_").call)
    return texts(spark, folder, "pages", "page_id", "html").select("page_id", F.array_join(F.array_sort(calls), ",").alias("calls"))


@query("nesting_depth", """WITH
    line AS (SELECT page_id, unnest(string_split(html, '>')) AS l, generate_subscripts(string_split(html, '>'), 1) AS i FROM pages),
    net AS (SELECT page_id, i, (l LIKE '%<%' AND l NOT LIKE '%</%')::INT - (l LIKE '%</%')::INT AS v FROM line),
    run AS (SELECT page_id, i, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS s FROM net),
    low AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS m FROM run)
    SELECT page_id, CAST(max(greatest(s - m, 0)) AS BIGINT) AS nesting FROM low GROUP BY page_id""")
def nesting_depth(spark, folder):
    """Deepest open tag, one tag per line, closing tags counted down but never below zero."""
    lines = F.split("html", ">")
    net = F.transform(lines, lambda l: F.when(l.contains("</"), -1).when(l.contains("<"), 1).otherwise(0))
    return texts(spark, folder, "pages", "page_id", "html").select("page_id", parse.running_depth(net).cast("long").alias("nesting"))


@query("line_heat", f"""WITH {LINE_SYMBOL_SQL},
    ranked AS (SELECT file_path, unnest(range(1, lines + 1)) AS line, CASE WHEN complexity >= 80 THEN 4 WHEN complexity >= 60 THEN 3
               WHEN complexity >= 40 THEN 2 ELSE 1 END AS r FROM sym),
    hot AS (SELECT file_path, line, max(r) AS r FROM ranked GROUP BY 1, 2)
    SELECT file_path, CASE r WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS heat, count(*) AS n_lines, max(line) AS last_line
    FROM hot GROUP BY 1, 2""")
def line_heat(spark, folder):
    return views.heat_runs(model.score_symbols(line_symbols(spark, folder))).groupBy("file_path", "heat").agg(
        F.sum(F.col("line_end") - F.col("line_start") + 1).cast("long").alias("n_lines"), F.max("line_end").cast("long").alias("last_line"))


@query("fuzzy_search", """WITH
    scored AS (SELECT url AS file_path, list_reduce(list_transform(string_split(lower(url), ''), lambda ch: {'c': ch, 'at': 0, 'run': 0, 'score': 0}),
        lambda acc, x: CASE WHEN acc.at < 4 AND x.c = 'page'[acc.at + 1]
            THEN {'c': x.c, 'at': acc.at + 1, 'run': acc.run + 1, 'score': acc.score + acc.run + 1}
            ELSE {'c': x.c, 'at': acc.at, 'run': 0, 'score': acc.score} END, {'c': '', 'at': 0, 'run': 0, 'score': 0}) AS s FROM pages),
    hit AS (SELECT file_path, s.score + CASE WHEN starts_with(lower(split_part(file_path, '/', -1)), 'page') THEN 100 ELSE 0 END AS score FROM scored WHERE s.at = 4)
    SELECT file_path, CAST(score AS BIGINT) AS score FROM hit ORDER BY score DESC, file_path LIMIT 12""")
def fuzzy_search(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("url").alias("file_path"))
    return views.search(pages, "page").select("file_path", F.col("score").cast("long").alias("score"))


# --- parsers ------------------------------------------------------------------
def parsed_sources(spark, folder, adapter):
    engine = "regex" if LANGUAGES[adapter].engine == "regex" else "tree"
    return parse.parse_files(derived.sources(spark, folder, adapter), engines=(engine,))


def parser_query(adapter: str):
    def run(spark, folder):
        return parse.symbol_rows(parsed_sources(spark, folder, adapter)).select(
            "file_path", "name", "kind", *[F.col(c).cast("long").alias(c) for c in ("line_start", "line_end", "nesting_depth", "branch_count")],
            F.size("calls").cast("long").alias("n_calls"))
    sql = derived.symbols_sql(adapter)
    query(f"parse_{adapter}", sql)(run)


for _adapter in derived.TEMPLATES:
    parser_query(_adapter)


@query("parse_html", "WITH tag(name) AS (VALUES " + ", ".join(f"('{t}')" for t in STRUCTURAL_TAGS) + """)
    SELECT '<' || name || '>' AS name, CAST(sum(len(regexp_extract_all(html, '<' || name || '[ >]'))) AS BIGINT) AS n
    FROM pages, tag GROUP BY name HAVING n > 0""")
def parse_html(spark, folder):
    pages = texts(spark, folder, "pages", "page_id", "html").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.lit("html").alias("adapter"), F.col("html").alias("text"))
    return parse.symbol_rows(parse.parse_files(pages, engines=("tree",))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def imports_sql() -> str:
    parts = []
    for adapter, t in derived.TEMPLATES.items():
        if t.raw:
            raw = "'" + t.raw.replace("{k}", "' || l_partkey || '") + "'"
            parts.append(f"SELECT 'src/o' || l_orderkey || '.{t.extension}' AS file_path, {raw} AS raw FROM lineitem")
    return " UNION ALL ".join(parts)


@query("raw_imports", imports_sql())
def raw_imports(spark, folder):
    return parse.import_rows(parse.parse_files(derived.all_sources(spark, folder))).select("file_path", "raw")


def project_sql() -> str:
    parts = []
    for adapter, t in derived.TEMPLATES.items():
        css = adapter == "css"
        branches, calls = ("c", "0") if css else ("d", f"c + {t.calls_itself}")
        extra = len(t.before) + len(t.after) + t.end_newline
        rows = f"""SELECT file_path, {score_sql("len", f"d + {t.base_nesting}", branches, calls)} AS s, len, n_items FROM item"""
        if css:
            rows += "".join(f""" UNION ALL SELECT file_path, {score_sql(str(z - a + 1), "0", str(parts_), "0")}, 0, any_value(n_items) FROM item GROUP BY file_path"""
                            for _, a, z, parts_ in derived.CSS_BEFORE)
        if t.after:
            rows += f""" UNION ALL SELECT file_path, {score_sql("sum(len) + 2", "max(d) + 2", "sum(d)", "0")}, 0, any_value(n_items) FROM item GROUP BY file_path"""
        parts.append(f"""SELECT file_path, '{t.language}' AS language, count(*) AS symbol_count, any_value(n_items) + sum(len) + {extra} AS line_count,
            sum(s) / count(*) AS a, max(s) AS m FROM (WITH item AS ({derived.item_sql(adapter)}) {rows}) GROUP BY file_path""")
    scored = " UNION ALL ".join(parts)
    return f"""WITH f AS ({scored}) SELECT file_path, language, symbol_count, CAST(line_count AS BIGINT) AS line_count,
        round({file_score_sql("a", "m", "symbol_count")}, 6) AS complexity FROM f"""


@query("project_files", project_sql())
def project_files(spark, folder):
    """The whole analysis over a project with a file per order and language."""
    found = Engine(spark).analyze_table(derived.all_sources(spark, folder), "derived")
    return found.files.select("file_path", "language", "symbol_count", F.col("line_count").cast("long").alias("line_count"),
                              F.round("complexity", 6).alias("complexity"))
