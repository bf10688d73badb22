"""Files and symbols with scores, purposes, narration, roll-ups and metadata.

Canonical inputs
    files    file_path, adapter, language, line_count
    symbols  file_path, top_ord, sub_ord, depth, name, kind, line_start, line_end,
             nesting_depth, branch_count, calls | n_calls, docstring
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcgraph.functions import paths
from srcgraph.functions.fixed import DOMINANT_SHARE, KEYWORD_ROWS
from srcgraph.functions.narrate import narration
from srcgraph.functions.purpose import (
    dominant_kind_purpose, keyword_purpose, name_purpose, size_purpose,
)
from srcgraph.functions.score import file_score, heat_label, symbol_score

KINDS = ["class", "function", "css_rule", "html_node"]


def file_order(adapter: Column, path: Column) -> Column:
    """Sort key: by adapter, root files first, then directories depth first."""
    return F.struct(adapter.alias("adapter"), F.split(paths.dirname(path), "/").alias("dir"),
                    paths.basename(path).alias("name"))


def score_symbols(symbols: DataFrame) -> DataFrame:
    """Add line_count, complexity and heat."""
    calls = F.col("n_calls") if "n_calls" in symbols.columns else F.size("calls")
    lines = F.col("line_end") - F.col("line_start") + 1
    score = symbol_score(lines, F.col("nesting_depth"), F.col("branch_count"), calls)
    if "unclosed" in symbols.columns:  # an element below level 1 that never closed stays at 0
        score = F.when(F.col("unclosed") & (F.col("depth") > 1), F.lit(0.0)).otherwise(score)
    return (symbols.withColumn("line_count", lines).withColumn("complexity", score)
            .withColumn("heat", heat_label(F.col("complexity"))))


def score_aggregate(scored: DataFrame) -> DataFrame:
    """Per file: mean, maximum and number of the scores of levels 0 and 1."""
    return scored.where("depth <= 1").groupBy("file_path").agg(
        (F.sum("complexity") / F.count(F.lit(1))).alias("avg_score"), F.max("complexity").alias("max_score"),
        F.count(F.lit(1)).alias("symbol_count"))


def dominant_kinds(symbols: DataFrame, share: float = DOMINANT_SHARE, kinds: list[str] = KINDS) -> DataFrame:
    """(file_path, kind, total) of files where one kind makes up ``share`` of the top-level symbols."""
    counts = symbols.where("depth = 0").groupBy("file_path").agg(F.count(F.lit(1)).alias("total"), *[
        F.sum((F.col("kind") == k).cast("long")).alias(k) for k in kinds])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("kind")) for k in kinds]))
    return counts.withColumn("best", best).where(F.col("best.n") / F.col("total") >= share).select(
        "file_path", "best.kind", "total")


def keyword_row(text: Column) -> Column:
    """1-based position of the first keyword row with a hit."""
    labels = F.array(*[F.lit(label) for label, _ in KEYWORD_ROWS])
    return F.array_position(labels, keyword_purpose(text))


def symbol_summary(scored: DataFrame) -> DataFrame:
    """Per file: score aggregate, kind counts, first names and keyword rows of its symbols.

    Only levels 0 and 1 count.  Every aggregate combines before the shuffle, so
    a file costs one shuffled row however many symbols it has.
    """
    visible = (scored.where("depth <= 1").withColumn("doc_hit", keyword_row(F.col("docstring")))
               .withColumn("name_hit", F.when(F.col("depth") == 0, keyword_row(F.col("name")))))
    top = F.col("depth") == 0
    per_top = visible.groupBy("file_path", "top_ord").agg(
        F.sum("complexity").alias("sum_score"),
        F.max("complexity").alias("max_score"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(top, F.col("name"))).alias("name"),
        F.max(F.when(top, F.col("kind"))).alias("kind"),
        F.max(F.when(top, F.col("docstring"))).alias("doc"),
        F.min(F.when(F.col("name_hit") > 0, F.col("name_hit"))).alias("name_row"),
        F.min_by("doc_hit", F.when(F.col("doc_hit") > 0, F.col("sub_ord"))).alias("doc_row"))
    position = F.col("top_ord")
    doc_row = F.when(F.length(F.coalesce("doc", F.lit(""))) > 0, F.col("doc_row"))
    return per_top.groupBy("file_path").agg(
        (F.sum("sum_score") / F.sum("n")).alias("avg_score"), F.max("max_score").alias("max_score"),
        F.sum("n").alias("symbol_count"), F.count(F.lit(1)).alias("n_top"),
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.array_compact(F.array(*[F.max(F.when(position == i, F.col("name"))) for i in range(3)])).alias("first_names"),
        F.min("name_row").alias("name_row"),
        F.min_by(doc_row, F.when(doc_row.isNotNull(), position)).alias("doc_row"))


def describe_files(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Add complexity, heat, purpose, narration, symbol_count, first_names and n_top."""
    labels = F.array(*[F.lit(label) for label, _ in KEYWORD_ROWS])
    joined = files.join(summary, "file_path", "left")
    n_top = F.coalesce(F.col("n_top"), F.lit(0))
    counts = F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS])
    strongest = F.array_max(counts)
    score = file_score(F.col("avg_score"), F.col("max_score"), F.col("symbol_count"), F.col("line_count"))
    purpose = F.coalesce(
        name_purpose(paths.basename(paths.dirname(F.col("file_path"))),
                     paths.stem(paths.basename(F.col("file_path")))),
        F.get(labels, (F.col("doc_row") - 1).cast("int")),
        F.get(labels, (F.col("name_row") - 1).cast("int")),
        dominant_kind_purpose(strongest["kind"], strongest["n"] / F.col("n_top"), F.col("symbol_count")),
        size_purpose(F.col("line_count")))
    return (joined.withColumn("name", paths.basename(F.col("file_path")))
            .withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))
            .withColumn("n_top", n_top)
            .withColumn("first_names", F.coalesce("first_names", F.array().cast("array<string>")))
            .withColumn("complexity", score).withColumn("heat", heat_label(F.col("complexity")))
            .withColumn("purpose", purpose)
            .withColumn("narration", narration(F.col("purpose"), F.col("n_top"), F.col("first_names"), F.col("heat")))
            .select(*files.columns, "name", "symbol_count", "n_top", "first_names", "complexity",
                    "heat", "purpose", "narration"))


def directory_chain(dirs: DataFrame) -> DataFrame:
    """(adapter, dir) -> one row per module the directory counts towards.

    A directory with files is a module.  It is nested in its parent only if
    that one is a module too, so the chain upwards ends at the first gap.
    """
    own = dirs.select("adapter", "dir", F.size(F.split("dir", "/")).alias("level"))
    above = own.select("adapter", "dir", "level", F.explode(paths.ancestors(F.col("dir"))).alias("module"))
    present = above.join(own.select("adapter", F.col("dir").alias("module")), ["adapter", "module"])
    levels = present.groupBy("adapter", "dir", "level").agg(
        F.sort_array(F.collect_list(F.size(F.split("module", "/"))), asc=False).alias("found"))
    # contiguous run below the directory: level-1, level-2, ...
    linked = levels.select("adapter", "dir", F.filter(
        "found", lambda l, i: l == F.col("level") - 1 - i).alias("linked"))
    nested = linked.select("adapter", "dir", F.explode("linked").alias("level")).select(
        "adapter", "dir", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("level")), "/").alias("module"))
    return nested.unionByName(own.select("adapter", "dir", F.col("dir").alias("module")))


def module_rollup(files: DataFrame) -> DataFrame:
    """Recursive totals per module from (adapter, file_path, line_count, symbol_count, complexity)."""
    per_dir = (files.withColumn("dir", paths.dirname(F.col("file_path"))).where("dir <> ''")
               .groupBy("adapter", "dir").agg(
                   F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"),
                   F.sum("symbol_count").alias("symbols"), F.sum("complexity").alias("score")))
    chain = directory_chain(per_dir)
    totals = chain.join(per_dir, ["adapter", "dir"]).groupBy("adapter", "module").agg(
        F.sum("files").alias("total_files"), F.sum("lines").alias("total_lines"),
        F.sum("symbols").alias("total_symbols"), (F.sum("score") / F.sum("files")).alias("avg_complexity"))
    inside = chain.where("module <> dir").select(
        "adapter", F.col("dir").alias("module")).distinct().withColumn("nested", F.lit(True))
    return totals.join(inside, ["adapter", "module"], "left").select(
        "adapter", "module", paths.basename(F.col("module")).alias("name"),
        F.when(F.col("nested"), paths.dirname(F.col("module"))).alias("parent_module"),
        "total_files", "total_lines", "total_symbols", "avg_complexity")


def project_metadata(files: DataFrame) -> DataFrame:
    """One row of totals; needs adapter, file_path, language, line_count, symbol_count, complexity."""
    first = F.struct(-F.col("complexity"), file_order(F.col("adapter"), F.col("file_path")))
    per_language = files.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"),
        F.sum("symbol_count").alias("symbols"), F.sum("complexity").alias("score"),
        F.min_by(F.struct("file_path", "complexity"), first).alias("worst"), F.min(first).alias("rank"))
    counted = F.col("language").isNotNull() & (F.col("language") != "Unknown")
    return per_language.agg(
        F.sum("files").alias("total_files"), F.sum("lines").alias("total_lines"),
        F.sum("symbols").alias("total_symbols"),
        (F.sum("score") / F.sum("files")).alias("avg_complexity"),
        F.min_by("worst", "rank").alias("worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(counted, F.struct("language", "files"))))).alias("language_file_counts"),
    ).select("total_files", "total_lines", "total_symbols", "avg_complexity",
             F.col("worst.file_path").alias("max_complexity_file"),
             F.col("worst.complexity").alias("max_complexity_score"), "language_file_counts")


def hotspots(scored: DataFrame, top_n: int = 10, order: list | None = None) -> DataFrame:
    """Ranked top symbols of levels 0 and 1; ``order`` breaks ties."""
    order = order or ["file_path", "top_ord", "sub_ord"]
    top = scored.where("depth <= 1").orderBy(F.desc("complexity"), *order).limit(top_n)
    place = Window.orderBy(F.desc("complexity"), *order)  # over top_n rows only
    return top.withColumn("rank", F.row_number().over(place))


def heat_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("heat").agg(F.count(F.lit(1)).alias("n"))


def language_counts(files: DataFrame) -> DataFrame:
    return (files.where(F.col("language").isNotNull() & (F.col("language") != "Unknown"))
            .groupBy("language").agg(F.count(F.lit(1)).alias("n_files")))

