"""Whole analyses: a source tree in, a bundle of lazily evaluated tables out."""
from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from srcgraph.functions import paths
from srcgraph.functions.domains import domain_table
from srcgraph.functions.fixed import CROSS_CUTTING_MIN, MONOLITH_MIN
from srcgraph.functions.languages import AdapterRegistry
from srcgraph.functions.purpose import exempt_from_dead
from srcgraph.operators import compare, documents, graph, model, resolve, splits, usage, views
from srcgraph.operators.parse import import_rows, parse_files, parse_listing, symbol_rows
from srcgraph.session import cut
from srcgraph.sources.cache import ParseCache
from srcgraph.sources.git import blob_id, revision_sources, with_blob_text
from srcgraph.sources.scan import detect_languages, read_content, scan_sources, with_text


@dataclass
class CodeModel:
    """Tables of one project.  Each is built once, when first used."""

    spark: SparkSession
    project: str
    parsed: DataFrame
    registry: AdapterRegistry
    domains: DataFrame
    top_n: int = 10
    root: str | None = None

    def release(self) -> None:
        """Give back the blocks of this model; its tables can still be computed anew."""
        for name in ("parsed", "files", "edges"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def imports(self) -> DataFrame:
        return import_rows(self.parsed)

    @cached_property
    def symbols(self) -> DataFrame:
        return model.score_symbols(symbol_rows(self.parsed))

    @cached_property
    def files(self) -> DataFrame:
        listed = self.parsed.select("file_path", "adapter", "language", "line_count", "parse_status")
        described = model.describe_files(listed, model.symbol_summary(self.symbols))
        return described.withColumn("file_ord", model.file_order(F.col("adapter"), F.col("file_path"))).persist(
            StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def edges(self) -> DataFrame:
        resolved = resolve.resolve_imports(self.imports, self.files.select("file_path", "file_ord"))
        return resolve.dependency_edges(resolved).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def edge_usage(self) -> DataFrame:
        return resolve.edge_usage(self.edges, self.parsed.select("file_path", "imports"))

    @cached_property
    def file_domains(self) -> DataFrame:
        return resolve.file_domains(self.imports, self.domains)

    @cached_property
    def metadata(self) -> DataFrame:
        adapters = self.files.groupBy("adapter").count().select(
            F.array_sort(F.collect_list(F.initcap("adapter"))).alias("languages"))
        modules = self.modules.where("parent_module IS NULL").agg(F.count(F.lit(1)).alias("total_modules"))
        totals = model.project_metadata(self.files).withColumn("one", F.lit(1))
        return totals.join(F.broadcast(adapters.withColumn("one", F.lit(1))), "one").join(
            F.broadcast(modules.withColumn("one", F.lit(1))), "one").drop("one")

    @cached_property
    def modules(self) -> DataFrame:
        return model.module_rollup(self.files)

    @cached_property
    def hotspots(self) -> DataFrame:
        scored = self.symbols.withColumn("file_ord", model.file_order(F.col("adapter"), F.col("file_path")))
        return model.hotspots(scored, self.top_n, ["file_ord", "top_ord", "sub_ord"]).select(
            "rank", "file_path", F.col("name").alias("symbol"), "kind", "language", "complexity",
            "heat", "line_start", "line_end", "line_count")

    @cached_property
    def definitions(self) -> DataFrame:
        return self.symbols.where("language = 'Python' AND depth = 0 AND kind IN ('class', 'function')").select(
            "file_path", "name")

    @cached_property
    def usages(self) -> DataFrame:
        python = self.parsed.where("language = 'Python'")
        bindings = python.select("file_path", F.posexplode("bindings").alias("pos", "b")).select("file_path", "pos", "b.*")
        references = python.select("file_path", F.explode("references").alias("r")).select("file_path", "r.*")
        return usage.symbol_usages(bindings, references, self.definitions, python.select("file_path"))

    # --- reports ------------------------------------------------------------
    def monolithic_files(self) -> DataFrame:
        return graph.monoliths(self.edges, MONOLITH_MIN).withColumn("suggestion", F.concat(
            paths.basename(F.col("file_path")), F.lit(" is imported by "), F.col("dependents").cast("string"),
            F.lit(" files. Changes here ripple widely — consider narrowing its public API.")))

    def circular_dependencies(self) -> DataFrame:
        return graph.mutual_pairs(self.edges).withColumn("suggestion", F.concat(
            F.lit("Tight coupling between "), F.col("a"), F.lit(" and "), F.col("b"),
            F.lit(". Extract the shared symbols into a third module.")))

    def dead_files(self) -> DataFrame:
        return graph.isolated(self.files.where(~exempt_from_dead(F.col("purpose"))).select("file_path"), self.edges).withColumn(
            "suggestion", F.lit("Disconnected from the rest of the codebase."))

    def cross_cutting_files(self) -> DataFrame:
        return resolve.cross_cutting(self.file_domains, CROSS_CUTTING_MIN)

    @cached_property
    def clusters(self) -> DataFrame:
        return splits.split_clusters(self.symbols)

    def split_candidates(self, top_n: int = 8) -> DataFrame:
        return splits.split_candidates(self.clusters, self.files, top_n)

    def architecture_summary(self) -> DataFrame:
        """One row: counts of each finding and the summary sentence."""
        findings = [("files", self.files), ("highly coupled", self.monolithic_files()),
                    ("circular", self.circular_dependencies()), ("cross-cutting", self.cross_cutting_files()),
                    ("split candidates", self.split_candidates())]
        counted = None
        for i, (label, frame) in enumerate(findings):
            part = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), F.lit(label).alias("label"), "n")
            counted = part if counted is None else counted.unionByName(part)
        text = F.when(F.col("i") == 0, F.concat(F.lit("Analyzed "), F.col("n").cast("string"), F.lit(" files"))).when(
            F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" "), F.col("label")))
        listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("i", text.alias("text")))))
        return counted.agg(F.concat(F.array_join(F.transform(listed, lambda p: p["text"]), ", "), F.lit(".")).alias("summary"))

    def structure_tree(self) -> DataFrame:
        """(position, depth, label) of modules, files and two levels of symbols in reading order."""
        return documents.structure_tree(self.files, self.symbols, self.project)

    def graph_nodes(self) -> DataFrame:
        return views.graph_nodes(self.files, self.project, self.file_domains)

    def graph_links(self) -> DataFrame:
        return views.graph_links(self.files, self.edge_usage)

    def impact(self, path: str, directions=("upstream", "downstream"), max_depth: int | None = None) -> DataFrame:
        return graph.reach(self.edges, path, directions, max_depth)

    def impact_sizes(self, max_depth: int | None = None) -> DataFrame:
        """(direction, node, direct, indirect, total, max_depth): the impact of every file that has an edge."""
        return graph.impact_sizes(self.edges, max_depth)

    def symbol_impact(self, path: str, symbol: str) -> DataFrame:
        return self.usages.where((F.col("def_file") == path) & (F.col("symbol") == symbol)).orderBy("use_file", "line")

    def search(self, query: str, top_n: int = 12) -> DataFrame:
        return views.search(self.files, query, top_n)


class Engine:
    """Entry point: ``Engine(spark).analyze(root)``."""

    def __init__(self, spark: SparkSession, registry: AdapterRegistry | None = None,
                 domains: DataFrame | None = None, cache: ParseCache | None = None):
        self.spark, self.cache = spark, cache
        self.registry = registry or AdapterRegistry()
        self.domains = domains if domains is not None else domain_table(spark)

    def analyze(self, root: str, top_n: int = 10, lang: str | None = None,
                ignore: list[str] | None = None) -> CodeModel:
        listing = scan_sources(self.spark, root, self.registry, lang, ignore, content=False)
        read = partial(with_text, root=root)
        parsed = self.cache.parse(listing, self.registry, read) if self.cache else parse_listing(listing, read, self.registry)
        return self._model(parsed, os.path.basename(root.rstrip("/")), top_n, root)

    def analyze_table(self, files: DataFrame, project: str = "", top_n: int = 10,
                      root: str | None = None) -> CodeModel:
        """Analyse a table (file_path, adapter, text), for example a corpus kept in Parquet."""
        parsed = self.cache.parse(files, self.registry) if self.cache else parse_files(files, self.registry)
        return self._model(parsed, project, top_n, root)

    def _model(self, parsed: DataFrame, project: str, top_n: int, root: str | None) -> CodeModel:
        return CodeModel(self.spark, project, parsed.persist(StorageLevel.MEMORY_AND_DISK),
                         self.registry, self.domains, top_n, root)

    def detect_languages(self, root: str) -> list[str]:
        return detect_languages(self.spark, root, self.registry)

    def list_adapters(self) -> DataFrame:
        return self.registry.frame(self.spark).select(
            "adapter", F.array_sort(F.transform("extensions", lambda e: F.concat(F.lit("."), e))).alias("extensions"))

    def analyze_revision(self, repository: str, ref: str, top_n: int = 10, lang: str | None = None,
                         ignore: list[str] | None = None) -> CodeModel:
        """Analyse a git revision; ``repository`` is a folder all executors see."""
        listing = revision_sources(self.spark, repository, ref, self.registry, lang, ignore)
        return self._blobs(listing, repository, top_n)

    def _blobs(self, listing: DataFrame, repository: str, top_n: int = 10) -> CodeModel:
        parsed = parse_listing(listing, partial(with_blob_text, repository=repository), self.registry)
        return self._model(parsed, os.path.basename(repository.rstrip("/")), top_n, None)

    def diff(self, old_root: str, new_root: str, lang: str | None = None) -> DataFrame:
        return self.diff_models(self.analyze(old_root, lang=lang), self.analyze(new_root, lang=lang))

    def diff_models(self, old: CodeModel, new: CodeModel) -> DataFrame:
        return compare.diff_order(compare.diff_files(*(m.files.select("file_path", "complexity") for m in (old, new))))

    def diff_revision(self, repository: str, ref: str, lang: str | None = None, other: str | None = None) -> DataFrame:
        """A revision against the working tree, or against the revision ``other``.

        Files of the same path and blob are the same and are never parsed.  The
        working tree is read once for its blob ids, changed files once more.
        """
        was, _ = cut(revision_sources(self.spark, repository, ref, self.registry, lang))
        if other is None:
            listing = scan_sources(self.spark, repository, self.registry, lang, content=False)
            now, _ = cut(read_content(listing, repository).select(*listing.columns, blob_id(F.col("content")).alias("blob")))
        else:
            now, _ = cut(revision_sources(self.spark, repository, other, self.registry, lang))
        same = ["file_path", "blob"]
        before = self._blobs(was.join(now.select(*same), same, "left_anti"), repository)
        changed = now.join(was.select(*same), same, "left_anti")
        if other is None:
            after = self._model(parse_listing(changed, partial(with_text, root=repository), self.registry), before.project, 10, None)
        else:
            after = self._blobs(changed, repository)
        return self.diff_models(before, after)
