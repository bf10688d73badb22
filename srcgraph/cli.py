"""Command line: ``python -m srcgraph.cli <command>``."""
from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcgraph.functions.score import badge
from srcgraph.plans import payloads
from srcgraph.plans.engine import CodeModel, Engine
from srcgraph.session import local_session


def print_rows(frame: DataFrame) -> None:
    """All rows, one line each, a partition at a time."""
    print(" | ".join(frame.columns))
    for row in frame.toLocalIterator():
        print(" | ".join("" if v is None else str(v) for v in row))


def print_document(lines: DataFrame) -> None:
    """A document of ordered lines, a partition at a time."""
    for row in lines.orderBy("position").toLocalIterator():
        print(row.text)


def print_tree(tree: DataFrame) -> None:
    for row in tree.orderBy("position").toLocalIterator():
        print("    " * row.depth + row.label)


def report(model: CodeModel) -> None:
    """Overview, structure tree, hotspots and purposes as text."""
    model.metadata.withColumn("complexity_badge", badge(F.col("avg_complexity"))).show(truncate=False, vertical=True)
    print_tree(model.structure_tree())
    model.hotspots.orderBy("rank").select(
        "rank", "file_path", "symbol", "kind", "language", badge(F.col("complexity")).alias("score"),
        "line_count").show(model.top_n, truncate=False)
    print_rows(model.files.where("purpose IS NOT NULL").orderBy(F.desc("complexity"), "file_ord").select(
        "file_path", "purpose", badge(F.col("complexity")).alias("score")))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="srcgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("path", nargs="?", default=".")
    analyze.add_argument("--json", action="store_true")
    analyze.add_argument("--top", type=int, default=10)
    analyze.add_argument("--lang")
    diff = commands.add_parser("diff")
    diff.add_argument("ref")
    diff.add_argument("--path", default=".")
    diff.add_argument("--lang")
    commands.add_parser("list-adapters")
    for name in ("architecture", "graph"):
        commands.add_parser(name).add_argument("path")
    impact = commands.add_parser("impact")
    impact.add_argument("path")
    impact.add_argument("file")
    symbol = commands.add_parser("symbol-impact")
    symbol.add_argument("path")
    symbol.add_argument("file")
    symbol.add_argument("symbol")
    args = parser.parse_args(argv)

    spark = SparkSession.getActiveSession() or local_session("*", "8")
    engine = Engine(spark)
    if args.command == "list-adapters":
        print_rows(engine.list_adapters().orderBy("adapter"))
    elif args.command == "diff":
        print("\n".join(payloads.diff_lines(engine.diff_revision(args.path, args.ref, args.lang))))
    elif args.command == "analyze":
        model = engine.analyze(args.path, args.top, args.lang)
        if args.json:
            print_document(payloads.project_lines(model))
        else:
            report(model)
    else:
        model = engine.analyze(args.path)
        if args.command == "architecture":
            print_document(payloads.architecture_lines(model))
        elif args.command == "graph":
            print_document(payloads.graph_lines(model))
        elif args.command == "impact":
            print(payloads.to_json(payloads.impact_document(model, args.file)))
        else:
            print(payloads.to_json(payloads.symbol_document(model, args.file, args.symbol)))


if __name__ == "__main__":
    main()
