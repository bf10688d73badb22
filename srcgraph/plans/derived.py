"""Source code written by Spark from the order tables, one file per order.

Every line item becomes one import line and one function, method or rule whose
nesting, branches, calls and length follow from the item's columns.  So parsers
run over as much text as there are line items, and plain SQL can state what
they must find.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Template:
    """Lines of one item; {n} is its name, {k} its part key."""

    extension: str
    language: str
    header: str
    open: str
    close: str | None
    nest: str | None
    unnest: str | None
    call: str
    before: list[str] = field(default_factory=list)   # between the imports and the items
    after: list[str] = field(default_factory=list)
    raw: str = ""                 # what the import line stands for
    kind: str = "function"
    symbol: str = "{n}"
    calls_itself: int = 0         # the signature reads as a call of the own name
    base_nesting: int = 1         # nesting of an item without nested blocks
    end_newline: int = 0          # the line count includes a last empty line


BRACE = dict(close="}", nest="if (a) {", unnest="}", call="helper_{i}(a);")
IN_CLASS = dict(before=["class Box {"], after=["}"], kind="method", calls_itself=1)
TEMPLATES = {
    "javascript": Template("js", "JavaScript/TypeScript", "import { a } from './m{k}';", "function {n}(a) {", **BRACE,
                           raw="./m{k}", calls_itself=1),
    "c": Template("c", "C/C++", '#include "m{k}.h"', "int {n}(int a) {", **BRACE, raw="m{k}.h", calls_itself=1),
    "java": Template("java", "Java", "import com.acme.M{k};", "    public void {n}(int a) {", **BRACE, **IN_CLASS,
                     raw="com.acme.M{k}"),
    "csharp": Template("cs", "C#", "using Acme.M{k};", "    public void {n}(int a) {", **BRACE, **IN_CLASS, raw="Acme.M{k}"),
    "go": Template("go", "Go", 'import "acme/m{k}"', "func {n}(a int) {", **{**BRACE, "nest": "if a {"},
                   raw="acme/m{k}", calls_itself=1),
    "rust": Template("rs", "Rust", "use crate::acme::m{k};", "pub fn {n}(a: i32) {", **{**BRACE, "nest": "if a {"},
                     raw="acme/m{k}", calls_itself=1),
    "dart": Template("dart", "Dart", "import 'm{k}.dart';", "  void {n}(int a) {", **BRACE, **IN_CLASS, raw="m{k}.dart"),
    "php": Template("php", "PHP", "use Acme\\M{k};", "    public function {n}($a) {", **BRACE, **IN_CLASS, raw="Acme/M{k}"),
    "r": Template("r", "R", 'source("m{k}.R")', "{n} <- function(a) {", **BRACE, raw="m{k}.R"),
    "sql": Template("sql", "SQL", "-- part {k}", "CREATE FUNCTION {n} AS BEGIN", "END;", "BEGIN IF a", "END",
                    "CALL helper_{i}(a);", symbol="{n} (function)"),
    "python": Template("py", "Python", "from acme.m{k} import a", "def {n}(a):", None, "if a:", None, "helper_{i}(a)",
                       raw="acme.m{k}", base_nesting=0, end_newline=1),
    "css": Template("css", "CSS", '@import "m{k}.css";', ".{n} {", "}", None, None, "color: red;", raw="m{k}.css",
                    kind="css_rule", symbol=".{n}", base_nesting=0,
                    before=["* {", "margin: 0;", "}", "/* .no{a:b} */ .one{c:'}'} @media print{.two{e:f;}}"]),
}
# Rules of the lines before the items of a style sheet: name, first and last line after the imports, semicolons.
CSS_BEFORE = [("*", 1, 3, 1), (".one", 4, 4, 0), (".two", 4, 4, 1)]
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def counted_up(last: int) -> list[int]:
    """What ``sequence(1, last)`` holds: it runs down if ``last`` is below 1."""
    return list(range(1, last + 1)) if last > 0 else list(range(1, last - 1, -1))


def item_text(template: Template, item: Column) -> Column:
    """The lines of one prepared item, each with its break; a line without a name is left out."""
    depth, calls = item["depth"], item["calls"]
    python = template.close is None

    def line(text: str) -> Column:
        parts = (text + "\n").split("{n}")
        return F.concat(*[x for i, p in enumerate(parts) for x in ([item["name"]] if i else []) + [F.lit(p)]])

    def call_lines(last: int) -> Column:
        texts = [template.call.replace("{i}", str(i)) + "\n" for i in counted_up(last)]
        if not python:
            return F.lit("".join(texts))
        return F.concat(*[x for text in texts for x in (F.repeat(F.lit("    "), depth + 1), F.lit(text))])

    out = [F.coalesce(line(template.open), F.lit(""))]
    if template.nest and python:
        out.append(F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(
            F.repeat(F.lit("    "), i), F.lit(template.nest + "\n"))), ""))
    elif template.nest:
        out.append(F.repeat(F.lit(template.nest + "\n"), F.when(depth > 0, depth).otherwise(2 - depth)))
    by_count = F
    for last in range(-1, 4):  # what n % 3 + 1 can be
        by_count = by_count.when(calls == last, call_lines(last))
    out.append(by_count)
    if template.unnest:
        out.append(F.repeat(F.lit(template.unnest + "\n"), depth))
    if template.close:
        out.append(F.lit(template.close + "\n"))
    return F.concat(*out)


ITEMS_PER_TASK = 100_000


def ordered_items(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, items): the line items of each order in their order.

    Only the few numbers a text is made of are shuffled; tasks grow in number
    with the table, because a task writes and parses the text of its items.
    """
    items = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", *ORDER)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ITEMS_PER_TASK))
    return items.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER))).alias("items"))


def prepared_items(spark: SparkSession, folder: str) -> DataFrame:
    """(l_orderkey, items): of every line item what the texts of all languages are made of."""
    def prepared(i):
        part = i["l_partkey"].cast("string")
        return F.struct(
            part.alias("part"), F.concat(F.lit("fn_"), part, F.lit("_"), i["l_suppkey"].cast("string")).alias("name"),
            i["l_linenumber"].cast("int").alias("depth"), (i["l_quantity"].cast("int") % 3 + 1).alias("calls"))
    return ordered_items(spark, folder).select("l_orderkey", F.transform("items", prepared).alias("items"))


def text_of(template: Template) -> Column:
    """The text of an order: its imports, then its items, ending with a newline; null if an item has no measures."""
    before, _, after = template.header.partition("{k}")

    def joined(line) -> Column:
        return F.array_join(F.transform("items", line), "")

    def fixed(lines):
        return F.lit("".join(l + "\n" for l in lines))
    unknown = F.exists("items", lambda i: i["calls"].isNull() | (i["depth"].isNull() if template.nest else F.lit(False)))
    return F.when(~unknown, F.concat(
        joined(lambda i: F.concat(F.lit(before), i["part"], F.lit(after + "\n"))), fixed(template.before),
        joined(lambda i: item_text(template, i)), fixed(template.after)))


def files_of(items: DataFrame, adapters: list[str]) -> DataFrame:
    """(file_path, adapter, text): a file per order and adapter.

    The adapter comes before the text, so whoever asks for some adapters makes no text of the others.
    """
    path, text = F, F
    for adapter in adapters:
        template, own = TEMPLATES[adapter], F.col("adapter") == adapter
        path = path.when(own, F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), F.lit("." + template.extension)))
        text = text.when(own, text_of(template))
    listed = items.select("l_orderkey", "items", F.explode(F.array(*map(F.lit, adapters))).alias("adapter"))
    return listed.select(path.alias("file_path"), "adapter", text.alias("text"))


def sources(spark: SparkSession, folder: str, adapter: str) -> DataFrame:
    """(file_path, adapter, text): one file per order, ending with a newline."""
    return files_of(prepared_items(spark, folder), [adapter])


def all_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The files of all languages, from one shuffle of the line items."""
    return files_of(prepared_items(spark, folder), list(TEMPLATES))


# --- what SQL says the parsers must find --------------------------------------
def item_sql(adapter: str) -> str:
    """CTE body: one row per item with its place and measures in the file."""
    t = TEMPLATES[adapter]
    fixed = 1 + (t.close is not None)
    nested = (t.nest is not None) + (t.unnest is not None)
    order = ", ".join(ORDER)
    depth = "l_linenumber" if t.nest else "0"
    return f"""
      SELECT *, n_items + {len(t.before)} + sum(len) OVER w - len + 1 AS line_start,
             n_items + {len(t.before)} + sum(len) OVER w AS line_end,
             row_number() OVER w AS rn
      FROM (SELECT l_orderkey, {order}, 'src/o' || l_orderkey || '.{t.extension}' AS file_path,
                   'fn_' || l_partkey || '_' || l_suppkey AS n, {depth} AS d,
                   CAST(l_quantity AS INT) % 3 + 1 AS c,
                   {fixed} + {nested} * l_linenumber + CAST(l_quantity AS INT) % 3 + 1 AS len,
                   count(*) OVER (PARTITION BY l_orderkey) AS n_items
            FROM lineitem)
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY {order} ROWS UNBOUNDED PRECEDING)"""


def symbols_sql(adapter: str) -> str:
    """Expected rows: file_path, name, kind, line_start, line_end, nesting_depth, branch_count, n_calls."""
    t = TEMPLATES[adapter]
    symbol = "'" + t.symbol.replace("{n}", "' || n || '") + "'"
    css = adapter == "css"
    branches, calls = ("c", "0") if css else ("d", f"c + {t.calls_itself}")
    deeper = 1 if t.after else 0
    rows = f"""
      SELECT file_path, {symbol} AS name, '{t.kind}' AS kind, line_start, line_end,
             d + {t.base_nesting} AS nesting_depth, {branches} AS branch_count, {calls} AS n_calls FROM item"""
    if css:
        rows += "".join(f"""
      UNION ALL
      SELECT file_path, '{name}', 'css_rule', any_value(n_items) + {a}, any_value(n_items) + {z}, 0, {parts}, 0
      FROM item GROUP BY file_path""" for name, a, z, parts in CSS_BEFORE)
    if deeper:
        rows += """
      UNION ALL
      SELECT file_path, 'Box', 'class', any_value(n_items) + 1, max(line_end) + 1, max(d) + 2, sum(d), 0
      FROM item GROUP BY file_path"""
    numbers = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("line_start", "line_end", "nesting_depth", "branch_count", "n_calls"))
    return f"WITH item AS ({item_sql(adapter)}) SELECT file_path, name, kind, {numbers} FROM ({rows})"
