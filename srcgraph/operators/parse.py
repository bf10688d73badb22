"""Source text -> symbols, imports and line counts.

One narrow pass without a shuffle.  For the ``regex`` languages the text work
runs in JVM expressions with one branch per registered language, so that its
patterns are literals; only small integer arrays go through Arrow to find
block ends.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from srcgraph.functions.languages import FLAGS, GOOD, AdapterRegistry, Language, Mark
from srcgraph.functions.trees import TREE_PARSERS, block_layout, called_in, deepest

SYMBOL_TYPE = T.StructType([
    T.StructField("top_ord", T.IntegerType()),      # position among top-level symbols
    T.StructField("sub_ord", T.IntegerType()),      # 0, or position below that symbol
    T.StructField("parent_sub", T.IntegerType()),   # sub_ord of the parent, null at top level
    T.StructField("depth", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("nesting_depth", T.IntegerType()),
    T.StructField("branch_count", T.IntegerType()),
    T.StructField("calls", T.ArrayType(T.StringType())),
    T.StructField("docstring", T.StringType()),
    T.StructField("unclosed", T.BooleanType()),
])
BINDING_TYPE = T.StructType([
    T.StructField("form", T.StringType()), T.StructField("module", T.StringType()),
    T.StructField("level", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("local", T.StringType())])
REFERENCE_TYPE = T.StructType([
    T.StructField("base", T.StringType()), T.StructField("attr", T.StringType()),
    T.StructField("line", T.IntegerType())])
TREE_TYPE = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("line_count", T.IntegerType()),
    T.StructField("symbols", T.ArrayType(SYMBOL_TYPE)),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("bindings", T.ArrayType(BINDING_TYPE)),
    T.StructField("references", T.ArrayType(REFERENCE_TYPE))])
LAYOUT_TYPE = T.StructType([
    T.StructField("line_count", T.IntegerType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("low", T.ArrayType(T.IntegerType())),
    T.StructField("high", T.ArrayType(T.IntegerType())),
    T.StructField("keep", T.ArrayType(T.BooleanType())),
    T.StructField("nesting", T.ArrayType(T.IntegerType())),
    T.StructField("branches", T.ArrayType(T.IntegerType())),
    T.StructField("calls", T.ArrayType(T.ArrayType(T.StringType())))])

DECLARED_TYPE = "array<struct<role:string,kind:string,calls:boolean,rule:int,at:int,name:string>>"
OTHER_BREAKS = "\u000b\f\u001c\u001d\u001e\u0085  "  # end a line as \n does
HIT, END, BRANCH, OPEN, CLOSE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
PARSED_COLUMNS = ["file_path", "adapter", "language", "line_count", "parse_status", "symbols",
                  "imports", "bindings", "references"]


def decode(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 becomes U+FFFD, every newline form becomes \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


def one_break(text: Column) -> Column:
    return F.translate(text, OTHER_BREAKS, "\n" * len(OTHER_BREAKS))


def split_lines(text: Column) -> Column:
    """Lines of a text with one kind of break; a break at the very end does not start another line."""
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def count_char(line: Column, char: Column) -> Column:
    """Occurrences of a one-byte character."""
    return F.octet_length(line) - F.octet_length(F.replace(line, char, F.lit("")))


def count(line: Column, pattern: Column | str) -> Column:
    return F.regexp_count(line, pattern if isinstance(pattern, Column) else F.lit(pattern))


def running_depth(net: Column) -> Column:
    """Deepest point of the running sum of ``net`` that never drops below zero."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state, value):
        now = F.greatest(state["now"] + value, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(net, start, step, lambda state: state["most"])


def nesting_depth(text: Column, opener: str = r"\{", closer: str = r"\}") -> Column:
    return running_depth(F.transform(split_lines(one_break(text)),
                                     lambda l: count(l, opener) - count(l, closer)))


def branch_count(text: Column, pattern: str) -> Column:
    return count(text, pattern)


def called_names(text: Column, pattern: str) -> Column:
    """Distinct called names; the pattern of a language row leaves its keywords out."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def by_language(languages: list[Language], value) -> Column:
    """``value`` of the row's language.  Each branch has literal patterns, which Spark compiles once, not once per file."""
    out = F
    for language in languages:
        out = out.when(F.col("adapter") == language.adapter, value(language))
    return out.otherwise(F.lit(None)) if languages else F.lit(None)


def import_strings(text: Column, rules: list[dict]) -> Column:
    """Raw imports, rule by rule and in text order within a rule."""
    def hits(rule):
        found = F.regexp_extract_all(text, F.lit(rule["pattern"]), 1)
        if rule["inner"]:
            found = F.flatten(F.transform(found, lambda block: F.regexp_extract_all(block, F.lit(rule["inner"]), 1)))
        if rule["separator"]:
            skipped = list(rule["skip"]) or ["\u0000"]
            found = F.transform(found, lambda raw: F.array_join(F.filter(
                F.split(raw, rf"\Q{rule['separator']}\E"), lambda p: ~p.isin(skipped)), "/"))
        if rule["drop"]:
            return F.filter(found, lambda raw: (raw != "") & ~F.rlike(raw, F.lit(rule["drop"])))
        return F.filter(found, lambda raw: raw != "")

    return F.flatten(F.array(*map(hits, rules))) if rules else F.array().cast("array<string>")


def guarded(text: Column, mark: Mark) -> Column:
    """The text with the marks of ``mark``: pieces between closers know whether their own closer is a good one."""
    closer = f"\\Q{mark.closer}\\E"
    good = f"{FLAGS}{closer}(?={mark.follow})"
    pieces = F.split(F.regexp_replace(text, F.lit(good), F.lit(mark.closer + GOOD)), closer)
    after = F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, after, lambda piece, next_piece: F.when(
        next_piece.startswith(GOOD), F.regexp_replace(piece, F.lit(FLAGS + mark.opener), F.lit("$0" + GOOD))).otherwise(piece)), mark.closer)
    # a text without a good closer has no marks and need not be cut up
    return F.when(F.rlike(text, F.lit(good)), joined).otherwise(text)


def marked_by_rule(text: Column, language: Language) -> Column:
    """Per rule the text in pieces: what precedes its first hit, then a piece from every hit on.

    A hit starts a line, so the breaks in the pieces before it give its line.
    """
    def pieces(rule):
        source = F.col("guarded") if GOOD in rule["pattern"] else text
        return F.split(F.regexp_replace(source, F.lit(rule["pattern"]), F.lit(f"{HIT}{rule['label']}{END}$0")), HIT)

    return F.array(*map(pieces, language.rules)).cast("array<array<string>>")


def declarations(pieces: Column, language: Language) -> Column:
    """Every declaration hit with its rule and place among the pieces of the rule, in rule order then line order."""
    def hits(number, rule):
        own = F.get(pieces, F.lit(number))
        found = F.transform(
            F.slice(own, F.lit(2), F.size(own)),
            lambda p, i: F.struct(
                F.lit(rule["role"]).alias("role"), F.lit(rule["kind"]).alias("kind"), F.lit(rule["calls"]).alias("calls"),
                F.lit(number).alias("rule"), (i + 1).alias("at"),
                clean_name(F.substring_index(p, END, 1), rule["kind"], language.name_junk).alias("name")))
        return F.filter(found, lambda d: ~d["name"].isin(["", *rule["exclude"]]))

    found = F.flatten(F.array(*[hits(i, r) for i, r in enumerate(language.rules)])) if language.rules else F.array()
    return found.cast(DECLARED_TYPE)


def clean_name(name: Column, kind: str, junk: str) -> Column:
    plain = F.regexp_replace(name, F.lit(junk), F.lit("")) if junk else name
    if kind != "ddl":
        return plain
    return F.concat(F.substring_index(plain, " (", 1), F.lit(" ("), F.lower(F.substring_index(plain, " (", -1)))


def drop_repeated(declared: Column) -> Column:
    """Drop ``dedupe`` declarations whose name an earlier declaration has; names that differ need no sorting."""
    return F.when(F.size(F.array_distinct(declared["name"])) == F.size(declared), declared).otherwise(without_repeated(declared))


def without_repeated(declared: Column) -> Column:
    keyed = F.array_sort(F.transform(declared, lambda d, i: F.struct(d["name"].alias("name"), i.alias("at"), d.alias("d"))))
    names = F.transform(keyed, lambda k: k["name"])
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), names), F.lit(1), F.size(names))
    kept = F.filter(
        F.zip_with(keyed, before, lambda k, name: F.struct(
            k["at"].alias("at"), k["d"].alias("d"),
            ((k["d"]["role"] == "dedupe") & F.coalesce(name == k["name"], F.lit(False))).alias("drop"))),
        lambda k: ~k["drop"])
    return F.transform(F.array_sort(F.transform(kept, lambda k: F.struct(k["at"].alias("at"), k["d"].alias("d")))), lambda k: k["d"])


ONE_BYTE_BREAKS = np.zeros(256, bool)
ONE_BYTE_BREAKS[[ord(b) for b in "\n" + OTHER_BREAKS if ord(b) < 128]] = True
LONGER_BREAKS = [b.encode() for b in OTHER_BREAKS if ord(b) >= 128]


def line_breaks(data: np.ndarray) -> np.ndarray:
    """Where breaks of any kind end in UTF-8 text."""
    ends = ONE_BYTE_BREAKS[data]
    for code in LONGER_BREAKS:
        last = np.flatnonzero(data == code[-1])
        last = last[last >= len(code) - 1] if len(last) else last
        for back, byte in enumerate(code[-2::-1], 1):
            last = last[data[last - back] == byte]
        ends[last] = True
    return np.flatnonzero(ends)


class Marks:
    """Lines of a batch of marked texts as flat arrays: where each file's begin, and what each line holds."""

    def __init__(self, texts: pa.Array, statement: np.ndarray):
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.empty(0, np.uint8)
        self.at = at - at[0]
        size = np.diff(self.at)
        self.breaks = line_breaks(self.data)
        before = np.searchsorted(self.breaks, self.at)
        # a break at the very end does not start another line
        closed = np.zeros(len(size), bool)
        closed[size > 0] = np.searchsorted(self.breaks, self.at[1:][size > 0] - 1) < before[1:][size > 0]
        self.count = np.where(size > 0, np.diff(before) + 1 - closed, 0)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.shift = self.first[:-1] - before[:-1]
        self.statement = statement

    def file_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1

    def line_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.breaks, places) + self.shift[self.file_of(places)]

    def per_line(self, places: np.ndarray) -> np.ndarray:
        return np.bincount(self.line_of(places), minlength=self.first[-1]).astype(np.int64)

    def of(self, char: str, statement: bool | None = None) -> np.ndarray:
        """Places of a one-byte character, in files of one kind only if so asked."""
        places = np.flatnonzero(self.data == ord(char))
        return places if statement is None else places[self.statement[self.file_of(places)] == statement]

    def arrows(self) -> np.ndarray:
        places = self.of("=", False)
        places = places[places + 1 < self.at[self.file_of(places) + 1]]
        return places[self.data[places + 1] == ord(">")]

    def called(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(line, rank, names): the called names in text order, as ranks among the sorted distinct names."""
        hits, ends = self.of(HIT), self.of(END)
        size = ends - hits - 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - hits - 1, size)
        names = pa.Array.from_buffers(pa.large_string(), len(hits), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(self.data[index])])
        coded = pc.replace_substring(names, GOOD, "").dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return self.line_of(hits), rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def held_calls(line: np.ndarray, rank: np.ndarray, names: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sorted distinct block * names + rank of the names called in each block of lines first..last."""
    low, high = np.searchsorted(line, first), np.searchsorted(line, last, "right")
    size = np.maximum(high - low, 0)
    if size.sum() > 64 * (len(line) + len(first)) + 100_000:  # many blocks within each other
        found = called_in(line, rank, first, last, size > 0)
        return np.repeat(np.arange(len(first)), [len(f) for f in found]) * names + np.array([r for f in found for r in f], np.int64)
    ends = np.cumsum(size)
    at = np.arange(size.sum()) + np.repeat(low - ends + size, size)
    return np.unique(np.repeat(np.arange(len(first)), size) * names + rank[at])


def listed(offsets: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@F.arrow_udf(LAYOUT_TYPE)
def layout_blocks(mode: pa.Array, marked: pa.Array, breaks: pa.Array, rules: pa.Array, places: pa.Array, roles: pa.Array,
                  wanted: pa.Array) -> pa.Array:
    """Blocks of every file and what they hold; a batch is counted in flat arrays, cut by their offsets."""
    def flat(lists):
        at = lists.offsets.to_numpy()
        return at - at[0], lists.flatten().to_numpy(zero_copy_only=False)

    kinds = mode.to_pylist()
    marks = Marks(marked, np.array([k == "statement" for k in kinds], bool))
    opens = marks.per_line(np.concatenate([marks.of("{", False), marks.of(OPEN)]))
    braces, shut = marks.per_line(marks.of("}", False)), marks.per_line(marks.of(GOOD))
    net, nests = opens - braces - shut, opens - braces - marks.per_line(marks.of(CLOSE))
    special = marks.per_line(np.concatenate([marks.arrows(), marks.of(";", True)])) > 0
    total = np.concatenate([[0], np.cumsum(marks.per_line(marks.of(BRANCH)))])
    # the line of a hit: breaks in the pieces of its rule before it
    (begin, rule), (_, place), (_, roles), (_, wanted) = map(flat, (rules, places, roles, wanted))
    pieces_at, pieces = flat(breaks.flatten())
    run = np.concatenate([[0], np.cumsum(pieces.astype(np.int64))])
    of_file = np.repeat(np.arange(len(kinds)), np.diff(begin))
    rules_at = breaks.offsets.to_numpy() - breaks.offsets.to_numpy()[0]
    own = pieces_at[rules_at[of_file] + rule.astype(np.int64)].astype(np.int64)
    told = run[own + place.astype(np.int64)] - run[own]
    start = np.minimum(told, np.maximum(marks.count[of_file] - 1, 0))

    net_list, open_list, special_list, told_list, role_list = (x.tolist() for x in (net, opens, special, told, roles))
    found: dict[str, list] = {k: [] for k in ("ends", "low", "high", "keep")}
    for i, kind in enumerate(kinds):
        lines, mine = slice(marks.first[i], marks.first[i + 1]), slice(begin[i], begin[i + 1])
        blocks = block_layout(kind, net_list[lines], open_list[lines], special_list[lines], told_list[mine], role_list[mine])
        for k, values in found.items():
            values += blocks[k]
    ends = np.array(found["ends"], np.int64)
    first, last = start + marks.first[of_file], ends + marks.first[of_file]
    line, rank, names = marks.called()
    asked = np.flatnonzero(wanted.astype(bool))
    held = held_calls(line, rank, max(len(names), 1), first[asked], last[asked])
    block, name = np.divmod(held, max(len(names), 1))
    counts = np.bincount(asked[block], minlength=len(start))
    calls = listed(np.concatenate([[0], np.cumsum(counts)]), names.take(pa.array(name)).cast(pa.string()))
    columns = [
        pa.array(marks.count, pa.int32()), listed(begin, pa.array(start, pa.int32())), listed(begin, pa.array(ends, pa.int32())),
        listed(begin, pa.array(found["low"], pa.int32())), listed(begin, pa.array(found["high"], pa.int32())),
        listed(begin, pa.array(found["keep"], pa.bool_())), listed(begin, pa.array(deepest(nests, first, last), pa.int32())),
        listed(begin, pa.array(total[last + 1] - total[first], pa.int32())), listed(begin, calls)]
    return pa.StructArray.from_arrays(columns, LAYOUT_TYPE.fieldNames()).cast(to_arrow_type(LAYOUT_TYPE))


def parse_tree(parser, text: str) -> dict:
    """One file's rows; a parser that fails costs its own file's symbols and nothing else."""
    nothing = dict(line_count=text.count("\n") + 1, symbols=[], imports=[], bindings=[], references=[])
    try:
        return {**nothing, "status": "ok", **parser(text)}
    except Exception:
        return {**nothing, "status": "parse_error"}


def register_table_function(spark: SparkSession, adapter: str, name: str, registry: AdapterRegistry | None = None) -> None:
    """Register ``name(text)`` for SQL: one row per symbol that the adapter's own parser finds.

    ``SELECT s.* FROM files, LATERAL name(text) AS s``.  Pattern languages have no parser
    function; their files go through ``parse_files``.
    """
    registry = registry or AdapterRegistry()
    parsers = {**TREE_PARSERS, **registry.parsers}
    engine = registry.get(adapter).engine
    if engine not in parsers:
        raise ValueError(f"{adapter} is parsed by patterns, not by a function")
    parser, fields = parsers[engine], SYMBOL_TYPE.fieldNames()

    class Symbols:
        def eval(self, text: str):
            for found in parse_tree(parser, text or "")["symbols"]:
                yield tuple(found.get(f) for f in fields)

    spark.udtf.register(name, F.udtf(Symbols, returnType=SYMBOL_TYPE))


def tree_parser(parsers: dict):
    """Column function (engine, text) -> parsed tree, with the helpers of these engines."""
    @F.arrow_udf(TREE_TYPE)
    def parse_trees(engine: pa.Array, text: pa.Array) -> pa.Array:
        rows = [parse_tree(parsers[e], t) for e, t in zip(engine.to_pylist(), text.to_pylist())]
        return pa.array(rows, to_arrow_type(TREE_TYPE))
    return parse_trees.asNondeterministic()


# Never evaluated twice or moved into another expression by the optimizer.
layout_blocks = layout_blocks.asNondeterministic()


def status(parsed: Column) -> Column:
    return F.when(F.col("unread"), F.lit("io_error")).otherwise(parsed).alias("parse_status")


def parse_regex(files: DataFrame, languages: list[Language]) -> DataFrame:
    """Files (file_path, adapter, text, unread) of these languages -> parsed rows."""
    # Text-wide passes put a mark before what is counted per line afterwards.
    def marked(language):
        called = F.regexp_replace(F.regexp_replace("text", F.lit(language.branch), F.lit(f"{BRANCH}$0")),
                                  F.lit(language.call), F.lit(f"{HIT}$1{END}"))
        if language.block_mode != "statement":
            return called
        opened = F.regexp_replace(called, F.lit(language.opener), F.lit(f"{OPEN}$0"))
        # A nest closer that does not end a block, such as COMMIT, only counts for nesting.
        nested = F.regexp_replace(opened, F.lit(language.nest_closer), F.lit(f"{CLOSE}$0"))
        return F.regexp_replace(nested, F.lit(language.closer), F.lit(f"{GOOD}$0"))

    read = files.withColumn("text", F.regexp_replace("text", f"[{HIT}{END}{BRANCH}{OPEN}{CLOSE}{GOOD}]", "\u0006"))
    # Staged as columns of their own, or every use would run the patterns again.
    read = read.withColumn("guarded", by_language([l for l in languages if l.mark], lambda l: guarded(F.col("text"), l.mark)))
    cut_up = read.select(
        "file_path", "adapter", "language", "unread",
        by_language(languages, lambda l: F.lit(l.block_mode)).alias("block_mode"),
        by_language(languages, marked).alias("marked"),
        by_language(languages, lambda l: import_strings(F.col("text"), l.imports)).alias("imports"),
        by_language(languages, lambda l: marked_by_rule(F.col("text"), l)).alias("pieces"))
    lined = cut_up.select(
        "file_path", "adapter", "language", "unread", "block_mode", "marked", "imports",
        F.transform("pieces", lambda own: F.transform(own, lambda p: count_char(p, F.lit("\n")))).alias("breaks"),
        by_language(languages, lambda l: declarations(F.col("pieces"), l)).alias("declared"))
    repeating = [l for l in languages if any(r["role"] == "dedupe" for r in l.rules)]
    if repeating:
        lined = lined.withColumn("declared", F.when(
            F.col("adapter").isin([l.adapter for l in repeating]), drop_repeated(F.col("declared"))).otherwise(F.col("declared")))
    laid = lined.select(
        "file_path", "adapter", "language", "unread", "imports", "declared",
        layout_blocks(
            "block_mode", "marked", "breaks",
            F.transform("declared", lambda d: d["rule"]),
            F.transform("declared", lambda d: d["at"]),
            F.transform("declared", lambda d: d["role"]),
            F.transform("declared", lambda d: d["calls"])).alias("layout"))

    placed = F.transform("declared", lambda d, i: F.struct(
        d["name"].alias("name"), d["role"].alias("role"), d["kind"].alias("kind"),
        F.get(F.col("layout.starts"), i).alias("start"),
        F.get(F.col("layout.ends"), i).alias("end"), F.get(F.col("layout.low"), i).alias("low"),
        F.get(F.col("layout.high"), i).alias("high"), F.get(F.col("layout.keep"), i).alias("keep"),
        F.get(F.col("layout.nesting"), i).alias("nesting"), F.get(F.col("layout.branches"), i).alias("branches"),
        F.get(F.col("layout.calls"), i).alias("calls")))
    sized = laid.select("file_path", "adapter", "language", "unread", "imports",
                        F.col("layout.line_count").alias("line_count"),
                        placed.alias("blocks"))
    split = sized.select(
        "file_path", "adapter", "language", "unread", "imports", "line_count",
        F.filter("blocks", lambda b: b["keep"]).alias("tops"),
        F.filter("blocks", lambda b: b["role"].isin("member", "loose")).alias("members"))

    def shaped(b, top, sub, parent, depth, kind):
        return F.struct(
            top.cast("int").alias("top_ord"), sub.cast("int").alias("sub_ord"),
            parent.cast("int").alias("parent_sub"), F.lit(depth).alias("depth"),
            b["name"].alias("name"), kind.alias("kind"),
            (b["start"] + 1).alias("line_start"), (b["end"] + 1).alias("line_end"),
            b["nesting"].alias("nesting_depth"), b["branches"].alias("branch_count"),
            b["calls"].alias("calls"), F.lit(None).cast("string").alias("docstring"),
            F.lit(False).alias("unclosed"))

    def top_kind(b):
        return (F.when(b["role"] == "loose", F.lit("function"))
                .when((b["kind"] == "ddl") & b["name"].rlike(r"\((?:table|view)\)$"), F.lit("class"))
                .when(b["kind"] == "ddl", F.lit("function")).otherwise(b["kind"]))

    def family(b, i):
        own = shaped(b, i, F.lit(0), F.lit(None), 0, top_kind(b))
        children = F.transform(
            F.slice("members", b["low"] + 1, b["high"] - b["low"]),
            lambda m, j: shaped(m, i, j + 1, F.lit(0), 1, F.lit("method")))
        # naming the members twice keeps Spark from computing them anew for every block
        with_children = (b["role"] == "container") & (F.size("members") > 0)
        return F.when(with_children, F.concat(F.array(own), children)).otherwise(F.array(own))

    return split.select(
        "file_path", "adapter", "language", "line_count", status(F.lit("ok")),
        F.flatten(F.transform("tops", family)).cast(T.ArrayType(SYMBOL_TYPE)).alias("symbols"),
        "imports",
        F.array().cast(T.ArrayType(BINDING_TYPE)).alias("bindings"),
        F.array().cast(T.ArrayType(REFERENCE_TYPE)).alias("references"))


def parse_tree_files(files: DataFrame, languages: list[Language], parsers: dict = TREE_PARSERS) -> DataFrame:
    parsed = files.select("file_path", "adapter", "language", "unread",
                          by_language(languages, lambda l: import_strings(F.col("text"), l.imports)).alias("by_rule"),
                          tree_parser(parsers)(by_language(languages, lambda l: F.lit(l.engine)), "text").alias("t"))
    return parsed.select(
        "file_path", "adapter", "language",
        F.when(F.col("unread"), F.lit(0)).otherwise(F.col("t.line_count")).alias("line_count"),
        status(F.col("t.status")), F.col("t.symbols").alias("symbols"),
        F.when(F.size("by_rule") > 0, F.col("by_rule")).otherwise(F.col("t.imports")).alias("imports"),
        F.col("t.bindings").alias("bindings"), F.col("t.references").alias("references"))


def parse_files(files: DataFrame, registry: AdapterRegistry | None = None,
                engines: tuple[str, ...] = ("regex", "tree")) -> DataFrame:
    """(file_path, adapter, text) -> one parsed row per file; a null text is an unreadable file.

    ``engines`` leaves a branch out when the caller knows it has no such file,
    which saves its scan.
    """
    registry = registry or AdapterRegistry()
    regex = [l for l in registry.languages() if l.engine == "regex"]
    tree = [l for l in registry.languages() if l.engine != "regex"]

    def of(languages):
        base = files.where(F.col("adapter").isin([l.adapter for l in languages]))
        return base.select("file_path", "adapter", by_language(languages, lambda l: F.lit(l.language)).alias("language"),
                           F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("unread"))

    branches = []
    if "regex" in engines:
        branches.append(parse_regex(of(regex), regex))
    if "tree" in engines:
        branches.append(parse_tree_files(of(tree), tree, {**TREE_PARSERS, **registry.parsers}))
    out = branches[0]
    for other in branches[1:]:
        out = out.unionByName(other)
    return out.select(*PARSED_COLUMNS)


def parse_listing(listing: DataFrame, read, registry: AdapterRegistry | None = None) -> DataFrame:
    """Parse listed files: the listing is split by engine first and ``read`` adds the text, so each file is opened once."""
    registry = registry or AdapterRegistry()
    kinds = {"regex": [l.adapter for l in registry.languages() if l.engine == "regex"],
             "tree": [l.adapter for l in registry.languages() if l.engine != "regex"]}
    one, two = (parse_files(read(listing.where(F.col("adapter").isin(names))), registry, (kind,)) for kind, names in kinds.items())
    return one.unionByName(two)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    # Outer explode: for the inner one Spark adds a filter on the array's size,
    # which would evaluate the whole parse a second time.
    return parsed.select("file_path", "adapter", "language", F.explode_outer("symbols").alias("s")).where(
        "s IS NOT NULL").select("file_path", "adapter", "language", "s.*")


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.posexplode_outer("imports").alias("pos", "raw")).where("raw IS NOT NULL")
