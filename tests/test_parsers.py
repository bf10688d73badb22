import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.functions import trees
from srcgraph.functions.languages import AdapterRegistry, BUILTIN_LANGUAGES, Language, rule, words
from srcgraph.functions.trees import block_layout, called_in, deepest, parse_css, parse_html, parse_python
from srcgraph.operators import parse

SOURCES = {
    "javascript": """import a, { b } from './a.js';
const lib = require("lib/x");
export * from './c';
import fs from 'node:fs';

export default async function load(id) {
  if (!id) return null;
  else if (id > 1) { go(id); }
  return fetch(id);
}
const twice = (x) => {
  return x * 2;
};
const load = (y) => y;
class Box extends Base {
  constructor(v) { this.v = v; }
  get(k) {
    for (const x of this.v) { use(x); }
  }
}
""",
    "c": """#include "util.h"
#include <stdio.h>

static int add(int a, int b) {
  if (a) { return helper(b); }
  return a;
}
struct Point {
  int norm(int k) const {
    while (k) { k--; }
    return k;
  }
};
int declared(int x);
""",
    "java": """import java.util.List;
import static com.acme.Util.*;
public final class Shop<T> {
    private List<T> all(int n) throws IOException {
        if (n > 1) { return find(n); } else if (n < 0) { try { x(); } catch (E e) { } }
        return null;
    }
    abstract void none();
}
interface Small { }
""",
    "csharp": """using System.IO;
using (var f = Open()) { }
internal sealed class A {
    public async Task<int> Run(int a) {
        foreach (var x in xs) { Use(x); }
    }
}
""",
    "go": """import "fmt"
import (
    "net/http"
    x "acme/y"
)
type Shape interface {
    Area() float64
}
func (s *Sq) Area() float64 {
    if s.a { defer done() }
    return calc(s.a)
}
func Declared(a int) int
""",
    "rust": """use std::fs;
use crate::app::Thing;
use crate::core::Lost;
mod helper;
pub struct P { x: i32 }
pub async fn go(a: i32) {
    match a { _ => call(a) }
}
fn generic<T>(a: T) { }
""",
    "dart": """import 'package:flutter/material.dart';
import 'src/a.dart';
abstract class W {
  int one(int a) => a + 1;
  Future<void> two(int b) async {
    if (b) { run(b); }
  }
}
""",
    "php": """<?php
use App\\Models\\User;
require_once('lib/db.php');
class C {
    public static function make($a) {
        if ($a) { return build($a); }
    }
}
function &loose($b) {
    foreach ($b as $c) { echo($c); }
}
""",
    "r": """source("lib/util.R")
library(dplyr)
`my fun` <- 1
area.of <- function(x) {
  if (x) { y <- stats.mean(x) } else { y <- 2 }
}
short = function(x) x * scale(x)
""",
    "sql": """CREATE TABLE [dbo].[users] (
  id INT
);
create or replace function f_total(a INT) AS
BEGIN
  IF a THEN total(a); END
  COMMIT;
END;
""",
}
# name -> (kind, line_start, line_end, nesting, branches, calls)
EXPECTED = {
    "javascript": {"load": ("function", 6, 10, 1, 2, "fetch go load"), "twice": ("function", 11, 13, 1, 0, ""),
                   "Box": ("class", 15, 20, 2, 1, ""), "get": ("method", 17, 19, 1, 1, "get use")},
    # blank lines before a C function belong to it
    "c": {"add": ("function", 3, 7, 1, 1, "add helper"), "Point": ("class", 8, 13, 2, 1, ""), "norm": ("method", 9, 12, 1, 1, "norm")},
    "java": {"Shop": ("class", 3, 9, 2, 4, ""), "all": ("method", 4, 7, 1, 4, "all find x"), "Small": ("class", 10, 10, 0, 0, "")},
    "csharp": {"A": ("class", 3, 7, 2, 1, ""), "Run": ("method", 4, 6, 1, 1, "Run Use")},
    "go": {"Shape": ("class", 6, 8, 1, 0, ""), "Area": ("function", 9, 12, 1, 2, "Area calc done")},
    "rust": {"P": ("class", 5, 5, 0, 0, ""), "go": ("function", 6, 8, 1, 1, "call go")},
    "dart": {"W": ("class", 3, 8, 2, 1, ""), "one": ("method", 4, 4, 0, 0, "one"), "two": ("method", 5, 7, 1, 1, "run two")},
    "php": {"C": ("class", 4, 8, 2, 1, ""), "make": ("method", 5, 7, 1, 1, "build make"), "loose": ("function", 9, 11, 1, 1, "loose")},
    "r": {"area.of": ("function", 4, 6, 1, 2, "stats.mean"), "short": ("function", 7, 7, 0, 0, "scale")},
    "sql": {"dbo.users (table)": ("class", 1, 3, 0, 0, ""), "f_total (function)": ("function", 4, 6, 1, 1, "f_total total")},
}
IMPORTS = {
    "javascript": ["./a.js", "lib/x", "./c"], "c": ["util.h"], "java": ["java.util.List", "com.acme.Util.*"], "csharp": ["System.IO"],
    "go": ["fmt", "net/http", "acme/y"], "rust": ["app/Thing", "helper"], "dart": ["src/a.dart"],
    "php": ["App/Models/User", "lib/db.php"], "r": ["lib/util.R"], "sql": [],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(a + ".x", a, text) for a, text in SOURCES.items()] + [("none", "java", None), ("empty", "java", ""), ("n", "python", None)]
    return parse.parse_files(spark.createDataFrame(rows, "file_path string, adapter string, text string")).persist()


def test_symbols(parsed):
    found = {a: {} for a in SOURCES}
    for r in parse.symbol_rows(parsed).collect():
        found[r.file_path.removesuffix(".x")][r.name] = (r.kind, r.line_start, r.line_end, r.nesting_depth, r.branch_count, " ".join(r.calls))
    assert found == EXPECTED


def test_imports_in_order(parsed):
    found = {r.file_path.removesuffix(".x"): list(r.imports) for r in parsed.where("file_path LIKE '%.x'").collect()}
    assert found == IMPORTS


def test_unreadable_and_empty(parsed):
    rows = {r.file_path: (r.parse_status, r.line_count, len(r.symbols)) for r in parsed.where("file_path NOT LIKE '%.x'").collect()}
    assert rows == {"none": ("io_error", 0, 0), "empty": ("ok", 0, 0), "n": ("io_error", 0, 0)}


def test_line_count_like_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\x0bb\x0cc", "a\x1cb\x1d\x1e", "a\x85b c ", "x\n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.size(parse.split_lines(parse.one_break(F.col("t")))).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {t: len(t.splitlines()) for t in texts}


def test_decode(spark):
    raw = [b"a\r\nb\rc", b"\xff\xfeok", "é".encode(), b"\xe2\x82"]
    rows = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select("b", parse.decode(F.col("b")).alias("t")).collect()
    want = {b: b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for b in raw}
    assert {bytes(r.b): r.t for r in rows} == want


def test_registered_language(spark):
    registry = AdapterRegistry().register(Language("Ruby", "Ruby", [".rb"], rules=[rule(r"^[ \t]*def\s+(\w+)")]))
    files = spark.createDataFrame([("a.rb", "ruby", "def one {\n x(1)\n}\n")], "file_path string, adapter string, text string")
    row = parse.symbol_rows(parse.parse_files(files, registry, ("regex",))).first()
    assert (row.name, row.line_end, row.language, row.calls) == ("one", 3, "Ruby", ["x"])
    assert registry.list_adapters()["ruby"] == [".rb"]
    with pytest.raises(ValueError):
        registry.get("cobol")


def slow_end(net, opens, start, mode):
    """Block end by walking the lines."""
    depth, opened = 0, False
    for i in range(start, len(net)):
        depth += net[i]
        if mode == "after":
            depth = max(depth, 0)
            if depth == 0 and i > start:
                return i
        else:
            opened = opened or opens[i] > 0
            if opened and depth <= 0:
                return i
    return len(net) - 1


@pytest.mark.parametrize("mode", ["brace", "after"])
def test_block_ends_match_a_walk(mode):
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randint(1, 30)
        opens = [rng.choice([0, 0, 1, 2]) for _ in range(n)]
        net = [o - rng.choice([0, 0, 1, 2]) for o in opens]
        starts = sorted(rng.sample(range(n), rng.randint(1, n)))
        layout = block_layout(mode, net, opens, [False] * n, starts, ["top"] * len(starts))
        assert layout["ends"] == [slow_end(net, opens, s, mode) for s in starts]


def test_python_details():
    text = '''import os, a.b as c
from ..up import x
from . import y
class K(Base):
    """Doc of K."""
    async def m(self):
        with open(p) as f:
            for l in f:
                if l: self.go(l)
                elif m: pass
def top():
    try:
        pass
    except E:
        pass
    def inner(): call()
'''
    out = parse_python(text)
    rows = {s["name"]: (s["kind"], s["line_start"], s["line_end"], s["nesting_depth"], s["branch_count"], s["calls"]) for s in out["symbols"]}
    assert rows == {"K": ("class", 4, 10, 4, 4, []), "m": ("method", 6, 10, 4, 4, ["go", "open"]), "top": ("function", 11, 16, 2, 2, ["call"])}
    assert out["imports"] == ["os", "a.b", "../up", "."] and out["line_count"] == 17
    assert [s["docstring"] for s in out["symbols"]][0] == "Doc of K."
    assert parse_python("﻿x = 1")["status"] == "syntax_error" and parse_python("a\x00b")["status"] == "syntax_error"


def test_html_details():
    out = parse_html('<html>\n<body>\n<nav id="n" class="c">\n<a>x</a>\n</nav>\n<div id="d">\n<div>\n</div>\n<section>\n</body>\n'
                     '<script src="app.js"></script><link href="https://x/y.css"><img src="i.png">\n')
    rows = [(s["name"], s["depth"], s["line_start"], s["line_end"], s["nesting_depth"], s["branch_count"]) for s in out["symbols"]]
    # an untracked </div> ends the tracked <div id>; what never closes runs to the last line
    assert rows == [("#n (nav)", 0, 3, 5, 3, 2), ("#d (div)", 0, 6, 8, 3, 1), ("<section>", 0, 9, 11, 4, 0), ("<script>", 1, 11, 11, 4, 1)]
    assert out["imports"] == ["app.js", "i.png"]


def test_css_details():
    out = parse_css("/* head\n more */\n.a,\n.b   > i {\n  color: red;\n  margin: 0;\n}\n@media print {\n  .c { x: y; }\n}\n" + ".w" * 40 + " {\n}\n")
    rows = [(s["name"], s["line_start"], s["line_end"], s["branch_count"]) for s in out["symbols"]]
    assert rows == [(".a, .b > i", 4, 7, 2), (".c", 9, 9, 1), (".w" * 40, 11, 12, 0)]


def test_css_on_one_line():
    """Minified sheets, comments and strings with braces, at-rules, nesting, what never closes."""
    out = parse_css('@import "x;y";.a{color:red}.b{c:"}";d:1;/* } ; */e:2}@font-face{src:url(x);}@media (x){.c{}@supports (y){.d{z:1;}}}'
                    "@keyframes k{from{a:b;}to{}} .e{ .f{g:h;} i:j; } } .g{a:b}\n.h{open: 1;\n")
    assert [(s["name"], s["line_start"], s["line_end"], s["branch_count"]) for s in out["symbols"]] == [
        (".a", 1, 1, 0), (".b", 1, 1, 2), (".c", 1, 1, 0), (".d", 1, 1, 1), (".e", 1, 1, 2), (".g", 1, 1, 0)]
    assert parse_css("")["symbols"] == [] and parse_css("}}{")["symbols"] == [] and parse_css("/* open {")["symbols"] == []


LONG_LINES = {
    "literal": "  const a = {" + "k: 'v', " * 130_000 + "};", "words": "  " + "public a static " * 65_000, "blanks": "  x" + " " * 1_000_000,
    "open": "  f" + "(" * 1_000_000, "code": "  " + "if(a){b(c)}else{d=e[0]};" * 43_000, "one": "  " + "x" * 1_000_000,
    "types": "  static final int " + "f<a,b> " * 140_000 + "(",
}


def test_long_lines(spark):
    """A megabyte on one line neither stalls nor ends a parse, in any pattern language; other files are not touched by it."""
    names = [l.adapter for l in BUILTIN_LANGUAGES if l.engine == "regex"]
    rows = [(f"{n}/{k}", n, line) for n in names for k, line in LONG_LINES.items()] + [("ok.js", "javascript", "function ok() {\n}\n")]
    files = spark.createDataFrame(rows, "file_path string, adapter string, text string").repartition(8, "file_path")
    start = time.time()
    found = {r.file_path: r.n for r in parse.parse_files(files).select("file_path", F.size("symbols").alias("n")).collect()}
    assert len(found) == len(rows) and found["ok.js"] == 1
    assert time.time() - start < 240  # seventy megabytes


# Starts of declarations and imports that never end, or end in nothing: each may be read a few times only.
ENDLESS = {
    "javascript": ["import a ", "export a\n", "const x = [1,\n", "const x = (a,\n", "  f(int a\n", "  static async\n", "function f(\n",
                   "  f(a) : b\n", "const x = a): b ", "class A\n", "\n"],
    "c": ["int f(int a\n", "  a b c\n", "template <\n", "template < class >\n", "class A : b,\n", "int f(a) : b\n", "  \n"],
    "java": ["  public void f(int a\n", "public\n", "  a b\n", "  void f(a) throws b,\n", "class a\n"],
    "csharp": ["  public void f(int a\n", "public\n", "  void f(a) where b\n", "  void f(a) where  "],
    "go": ["import (\n", "func (\n", "func (a\n", "func f(\n"], "rust": ["pub(\n", "pub(a) \n", "fn a\n"],
    "dart": ["int f(int a\n", "final\n", "mixin\n", "mixin a\n"], "php": ["public\n", "function\n", "function f(\n", "use a\n"],
    "r": ["a.a", "a <- \n", "source('\n"], "sql": ["CREATE OR REPLACE\n", "CREATE TABLE\n", "BEGIN\n"],
}


def seconds(spark, size):
    """Time for one file of ``size`` characters of every endless text."""
    rows = [(f"{n}/{i}", n, unit * (size // len(unit))) for n, units in ENDLESS.items() for i, unit in enumerate(units)]
    files = spark.createDataFrame(rows, "file_path string, adapter string, text string").repartition(16, "file_path")
    start = time.time()
    found = parse.parse_files(files, engines=("regex",)).agg(F.count(F.lit(1)), F.sum(F.size("symbols") + F.size("imports"))).first()
    assert found[0] == len(rows)
    return time.time() - start


def test_endless_declarations(spark):
    """Time grows with the text, not with its square: for forty texts of 400 kB, some seconds each."""
    seconds(spark, 1000)
    small, large = seconds(spark, 100_000), seconds(spark, 400_000)
    assert large < 5 * small + 10, (small, large)


def test_many_tokens_and_modifiers(spark):
    """No bound on type tokens or modifiers."""
    files = spark.createDataFrame([
        ("a.c", "c", "static " * 30 + "int f(int a) {\n}\n"), ("b.java", "java", "class A {\n  " + "final " * 40 + "int g() {\n  }\n}\n"),
        ("c.java", "java", "public " * 40 + "class B {\n}\n"), ("d.dart", "dart", "mixin mixin M {\n}\n")],
        "file_path string, adapter string, text string")
    found = {r.file_path: [s.name for s in r.symbols] for r in parse.parse_files(files).collect()}
    assert found == {"a.c": ["f"], "b.java": ["A", "g"], "c.java": ["B"], "d.dart": ["M"]}


def test_what_blocks_hold():
    """Depths and called names of blocks against plain loops."""
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 30)
        net = [rng.randint(-2, 2) for _ in range(n)]
        spans = [(s, rng.randint(s, n - 1)) for s in (rng.randrange(n) for _ in range(rng.randint(0, 8)))]
        calls = sorted((rng.randrange(n), rng.choice("abcd")) for _ in range(rng.randint(0, 20)))
        starts, ends = [s for s, _ in spans], [e for _, e in spans]

        def plain(s, e):
            now = most = 0
            for value in net[s:e + 1]:
                now = max(now + value, 0)
                most = max(most, now)
            return most
        assert deepest(net, starts, ends).tolist() == [plain(s, e) for s, e in spans]
        wanted = [rng.random() < .7 for _ in spans]
        found = called_in([c[0] for c in calls], [c[1] for c in calls], starts, ends, wanted)
        assert found == [sorted({name for line, name in calls if s <= line <= e}) if w else [] for (s, e), w in zip(spans, wanted)]


def test_sources_shuffle_numbers_only(spark, tmp_path):
    """Orders are put together once for all languages, before there is any text."""
    from srcgraph.plans import derived
    spark.createDataFrame([(1, 7, 3, 2, 5.0), (1, 8, 4, 1, 6.0), (2, 9, 5, 1, 7.0)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    files = derived.all_sources(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    found = {r.file_path: r.text for r in files.collect()}
    assert len(found) == 2 * len(derived.TEMPLATES)
    assert found["src/o2.js"] == "import { a } from './m9';\nfunction fn_9_5(a) {\nif (a) {\nhelper_1(a);\nhelper_2(a);\n}\n}\n"


def test_marked_lines_of_a_batch():
    import pyarrow as pa
    texts = ["", "a{\n\x03b}\n", "\x01f\x02(=>", ">;", "\n\x04BEGIN\n\x07\x05END;\n\n"]
    marks = parse.Marks(pa.array(["x", *texts]).slice(1), np.array([False, False, False, False, True]))
    assert marks.count.tolist() == [0, 2, 1, 1, 4]
    assert marks.per_line(marks.of("{", False)).tolist() == [1, 0, 0, 0, 0, 0, 0, 0]
    assert marks.per_line(marks.arrows()).tolist() == [0, 0, 1, 0, 0, 0, 0, 0]
    assert marks.per_line(marks.of(";", True)).tolist() == [0, 0, 0, 0, 0, 0, 1, 0]
    line, rank, names = marks.called()
    assert (line.tolist(), rank.tolist(), names.to_pylist()) == ([2], [0], ["f"])


def test_held_calls_both_ways():
    rng = np.random.default_rng(1)
    line, rank = np.sort(rng.integers(0, 5000, 3000)), rng.integers(0, 20, 3000)
    first = rng.integers(0, 4000, 300)
    for last in (first + 3, np.full(300, 5000)):  # few lines a block, and blocks that never close
        held = parse.held_calls(line, rank, 20, first, last)
        want = [b * 20 + r for b in range(300) for r in sorted(set(rank[(line >= first[b]) & (line <= last[b])].tolist()))]
        assert held.tolist() == want


def test_words_look_at_first_letters(spark):
    """The words found are those of the plain alternation, but most places are left after one letter."""
    texts = ["if iffy else if ELSE  If x.if(for) \u0130f \u017fwitch caſe switch9 _for", "for for\n\tfor", "", "fo r elseif else\tif"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for flags in ("(?U)", "(?iU)"):
        pattern = words("if else+if for switch case", flags)
        assert pattern.startswith(flags + "(?=[")
        plain = flags + r"\b(?:if|else\s+if|for|switch|case)\b"
        for r in frame.select(F.regexp_replace("t", F.lit(pattern), F.lit("<$0>")).alias("a"), F.regexp_replace("t", F.lit(plain), F.lit("<$0>")).alias("b")).collect():
            assert r.a == r.b


@pytest.mark.parametrize("adapter", ["javascript", "sql", "r"])
def test_names_without_parenthesis_are_not_compared(spark, adapter):
    language = AdapterRegistry().get(adapter)
    assert language.call.index(r"\s*+\(") < language.call.index("(?!")
    frame = spark.createDataFrame([("if (a) foo (b) a.b(c) new x; Iffy(1) ..q(2) SELECT(3) list.of  (4) plain",)], "t string")
    excluded = "|".join(language.call_exclude.split())
    chars = language.name_chars
    start = rf"(?<![{chars}])\.*+" if "." in chars else r"\b"
    plain = rf"(?U){start}(?!(?{language.call_flags}:{excluded})(?![{chars}]))([{chars}]++)(?=\s*+\()"
    row = frame.select(F.regexp_extract_all("t", F.lit(language.call), 1).alias("a"), F.regexp_extract_all("t", F.lit(plain), 1).alias("b")).first()
    assert row.a == row.b and row.a


def test_python_nodes_are_visited_once(monkeypatch):
    """A class and its methods are measured in one sweep over flat lists."""
    seen = []
    walk = trees.tree_nodes
    monkeypatch.setattr(trees, "tree_nodes", lambda tree: seen.append(1) or walk(tree))
    monkeypatch.setattr(trees.ast, "iter_child_nodes", None)
    text = ("import os\nclass A(base()):\n    @deco(f())\n    def m(self, x=g()):\n        for i in os.walk(x):\n            if i:\n                h(k(i))\n"
            "        def inner():\n            with i:\n                os.close()\n    x = z()\n    if x:\n        def late(self): w()\n"
            "async def top():\n    try:\n        a.b.c()\n    except E:\n        match q:\n            case 1: r()\n")
    out = trees.parse_python(text)
    assert seen == [1] and out["status"] == "ok"
    assert [(s["name"], s["kind"], s["nesting_depth"], s["branch_count"], s["calls"], s["top_ord"], s["sub_ord"]) for s in out["symbols"]] == [
        ("A", "class", 2, 4, [], 0, 0), ("m", "method", 2, 3, ["close", "deco", "f", "g", "h", "k", "walk"], 0, 1),
        ("top", "function", 3, 3, ["c", "r"], 1, 0)]
    assert out["imports"] == ["os"] and [(r["attr"], r["line"]) for r in out["references"] if r["attr"]] == [("walk", 5), ("close", 10)]


def test_line_breaks_are_found_in_bytes():
    """Every kind of break counts where it ends, in no text but its own, and at the very end as well."""
    import numpy as np
    import pyarrow as pa
    texts = ["a\u2028b\x0bc\n", "\u0085", "", "x\u2029", "\u2027\u202a\u00c2", "\x1c\x1d\x1e\x0cz"]
    marks = parse.Marks(pa.array(texts, pa.large_string()), np.zeros(len(texts), bool))
    assert marks.count.tolist() == [3, 1, 0, 1, 1, 5]
    joined = "".join(texts).encode()
    ends = [i for i in range(len(joined)) if any(joined[:i + 1].endswith(b.encode()) for b in "\n" + parse.OTHER_BREAKS)]
    assert marks.breaks.tolist() == ends


def test_texts_of_other_languages_are_not_made(spark, tmp_path):
    """Who asks for files of one language makes no text of the others; the texts stay as they were."""
    from srcgraph.plans import derived
    spark.sql("""SELECT * FROM VALUES (1, 7, 8, 2, 4.0), (1, NULL, 9, 1, 3.0), (2, 5, 6, 1, NULL), (3, 4, 4, -1, -5.0)
                 AS t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = derived.all_sources(spark, str(tmp_path))
    plan = files.where("adapter = 'sql'")._jdf.queryExecution().optimizedPlan().toString()
    # the text is made above the filter, which the plan prints further down
    assert plan.index("CREATE FUNCTION") < plan.index("Filter (adapter") and "CREATE FUNCTION" not in plan[plan.index("Filter (adapter"):]
    texts = {row.file_path: row.text for row in files.collect()}
    assert len(texts) == 3 * len(derived.TEMPLATES)
    assert texts["src/o1.sql"] == ("-- part 7\nBEGIN IF a\nCALL helper_1(a);\nEND\nEND;\n"
                                   "CREATE FUNCTION fn_7_8 AS BEGIN\nBEGIN IF a\nBEGIN IF a\nCALL helper_1(a);\nCALL helper_2(a);\nEND\nEND\nEND;\n")
    assert texts["src/o2.py"] is None and texts["src/o2.css"] is None
    assert texts["src/o3.py"] == ("from acme.m4 import a\ndef fn_4_4(a):\n    if a:\nif a:\nif a:\n"
                                  "helper_1(a)\nhelper_0(a)\nhelper_-1(a)\n")


def test_names_that_differ_are_not_sorted(spark):
    """Only a text that repeats a name pays for finding out which of its declarations is dropped."""
    text = "function f(a) {\n}\nconst g = (a) => 1\nconst f = (a) => 2\nclass f {\n}\n"
    frame = spark.createDataFrame([("a.js", "javascript", text), ("b.js", "javascript", text.replace("const f", "const h"))], "file_path string, adapter string, text string")
    found = parse.symbol_rows(parse.parse_files(frame, engines=("regex",)))
    names = {p: sorted(r.name for r in found.where(F.col("file_path") == p).collect()) for p in ("a.js", "b.js")}
    assert names == {"a.js": ["f", "f", "g"], "b.js": ["f", "f", "g", "h"]}


def test_python_tables_come_from_one_walk():
    """Symbols, imports, bindings and references are told in the same pass over the nodes."""
    tree = trees.ast.parse("import os as o\nfrom .a import b\nclass C(b.D):\n    def m(self):\n        with o:\n            return o.path(b, 1)\n")
    found = trees.tree_nodes(tree)
    assert [(s["name"], s["nesting_depth"], s["branch_count"], s["calls"]) for s in found["symbols"]] == [("C", 1, 1, []), ("m", 1, 1, ["path"])]
    assert found["imports"] == ["os", "./a"] and [b["local"] for b in found["bindings"]] == ["o", "b"]
    assert [(r["base"], r["attr"], r["line"]) for r in found["references"]] == [
        ("b", "D", 3), ("b", None, 3), ("o", None, 5), ("o", "path", 6), ("b", None, 6), ("o", None, 6)]
