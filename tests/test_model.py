import pytest
from pyspark.sql import functions as F

from srcgraph.functions.narrate import narration
from srcgraph.functions.purpose import keyword_purpose, name_purpose
from srcgraph.functions.score import heat_label, heat_rank
from srcgraph.operators import compare, model, views

SYMBOLS = ("file_path string, top_ord int, sub_ord int, depth int, name string, kind string, line_start int, line_end int, "
           "nesting_depth int, branch_count int, n_calls int, docstring string")


def symbol(path, top, sub, depth, name, kind, lines, nest, branches, calls, doc=None):
    return (path, top, sub, depth, name, kind, 1, lines, nest, branches, calls, doc)


APP = [symbol("py/app.py", 0, 0, 0, "main", "function", 12, 3, 5, 5), symbol("py/app.py", 1, 0, 0, "App", "class", 14, 1, 1, 0),
       symbol("py/app.py", 1, 1, 1, "__init__", "method", 3, 0, 0, 1), symbol("py/app.py", 1, 2, 1, "run", "method", 2, 0, 0, 1),
       symbol("py/app.py", 1, 3, 1, "greet", "method", 4, 1, 1, 0)]


def describe(spark, symbols, files):
    scored = model.score_symbols(spark.createDataFrame(symbols, SYMBOLS))
    listed = spark.createDataFrame([(p, "python", "Python", n) for p, n in files], "file_path string, adapter string, language string, line_count int")
    return {r.file_path: r for r in model.describe_files(listed, model.symbol_summary(scored)).collect()}


def test_scores(spark):
    rows = model.score_symbols(spark.createDataFrame(APP, SYMBOLS)).collect()
    assert {r.name: round(r.complexity, 6) for r in rows} == {"main": 32.4, "App": 9.8, "__init__": 1.6, "run": 1.4, "greet": 7.8}
    app = describe(spark, APP, [("py/app.py", 40)])["py/app.py"]
    assert round(app.complexity, 6) == 19.32 and app.symbol_count == 5 and app.purpose.endswith("Entry Point")


def test_boosts_and_caps(spark):
    rows = [symbol(f"s{n}.x", i, 0, 0, f"q{i}", "function", 50, 2, 3, 4) for n in (5, 6, 10, 11) for i in range(n)]
    rows += [symbol("max.x", i, 0, 0, f"q{i}", "function", 500, 50, 50, 50) for i in range(12)]
    rows += [symbol("deep.x", 0, 0, 0, "q", "html_node", 10, 0, 0, 0), symbol("deep.x", 0, 1, 2, "r", "html_node", 100, 6, 15, 20)]
    found = describe(spark, rows, [(p, 10) for p in ("s5.x", "s6.x", "s10.x", "s11.x", "max.x", "deep.x", "none.x")] + [("big.x", 900)])
    base = 0.2 * 50 + 5 * 2 + 2 * 3 + 4
    got = {p: round(r.complexity, 6) for p, r in found.items()}
    assert got == {"s5.x": base, "s6.x": round(base * 1.05, 6), "s10.x": round(base * 1.05, 6), "s11.x": round(base * 1.15, 6),
                   "max.x": 100.0, "deep.x": 2.0, "none.x": 3.0, "big.x": 30.0}


def test_heat(spark):
    rows = spark.createDataFrame([(v,) for v in (80.0, 79.9, 60.0, 40.0, 39.99, 0.0)], "v double").select(
        "v", heat_label(F.col("v")).alias("h"), heat_rank(heat_label(F.col("v"))).alias("r")).collect()
    assert [(r.h, r.r) for r in rows] == [("Critical", 4), ("High", 3), ("High", 3), ("Medium", 2), ("Low", 1), ("Low", 1)]


def test_name_and_keyword_rows(spark):
    cases = {"tests/a": "Test / Fixture", "src/latest": "Test / Fixture", "x/mapper": "Entry Point", "x/format": "Data Model",
             "x/settings": "Configuration", "x/zzz": None, "web/widget": "Layout / View"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select(
        "c", name_purpose(F.substring_index("c", "/", 1), F.substring_index("c", "/", -1)).alias("p")).collect()
    assert {r.c: r.p and r.p.split(" ", 1)[1] for r in rows} == cases
    row = spark.range(1).select(keyword_purpose(F.lit("Please VALIDATE")).alias("a"), keyword_purpose(F.lit("zzz")).alias("b")).first()
    assert row.a.endswith("Validation") and row.b is None


def test_purpose_layers(spark):
    rows = [
        # own docstring misses, a method's hits; without an own docstring the methods are not read
        symbol("x/q1.py", 0, 0, 0, "zz", "class", 1, 0, 0, 0, "zzz"), symbol("x/q1.py", 0, 1, 1, "m", "method", 1, 0, 0, 0, "verify it"),
        symbol("x/q2.py", 0, 0, 0, "zz", "class", 1, 0, 0, 0), symbol("x/q2.py", 0, 1, 1, "m", "method", 1, 0, 0, 0, "verify it"),
        symbol("x/q3.py", 0, 0, 0, "zz", "function", 1, 0, 0, 0, "zzz"), symbol("x/q3.py", 1, 0, 0, "tokenize_it", "function", 1, 0, 0, 0),
        *[symbol("x/q4.py", i, 0, 0, f"z{i}", "function", 1, 0, 0, 0) for i in range(9)],
        *[symbol("x/q5.py", i, 0, 0, f"z{i}", "css_rule" if i else "function", 1, 0, 0, 0) for i in range(4)],
    ]
    found = describe(spark, rows, [(f"x/q{i}.py", 50) for i in range(1, 6)] + [("x/q6.py", 0), ("x/q7.py", 9), ("x/q8.py", 10)])
    labels = {p: r.purpose.split(" ", 1)[1].replace("️ ", "") for p, r in found.items()}
    assert labels == {"x/q1.py": "Validation", "x/q2.py": "Data Model", "x/q3.py": "Parsing", "x/q4.py": "Utility", "x/q5.py": "Styling",
                      "x/q6.py": "Empty", "x/q7.py": "Stub / Init", "x/q8.py": "Source"}
    assert found["x/q4.py"].first_names == ["z0", "z1", "z2"] and "9 primary objects (including `z0`, `z1`, `z2`, and 6 others)" in found["x/q4.py"].narration


def test_narration_wording(spark):
    def text(n, names, heat):
        return spark.range(1).select(narration(F.lit("X Kind"), F.lit(n), F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.lit(heat)).alias("t")).first().t
    assert text(0, [], "Medium") == ("This file functions primarily as a x kind module. It exposes no distinct classes or functions, "
                                     "suggesting it acts as a configuration file, a script, or a re-export stub.")
    assert "single core component (`a`)" in text(1, ["a"], "Low") and "refactoring candidate." in text(2, ["a", "b"], "Critical")


def test_module_nesting_stops_at_gaps(spark):
    paths = ["a/x.py", "a/b/x.py", "a/b/c/d/x.py", "z/y/x.py", "root.py"]
    files = spark.createDataFrame([(p, "python", 10, 1, float(i)) for i, p in enumerate(paths)], "file_path string, adapter string, line_count int, symbol_count int, complexity double")
    rows = {r.module: (r.parent_module, r.total_files, r.total_lines, r.avg_complexity) for r in model.module_rollup(files).collect()}
    assert rows == {"a": (None, 2, 20, 0.5), "a/b": ("a", 1, 10, 1.0), "a/b/c/d": (None, 1, 10, 2.0), "z/y": (None, 1, 10, 3.0)}


def test_metadata_first_of_equals_wins(spark):
    files = spark.createDataFrame([("b/x.py", "python", "Python", 5, 1, 9.0), ("a.py", "python", "Python", 5, 2, 9.0), ("c.x", "c", "Unknown", 1, 0, 3.0)],
                                  "file_path string, adapter string, language string, line_count int, symbol_count int, complexity double")
    row = model.project_metadata(files).first()
    assert (row.total_files, row.total_lines, row.max_complexity_file, dict(row.language_file_counts)) == (3, 11, "a.py", {"Python": 2})


def test_hotspot_ranks(spark):
    top = model.hotspots(model.score_symbols(spark.createDataFrame(APP, SYMBOLS)), 3).orderBy("rank").collect()
    assert [(r["rank"], r.name) for r in top] == [(1, "main"), (2, "App"), (3, "greet")]


def test_diff(spark):
    schema = "file_path string, complexity double"
    old = spark.createDataFrame([("same", 5.0), ("near", 5.0), ("worse", 5.0), ("better", 9.0), ("gone", 4.0)], schema)
    new = spark.createDataFrame([("same", 5.0), ("near", 5.5), ("worse", 7.0), ("better", 3.0), ("new", 1.0)], schema)
    changes = compare.diff_files(old, new)
    assert [(r.file_path, r.status, r.complexity_delta) for r in compare.diff_order(changes).collect()] == [
        ("better", "MODIFIED", -6.0), ("gone", "DELETED", -4.0), ("worse", "MODIFIED", 2.0), ("new", "ADDED", 1.0)]
    assert tuple(compare.diff_summary(changes).first()) == (1, 1, 1, 1)


def test_changed_paths(spark):
    schema = "path string, mtime long, size long"
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], schema)
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], schema)
    assert {r.path: r.change for r in compare.changed_paths(before, after).collect()} == {"b": "changed", "c": "removed", "d": "added"}


def test_line_diff_and_marks(spark):
    def one(text):
        return spark.createDataFrame([(1, text)], "k int, text string")
    rows = compare.line_diff(one("a\nb\nc"), one("a\nx"), ["k"]).orderBy("pos", F.desc("type")).collect()
    assert [(r.type, r.text) for r in rows] == [("ctx", "a"), ("remove", "b"), ("add", "x"), ("remove", "c")]
    marks = compare.line_marks(one("a\nb"), one("a\nx\ny"), ["k"]).orderBy("pos").collect()
    assert [(r.pos, r.mark) for r in marks] == [(1, "modified"), (2, "added")]


def test_line_heat(spark):
    rows = spark.createDataFrame([("f", 1, 4, "Low"), ("f", 2, 3, "High")], "file_path string, line_start int, line_end int, heat string")
    assert {r.line: r.heat for r in views.line_heat(rows).collect()} == {1: "Low", 2: "High", 3: "High", 4: "Low"}


def slow_fuzzy(text, name, query):
    at = run = score = 0
    for char in text:
        if at < len(query) and char == query[at]:
            run, at = run + 1, at + 1
            score += run
        else:
            run = 0
    return -1 if at < len(query) else score + (100 if name.startswith(query) else 0)


def test_search(spark):
    paths = ["src/app.py", "app/main.py", "a/p/p.txt", "zzz", "deep/apple.js"] + [f"app{i}/x" for i in range(20)]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    found = [(r.file_path, r.score) for r in views.search(files, " APP ").collect()]
    expected = sorted(((p, slow_fuzzy(p, p.split("/")[-1], "app")) for p in paths), key=lambda x: (-x[1], x[0]))
    assert found == [e for e in expected if e[1] >= 0][:12]
    assert views.search(files, "  ").count() == 0


@pytest.mark.parametrize("count", [3])
def test_graph_payload(spark, count):
    files = spark.createDataFrame([("a/b/x.py", 1.0), ("a/y.py", 50.0), ("z.py", 0.0)], "file_path string, complexity double")
    nodes = {r.id: (r.type, r.parent, r.val, r.heat) for r in views.graph_nodes(files, "p").collect()}
    assert nodes == {"a/b/x.py": ("file", "a/b", 2.0, "Low"), "a/y.py": ("file", "a", 51.0, "Medium"), "z.py": ("file", "root", 1.0, "Low"),
                     "a": ("folder", "root", 15.0, "Low"), "a/b": ("folder", "a", 15.0, "Low"), "root": ("folder", None, 20.0, "Optimal")}
    links = {(r.source, r.target) for r in views.structural_links(files).collect()}
    assert links == {("root", "a"), ("a", "a/b"), ("a/b", "a/b/x.py"), ("a", "a/y.py"), ("root", "z.py")}
