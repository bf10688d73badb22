import os.path
import random

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import paths
from srcgraph.functions.fixed import INDEX_NAMES, TRY_EXTENSIONS
from srcgraph.operators import model, resolve

CASES = [
    ("./b", "src/a.py", ["src/a.py", "src/b.py"], "src/b.py"),
    ("../lib/helper", "src/a.py", ["src/a.py", "lib/helper.py"], "lib/helper.py"),
    ("foo.bar", "entry.py", ["foo/bar.py", "foo/__init__.py"], "foo/bar.py"),
    ("com.foo.Bar", "App.java", ["com/foo.java"], "com/foo.java"),
    ("shared", "other.py", ["deep/nested/shared.py"], "deep/nested/shared.py"),
    ("numpy", "src/a.py", ["src/a.py"], None),
    ("react", "src/a.js", ["src/a.py"], None),
    ("assets/app.js", "index.html", ["assets/app.js"], "assets/app.js"),
    ("include/header.h", "src/main.c", ["include/header.h", "src/main.c"], "include/header.h"),
    ("utils", "x.py", ["utils.py", "deep/nested/utils.py"], "utils.py"),
    ("a", "a.py", ["a.py"], "a.py"),
    ("", "a.py", ["a.py"], None),
    ("   ", "a.py", ["a.py"], None),
    # no fallback after an explicit path, and repo-relative paths are not page-relative
    ("js/app.js", "web/index.html", ["web/js/app.js"], None),
    ("./app", "web/index.html", ["app.js"], None),
    ("pkg", "x.py", ["pkg/__init__.py", "lib/pkg.py"], "lib/pkg.py"),
    ("./pkg", "x.py", ["pkg/__init__.py"], "pkg/__init__.py"),
    ("x.c", "m.h", ["src/x.c", "x/c.py"], "src/x.c"),
    ("a/b", "m.py", ["a/b.js", "a/b.py", "a/b/index.js"], "a/b.py"),
    ("..", "a/b.py", ["a.py"], None),
    ("com.foo.*", "A.java", ["com/foo.java"], "com/foo.java"),
]


def resolved(spark, raw, current, files):
    imports = spark.createDataFrame([(current, 0, raw)], "file_path string, pos int, raw string")
    listed = spark.createDataFrame([(f,) for f in files], "file_path string").withColumn(
        "file_ord", model.file_order(F.lit("x"), F.col("file_path")))
    rows = resolve.resolve_imports(imports, listed).collect()
    return rows[0].target if rows else None


@pytest.mark.parametrize("raw,current,files,expected", CASES)
def test_resolve(spark, raw, current, files, expected):
    assert resolved(spark, raw, current, files) == expected


def plain_resolve(raw, current, files):
    """The rules written as dictionary lookups."""
    def attempt(base):
        options = [base] + [f"{base}.{e}" for e in TRY_EXTENSIONS] + [f"{base}/{i}" for i in INDEX_NAMES]
        return next((o for o in options if base and o in files), None)

    def named(name):
        hits = [f for f in files if os.path.basename(f) == name or os.path.splitext(os.path.basename(f))[0] == name]
        return min(hits, key=lambda f: (f.count("/"), os.path.dirname(f).split("/"), f), default=None)
    if raw.startswith(("./", "../")):
        return attempt(os.path.normpath(os.path.join(os.path.dirname(current), raw)))
    if "/" in raw:
        return attempt(raw)
    is_file = any(raw.lower().endswith("." + e) for e in TRY_EXTENSIONS)
    if "." in raw and not is_file:
        parts = [p for p in raw.split(".") if p and p != "*"]
        hit = attempt("/".join(parts)) or attempt("/".join(parts[:-1]))
        if hit:
            return hit
    return raw if is_file and raw in files else named(raw)


def test_random_trees(spark):
    rng = random.Random(7)
    names, exts = ["a", "b", "core", "index", "__init__", "mod"], ["py", "js", "rs", "c", "R"]
    files = sorted({"/".join(rng.choices(names[:3], k=rng.randint(0, 3)) + [f"{rng.choice(names)}.{rng.choice(exts)}"]) for _ in range(60)})
    raws = sorted({rng.choice(["./", "../", "", "a/", "../../"]) + rng.choice(["a", "b.core", "core", "a/b", "mod.rs", "index.js", "x.R", "a.b.core.Item"]) for _ in range(80)})
    rows = [(rng.choice(files), i, raw) for i, raw in enumerate(raws * 3)]
    imports = spark.createDataFrame(rows, "file_path string, pos int, raw string")
    listed = spark.createDataFrame([(f,) for f in files], "file_path string").withColumn("file_ord", model.file_order(F.lit("x"), F.col("file_path")))
    found = {r.pos: r.target for r in resolve.resolve_imports(imports, listed).collect()}
    assert found == {pos: t for path, pos, raw in rows if (t := plain_resolve(raw, path, set(files)))}
    edges = resolve.dependency_edges(resolve.resolve_imports(imports, listed)).collect()
    assert {(e.src, e.dst) for e in edges} == {(path, found[pos]) for path, pos, _ in rows if pos in found and found[pos] != path}


def test_normalise(spark):
    texts = ["a/./b", "a/../b", "../../x", "a//b", "./", "a/b/../../..", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "p string").select("p", paths.normalise(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == {t: os.path.normpath(t) for t in texts}


def test_stem_and_suffix(spark):
    texts = ["a.py", "a.tar.gz", ".bashrc", "..x", "a.", "noext", "X.PY"]
    rows = spark.createDataFrame([(t,) for t in texts], "p string").select("p", paths.stem(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == {t: os.path.splitext(t)[0] for t in texts}


def test_edge_usage_counts_naming_imports(spark):
    edges = spark.createDataFrame([("m.py", "lib/util.py"), ("m.py", "lib/other.py")], "src string, dst string")
    imports = spark.createDataFrame([("m.py", ["lib.util", "util", "numpy"])], "file_path string, imports array<string>")
    assert {r.dst: r.usage_count for r in resolve.edge_usage(edges, imports).collect()} == {"lib/util.py": 2, "lib/other.py": 1}


def test_imports_are_evaluated_once(spark):
    """Imports may come from a parse or joins; resolving them must not run these twice."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def spelled(raw):
        runs.add(1)
        return raw

    imports = spark.createDataFrame([("src/a.py", i, "./b") for i in range(40)], "file_path string, pos int, raw string")
    files = spark.createDataFrame([("src/a.py", 1), ("src/b.py", 2)], "file_path string, file_ord int")
    found = resolve.resolve_imports(imports.withColumn("raw", spelled.asNondeterministic()("raw")), files).collect()
    assert sorted((r.pos, r.target) for r in found) == [(i, "src/b.py") for i in range(40)]
    assert runs.value == 40


def test_lookups_of_null_paths_and_odd_texts(spark):
    rows = [(None, 0, "./b"), (None, 1, "pkg.mod"), ("a.py", 2, None), ("a.py", 3, ".."), ("a.py", 4, "."), ("x/y/a.py", 5, "../\\b"), ("a.py", 6, "..x.")]
    found = resolve.import_lookups(spark.createDataFrame(rows, "file_path string, pos int, raw string")).collect()
    assert sorted((r.pos, r["rank"], r.kind, r.key) for r in found) == [
        (1, 0, "path", "pkg/mod"), (1, 1, "path", "pkg"), (1, 2, "name", "pkg.mod"), (3, 2, "name", ".."), (4, 2, "name", "."),
        (5, 0, "path", "x//b"), (6, 0, "path", "x"), (6, 2, "name", "..x.")]


def test_folders_of_paths(spark):
    cases = {"a/b/c.py": "a/b", "c.py": "", "": "", "a/": "a", "a//": "a/", "/a": "", "é/ü/x": "é/ü", "a/b\n": "a", "/": ""}
    frame = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.dirname(F.col("p")).alias("d"))
    assert {r.p: r.d for r in frame.collect()} == cases
