import os
import subprocess

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import paths
from srcgraph.functions.languages import AdapterRegistry
from srcgraph.functions.trees import symbol
from srcgraph.operators.parse import register_table_function
from srcgraph.plans import payloads
from srcgraph.plans.engine import Engine
from srcgraph.sources.cache import ParseCache
from srcgraph.sources.git import list_revision
from srcgraph.sources.scan import IGNORE_FILE, detect_languages, ignored, list_files, load_ignore_patterns, scan_sources, snapshot, with_text
from srcgraph.streaming.watch import Watcher, state_changes

TREE = {
    "app.py": "import os, sys\nimport shared\nfrom pkg import core\n\ndef main():\n    if sys.argv:\n        shared.run()\n",
    "shared.py": "def run():\n    return 1\n",
    "pkg/__init__.py": "",
    "pkg/core.py": "from . import helper\nimport shared\nimport sqlalchemy\nimport react, requests\n",
    "pkg/helper.py": "from .core import x\nimport shared\n",
    "pkg/lost.py": "VALUE = 1\n",
    "web/index.html": "<html><body><main id='m'></main><script src='web/app.js'></script></body></html>\n",
    "web/app.js": "export function go() {\n  return 1;\n}\n",
    "web/style.css": ".a {\n  color: red;\n}\n",
    "node_modules/x/y.js": "function no() {\n}\n",
    ".hidden/z.py": "def no(): pass\n",
    "build/out.py": "def no(): pass\n",
    "vendor/lib.go": "func no() {\n}\n",
    "vendor/lib.py": "def kept(): pass\n",
    "my pkg+x/a b.py": "def spaced(): pass\n",
    "notes.txt": "text\n",
    "X.PY": "def upper(): pass\n",
}


def write(root, files):
    for path, text in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    return write(tmp_path_factory.mktemp("tree"), TREE)


@pytest.fixture(scope="module")
def model(spark, tree):
    return Engine(spark).analyze(tree, top_n=5)


def test_listing_keeps_underscore_names(spark, tree):
    listed = {r.file_path: r.size for r in list_files(spark, tree, ["node_modules"]).collect()}
    assert listed == {p: len(t) for p, t in TREE.items() if not p.startswith((".hidden", "node_modules"))}


def test_skipped_folders_differ_by_language(spark, tree):
    found = {r.file_path: r.adapter for r in scan_sources(spark, tree, content=False).collect()}
    assert found == {
        "app.py": "python", "shared.py": "python", "pkg/__init__.py": "python", "pkg/core.py": "python", "pkg/helper.py": "python",
        "pkg/lost.py": "python", "vendor/lib.py": "python", "my pkg+x/a b.py": "python", "X.PY": "python", "web/index.html": "html",
        "web/app.js": "javascript", "web/style.css": "css"}
    assert scan_sources(spark, tree, lang="CSS", content=False).count() == 1
    assert scan_sources(spark, tree, lang="cobol", content=False).count() == 0


def test_detect_and_ignore(spark, tmp_path):
    root = write(tmp_path, {"a.py": "", "gen/b.js": "", "c.go": "", "vendor/d.rs": "", IGNORE_FILE: "# comment\n\ngen/\n*.go\n"})
    assert load_ignore_patterns(root) == ["gen/", "*.go"]
    assert detect_languages(spark, root) == ["python"]
    assert load_ignore_patterns(str(tmp_path / "gen")) == []
    kept = scan_sources(spark, root, ignore=["a.*"], content=False).collect()
    assert sorted(r.file_path for r in kept) == ["c.go", "gen/b.js"]
    rows = spark.createDataFrame([("x/test_a.py",), ("x/y/a.md",), ("q.md",), ("ab.c",)], "p string")
    assert [r.i for r in rows.select(ignored(F.col("p"), ["test_*", "x/y/*", "[!a]*.md", "a?.c"]).alias("i")).collect()] == [True, True, True, True]
    assert not rows.select(ignored(F.col("p"), ["y.md", "x?z"]).alias("i")).where("i").count()


def test_globs_agree_with_fnmatch(spark):
    import fnmatch
    names = ["a.py", "ab.py", "a/b.py", "a-b.c", "[x].c", "x.c", "a+b.c", "^.c", "aa"]
    globs = ["*.py", "a?.py", "a/*", "[ab].py", "[!x].c", "[[]x].c", "a+b.c", "*", "a-[a-c].c", "[^].c"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for glob in globs:
        hits = {r.n for r in rows.where(F.col("n").rlike(paths.glob_to_regex(glob))).collect()}
        assert hits == {n for n in names if fnmatch.fnmatchcase(n, glob)}, glob


def test_engine_tables(model):
    edges = {(r.src, r.dst) for r in model.edges.collect()}
    assert edges == {("app.py", "shared.py"), ("pkg/core.py", "shared.py"), ("pkg/helper.py", "pkg/core.py"),
                     ("pkg/helper.py", "shared.py"), ("web/index.html", "web/app.js")}
    assert [r.file_path for r in model.monolithic_files().collect()] == ["shared.py"]
    dead = {r.file_path for r in model.dead_files().collect()}
    assert {"pkg/lost.py", "web/style.css"} <= dead and not dead & {"app.py", "shared.py"}
    assert [(r.file_path, r.domain_count) for r in model.cross_cutting_files().collect()] == [("pkg/core.py", 3)]
    assert model.architecture_summary().first().summary == "Analyzed 12 files, 1 highly coupled, 1 cross-cutting."
    meta = model.metadata.first()
    assert meta.total_files == 12 and meta.total_modules == 6 and list(meta.languages) == ["Css", "Html", "Javascript", "Python"]
    assert model.hotspots.count() == 5


def test_documents(model):
    doc = payloads.project_document(model)
    assert {f["relative_path"] for f in doc["root_files"]} == {"X.PY", "app.py", "shared.py"}
    assert {m["relative_path"] for m in doc["modules"]} == {"my pkg+x", "pkg", "vendor", "web"} and len(doc["hotspots"]) == 5
    assert "dependents" in next(f for f in doc["root_files"] if f["name"] == "shared.py")
    impact = payloads.impact_document(model, "shared.py")
    assert impact["upstream"]["by_hop"] == {"1": ["app.py", "pkg/core.py", "pkg/helper.py"]} and impact["downstream"]["total_count"] == 0
    one = payloads.file_document(model, "shared.py")
    assert one["symbols"][0]["usage_count"] == 1 and len(one["dependents"]) == 3
    assert payloads.file_document(model, "nope.py") is None
    assert payloads.symbol_document(model, "shared.py", "run")["usages"] == [{"file": "app.py", "line": 7}]
    assert {"nodes", "links"} == set(payloads.graph_document(model))
    assert payloads.architecture_document(model)["summary"].startswith("Analyzed 12")
    assert '"name"' in payloads.to_json(doc)


def test_warm_runs_open_only_new_files(spark, tmp_path):
    root, cache, opened = tmp_path / "src", ParseCache(spark, str(tmp_path / "cache")), []

    def read(listing):
        opened.extend(r.file_path for r in listing.select("file_path").collect())
        return with_text(listing, str(root))

    def run():
        opened.clear()
        parsed = cache.parse(scan_sources(spark, str(root), content=False), read=read)
        return {r.file_path: len(r.symbols) for r in parsed.collect()}

    write(root, {"a.py": "def a(): pass\n", "b.css": ".x{a:b}.y{c:d}", "c.js": "function c() {\n}\n"})
    assert run() == {"a.py": 1, "b.css": 2, "c.js": 1} and sorted(opened) == ["a.py", "b.css", "c.js"]
    assert run() == {"a.py": 1, "b.css": 2, "c.js": 1} and opened == []
    write(root, {"b.css": ".x{a:b} .z{long:1}.y{c:d}"})
    assert run() == {"a.py": 1, "b.css": 3, "c.js": 1} and opened == ["b.css"]


def test_own_parser(spark, tmp_path):
    """A function of the user as a parser, and one that fails on one file."""
    def parse_ini(text):
        if "broken" in text:
            raise ValueError("no")
        lines = text.split("\n")
        return {"symbols": [symbol(line[1:-1], "section", n, n, 0, 0, top=n) for n, line in enumerate(lines, 1) if line.startswith("[")],
                "imports": [line[8:] for line in lines if line.startswith("include ")]}

    write(tmp_path, {"a.ini": "[one]\ninclude x.ini\n[two]\n", "b.ini": "[broken]\n", "c.py": "x = 1\n"})
    registry = AdapterRegistry().register_parser("ini", [".ini"], parse_ini)
    parsed = {r.file_path: r for r in Engine(spark, registry).analyze(str(tmp_path)).parsed.collect()}
    assert [s.name for s in parsed["a.ini"].symbols] == ["one", "two"] and parsed["a.ini"].imports == ["x.ini"]
    assert (parsed["b.ini"].parse_status, parsed["b.ini"].symbols) == ("parse_error", []) and parsed["c.py"].parse_status == "ok"


def test_table_function_of_a_parser(spark):
    """A registered parser in SQL, with LATERAL; a text it fails on has no symbols."""
    def parse_ini(text):
        return {"symbols": [symbol(line[1:-1], "section", i, i, 0, 0) for i, line in enumerate(text.split("\n"), 1) if line[0] == "["]}

    registry = AdapterRegistry().register_parser("ini", [".ini"], parse_ini)
    register_table_function(spark, "ini", "ini_symbols", registry)
    register_table_function(spark, "python", "python_symbols")
    spark.createDataFrame([("a", "[one]\nx\n[two]"), ("b", "bad\n\n"), ("c", None)], "id string, text string").createOrReplaceTempView("ini_files")
    rows = spark.sql("SELECT id, s.name, s.line_start FROM ini_files, LATERAL ini_symbols(text) AS s").collect()
    assert sorted(tuple(r) for r in rows) == [("a", "one", 1), ("a", "two", 3)]
    python = spark.sql("SELECT name, kind FROM python_symbols('class A:\\n  def f(self): pass\\n')").collect()
    assert [tuple(r) for r in python] == [("A", "class"), ("f", "method")]
    with pytest.raises(ValueError):
        register_table_function(spark, "java", "java_symbols")


def test_cache_parses_only_what_changed(spark, tmp_path):
    root, cache = tmp_path / "src", ParseCache(spark, str(tmp_path / "cache"))
    write(root, {"a.py": "def a(): pass\n", "b.py": "def b(): pass\n", "c.js": "function c() {\n}\n"})
    first = cache.parse(scan_sources(spark, str(root)))
    assert first.count() == 3 and {r.adapter: r.entries for r in cache.stats().collect()} == {"python": 2, "javascript": 1}
    # a forged entry shows that an unchanged file is not parsed again
    forged = first.where("file_path = 'a.py'").withColumn("line_count", F.lit(99)).unionByName(first.where("file_path <> 'a.py'"))
    cache.replace(forged)
    write(root, {"b.py": "def b1(): pass\ndef b2(): pass\n", "d.py": "x = 1\n"})
    os.remove(root / "c.js")
    second = {r.file_path: (r.line_count, len(r.symbols)) for r in cache.parse(scan_sources(spark, str(root))).collect()}
    assert second == {"a.py": (99, 1), "b.py": (3, 2), "d.py": (2, 0)}
    # the old rows of b.py and c.js are still stored until the cache is compacted
    assert sum(r.entries for r in cache.stats().collect()) == 5
    cache.compact(scan_sources(spark, str(root), content=False))
    assert {r.adapter: r.entries for r in cache.stats().collect()} == {"python": 3}
    cache.invalidate("a.py")
    assert cache.stats().first().entries == 2
    cache.invalidate()
    assert cache.stats().count() == 0


def test_diff_against_a_revision(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {"a.py": "def a(): pass\n", "b.py": "x = 1\n"})
    git = ["git", "-c", "user.name=t", "-c", "user.email=t@example.org"]
    for args in (["init", "-q"], ["add", "-A"], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], cwd=root, check=True)
    write(root, {"a.py": "def a():\n" + "    if x:\n        y()\n" * 5, "c.py": "y = 1\n"})
    os.remove(root / "b.py")
    rows = {r.file_path: r.status for r in Engine(spark).diff_revision(str(root), "HEAD").collect()}
    assert rows == {"a.py": "MODIFIED", "b.py": "DELETED", "c.py": "ADDED"}
    for bad in ("nothing-here", "--output=/tmp/x"):
        with pytest.raises(ValueError):
            list_revision(spark, str(root), bad)
    with pytest.raises(ValueError):
        list_revision(spark, str(tmp_path), "HEAD")


def test_revisions_as_tables(spark, tmp_path, monkeypatch):
    """Every file of a revision is listed once, whatever its folder; only changed blobs are parsed."""
    from srcgraph.plans import engine as plans
    from srcgraph.sources import git as source
    root = tmp_path / "repo"
    files = {f"d{i % 3}/e{i % 2}/f/g/m{i}.py": f"def f{i}():\n    return {i}\n" for i in range(12)}
    files |= {"top.py": "import os\r\n", "empty.py": "", "d0/ü b.py": "x = 1\n", "d0/e0/node_modules/x.js": "function f() {\n}\n", "a.txt": "t"}
    write(root, files)
    os.symlink("../d0/ü b.py", root / "d0" / "link.py")
    os.symlink("nowhere.py", root / "lost.py")
    git = ["git", "-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "core.autocrlf=false"]
    for args in (["init", "-q"], ["add", "-A"], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], cwd=root, check=True)
    listed = list_revision(spark, str(root), "HEAD")
    files["d0/link.py"] = files["d0/ü b.py"]
    assert sorted((r.file_path, r.size) for r in listed.collect()) == sorted((p, len(t.encode())) for p, t in files.items())
    ids = listed.join(with_text_ids(spark, root), "file_path").where("blob = here").count()
    assert ids == len(files)
    first = {r.file_path: r.line_count for r in Engine(spark).analyze_revision(str(root), "HEAD").files.collect()}
    assert len(first) == 16 and first["d0/e0/f/g/m0.py"] == 3 and first["empty.py"] == Engine(spark).analyze(str(root)).files.where(
        "file_path = 'empty.py'").first().line_count
    write(root, {"d1/e1/f/g/m1.py": "def f1():\n" + "    if x:\n        y()\n" * 9, "new.py": "y = 1\n"})
    os.remove(root / "top.py")
    subprocess.run([*git, "add", "-A"], cwd=root, check=True)
    subprocess.run([*git, "commit", "-qm", "two"], cwd=root, check=True)
    parsed, parse = [], plans.parse_listing
    monkeypatch.setattr(plans, "parse_listing", lambda listing, *rest: parsed.extend(r.file_path for r in listing.collect()) or parse(listing, *rest))
    engine = Engine(spark)
    wanted = {"d1/e1/f/g/m1.py": "MODIFIED", "top.py": "DELETED", "new.py": "ADDED"}
    for other in (None, "HEAD"):
        parsed.clear()
        assert {r.file_path: r.status for r in engine.diff_revision(str(root), "HEAD~1", other=other).collect()} == wanted
        assert sorted(parsed) == ["d1/e1/f/g/m1.py", "d1/e1/f/g/m1.py", "new.py", "top.py"]
    whole = engine.diff_models(engine.analyze_revision(str(root), "HEAD~1"), engine.analyze(str(root)))
    assert [tuple(r) for r in whole.collect()] == [tuple(r) for r in engine.diff_revision(str(root), "HEAD~1").collect()]
    assert engine.diff_revision(str(root), "HEAD").count() == 0
    short = source.TreeReader(str(root), source.tree_of(str(root), "HEAD"))
    monkeypatch.setattr(source, "ENOUGH_FOLDERS", 1)
    assert [p.deep for p in short.partitions()] == [True]


def with_text_ids(spark, root):
    from srcgraph.sources.git import blob_id
    from srcgraph.sources.scan import read_content
    return read_content(list_files(spark, str(root)), str(root)).select("file_path", blob_id(F.col("content")).alias("here"))


def test_watcher_sees_every_kind_of_change(spark, tmp_path):
    root, seen = tmp_path / "src", []
    write(root, {"a.py": "1\n", "b.txt": "2\n", "node_modules/x.js": "3\n", ".git/c": "4\n"})
    watcher = Watcher(spark, str(root), str(tmp_path / "state"), lambda changes: seen.append(sorted((r.path, r.change) for r in changes.collect())))
    assert watcher.step(0) is None and watcher.step(1) is None
    write(root, {"a.py": "longer\n", "new.md": "5\n", "node_modules/x.js": "changed\n"})
    os.remove(root / "b.txt")
    watcher.step(2)
    assert seen == [[("a.py", "changed"), ("b.txt", "removed"), ("new.md", "added")]]
    assert watcher.step(3) is None and watcher.events().count() == 3
    assert sorted(r.path for r in snapshot(spark, str(root)).collect()) == ["a.py", "new.md"]


def test_watcher_as_a_stream(spark, tmp_path):
    import time
    root = tmp_path / "src"
    write(root, {"a.py": "1\n"})
    watcher = Watcher(spark, str(root), str(tmp_path / "state"))
    watcher.step(0)
    write(root, {"b.py": "2\n"})
    running = watcher.start("500 milliseconds")
    deadline = time.time() + 60
    while time.time() < deadline and watcher.events().isEmpty():
        time.sleep(0.5)
    running.stop()
    assert [(r.path, r.change) for r in watcher.events().collect()] == [("b.py", "added")]


def test_changes_as_a_source(spark, tmp_path):
    """Batches follow the versions of the log; a stopped reader goes on where it was, a second one sees everything."""
    root, out = tmp_path / "src", tmp_path / "out"
    write(root, {"a.py": "1\n", "b.py": "2\n"})
    watcher = Watcher(spark, str(root), str(tmp_path / "state"))

    def run(name):
        query = (watcher.stream().select("path", "change").writeStream.format("parquet").trigger(once=True)
                 .option("checkpointLocation", str(out / f"{name}-checkpoint")).start(str(out / name)))
        query.awaitTermination()
        return sorted((r.path, r.change) for r in spark.read.schema("path string, change string").parquet(str(out / name)).collect())
    watcher.step(0)
    write(root, {"a.py": "longer\n"})
    watcher.step(1)
    first = [("a.py", "changed")]
    assert run("one") == first and run("one") == first
    os.remove(root / "b.py")
    watcher.step(2)
    write(root, {"c.py": "3\n"})
    Watcher(spark, str(root), str(tmp_path / "state")).step(3)
    whole = [("a.py", "changed"), ("b.py", "removed"), ("c.py", "added")]
    assert run("one") == whole and run("two") == whole and watcher.step(4) is None


def test_paths_without_a_scheme(spark):
    """They lie in the default file system, as for Spark's own readers."""
    from srcgraph.session import qualified
    settings = spark._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    try:
        settings.set("fs.defaultFS", "hdfs://127.0.0.1:9")
        assert qualified(spark, "/a/b") == "hdfs://127.0.0.1:9/a/b" and qualified(spark, "file:///a/b").startswith("file:/")
    finally:
        settings.set("fs.defaultFS", before)


def test_state_changes_over_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "path string, mtime long, size long"
    for i, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 1, 1), ("b", 2, 1), ("c", 1, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        state_changes(spark.readStream.schema(schema).parquet(source), state).awaitTermination()
    rows = spark.read.parquet(os.path.join(state, "changes")).collect()
    assert sorted((r.path, r.change) for r in rows) == [("a", "added"), ("b", "added"), ("b", "changed"), ("c", "added")]


def test_command_line(spark, tree, capsys, monkeypatch):
    from srcgraph import cli
    monkeypatch.setattr(cli.SparkSession, "getActiveSession", staticmethod(lambda: spark))
    cli.main(["list-adapters"])
    assert "javascript" in capsys.readouterr().out
    cli.main(["analyze", tree, "--json", "--lang", "css"])
    assert '"web/style.css"' in capsys.readouterr().out
    cli.main(["impact", tree, "shared.py"])
    assert '"upstream"' in capsys.readouterr().out
