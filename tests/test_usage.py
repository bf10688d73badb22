import pytest
from pyspark.sql import functions as F

from srcgraph.plans.engine import Engine

SOURCES = {
    "models.py": "class FileModel:\n    pass\n\nclass Project:\n    pass\n\ndef helper():\n    return FileModel()\n",
    "engine.py": "from models import FileModel, helper\n\ndef run():\n    helper()\n    return FileModel()\n",
    "cli.py": "import models\n\nprint(models.FileModel())\n",
    "unrelated.py": "FileModel = 1\nprint(FileModel)\n",
    "pkg/__init__.py": "def top():\n    pass\n",
    "pkg/inner.py": "from . import top\nfrom .deep import leaf as twig\nfrom .. import nothing\ntwig()\ntop()\n",
    "pkg/deep.py": "def leaf():\n    pass\n",
    "alias.py": "import pkg.deep as d, pkg.inner\nd.leaf()\nd.missing\n",
    "broken.py": "def (:\n",
    "star.py": "from models import *\nFileModel()\n",
    "local.py": "def f():\n    from models import helper\n    helper()\n",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(path, "python", text) for path, text in SOURCES.items()]
    return Engine(spark).analyze_table(spark.createDataFrame(rows, "file_path string, adapter string, text string"), "p")


def sites(model, path, symbol):
    return [(r.use_file, r.line) for r in model.symbol_impact(path, symbol).collect()]


def test_name_and_attribute_references(model):
    assert sites(model, "models.py", "FileModel") == [("cli.py", 3), ("engine.py", 5)]
    assert sites(model, "models.py", "helper") == [("engine.py", 4)]
    assert sites(model, "models.py", "Project") == []


def test_relative_and_aliased_imports(model):
    assert sites(model, "pkg/deep.py", "leaf") == [("alias.py", 2), ("pkg/inner.py", 4)]
    # "from . import top" means the module file of the folder, then the package itself
    assert sites(model, "pkg/__init__.py", "top") == [("pkg/inner.py", 5)]


def test_counts(model):
    from srcgraph.operators import usage
    counts = {(r.file_path, r.name): r.file_count for r in usage.symbol_counts(model.definitions, model.usages).collect()}
    assert counts["models.py", "FileModel"] == 2 and counts["models.py", "helper"] == 1 and counts["models.py", "Project"] == 0
    impact = {r.symbol: (r.usage_count, r.file_count) for r in usage.symbol_impact(model.usages.where(F.col("def_file") == "models.py")).collect()}
    assert impact == {"FileModel": (2, 2), "helper": (1, 1)}


def test_syntax_error_is_marked(model):
    row = model.files.where("file_path = 'broken.py'").first()
    assert (row.parse_status, row.symbol_count, row.line_count) == ("syntax_error", 0, 2)
    assert row.purpose.endswith("Stub / Init")


def test_no_growing_side_is_broadcast(spark):
    from srcgraph.operators import usage
    bindings = spark.createDataFrame([("o.py", 1, "from", "m", 0, "f", "f"), ("p.py", 1, "import", "m", 0, None, "m")],
                                     "file_path string, pos int, form string, module string, level int, name string, local string")
    references = spark.createDataFrame([("o.py", "f", None, 3), ("o.py", "f", None, 4), ("p.py", "m", "f", 5), ("p.py", "m", "g", 6)],
                                       "file_path string, base string, attr string, line int")
    definitions = spark.createDataFrame([("m.py", "f")], "file_path string, name string")
    files = spark.createDataFrame([("m.py",), ("o.py",), ("p.py",)], "file_path string")
    used = usage.symbol_usages(bindings, references, definitions, files)
    assert sorted(map(tuple, used.collect())) == [("m.py", "f", "o.py", 3), ("m.py", "f", "o.py", 4), ("m.py", "f", "p.py", 5)]
    # all of these tables grow with the project; a hash table of one would be built by the driver
    for frame in (used, usage.impact_rows(used), usage.symbol_counts(definitions, used), usage.usage_lines(used)):
        frame.collect()
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
