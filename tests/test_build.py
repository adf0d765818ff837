"""The graph build: how it joins, and what imports mean."""

from pyspark.sql import functions as F

from loomgraph.operators import build
from loomgraph.operators.extract import extract
from loomgraph.plans import fixture
from loomgraph.session import stage
from loomgraph.sources.files import scan_language


def _built(spark, files):
    rows = fixture._rows(spark, files).withColumn("language", scan_language(F.col("path")))
    return build.build(stage(extract(rows), "parsed"), F.lit("2030-01-01").cast("timestamp"))


def test_nothing_is_broadcast(spark, monkeypatch):
    """Staged tables are small on disk whatever they hold in memory: a broadcast of them ended the driver at 1 GB."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, label)

    monkeypatch.setattr(build, "stage", kept)
    for df in _built(spark, fixture.FILES):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_imports_reach_the_first_file_they_may_mean(spark):
    entities, edges = _built(spark, {
        "a/one.py": "import b.two\nimport b.lost\nfrom . import near\nfrom .near import x\nfrom ..c.far import y\nimport both\n",
        "a/near.py": "x = 1\n",
        "a/__init__.py": "z = 1\n",
        "b/two.py": "x = 1\n",
        "b.py": "x = 1\n",
        "c/far.py": "y = 1\n",
        "both.py": "x = 1\n",
        "both/__init__.py": "x = 1\n",
        "c/d/use.c": "#include \"own.h\"\n#include <far.h>\n",
        "c/d/own.h": "int x;\n",
        "own.h": "int x;\n",
        "r/a.rb": "require 'tools/saw'\n",
        "lib/tools/saw.rb": "class Saw\nend\n",
    })
    name = {r["id"]: r["name"] for r in entities.collect()}
    found = {(name[r["src"]], r["kind"], name[r["dst"]]) for r in edges.filter("kind in ('imports', 'depends_on')").collect()}
    assert found == {
        ("a/one.py", "imports", "b/two.py"),
        ("a/one.py", "imports", "b.py"),  # b.lost is no file, but may be a name in b
        ("a/one.py", "imports", "a/__init__.py"),
        ("a/one.py", "imports", "a/near.py"),
        ("a/one.py", "imports", "c/far.py"),
        ("a/one.py", "imports", "both.py"),
        ("c/d/use.c", "imports", "c/d/own.h"),
        ("c/d/use.c", "depends_on", "far"),
        ("r/a.rb", "imports", "lib/tools/saw.rb"),
    }
