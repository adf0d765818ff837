import pytest

from loomgraph import schema
from loomgraph.sources.registry import BackgroundRun, Registry
from loomgraph.sources.store import GraphStore


def test_names(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "reg"))
    assert r.list() == {} and r.get("a") is None
    (tmp_path / "a").mkdir()
    first = r.register("a", str(tmp_path / "a"), "one")
    assert r.register("a", "", "two")["created"] == first["created"] and r.get("a")["description"] == "two"
    assert r.resolve("a") == str(tmp_path / "a") and r.resolve("/else") == "/else"
    for bad in ("", "a/b", "x" * 65, "a.b"):
        with pytest.raises(ValueError):
            r.register(bad, "/x")
    assert r.remove("a") and r.list() == {}


def test_background_run(spark):
    run = BackgroundRun(spark, lambda: spark.range(10).count())
    assert run.wait(60) == 10 and run.status()["state"] == "completed"
    bad = BackgroundRun(spark, lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.wait(60)
    assert bad.status()["state"] == "failed"


def test_store_publishes_together(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.load("edges").count() == 0
    edges = spark.createDataFrame([("a", 0, "calls", "b", None, [], None)], schema.EDGES)
    assert store.publish({"edges": edges}) == 1
    store.publish({"names": spark.createDataFrame([("a", "a", False)], schema.NAMES)})
    assert store.version() == 2 and store.load("edges").count() == 1 and store.load("names").count() == 1
    store.drop()
    assert store.load("edges").count() == 0


def test_validation(spark):
    rows = [("a", "class", "A", "active", "s", 1, ["x"]), ("", "class", None, "odd", "s", 0, [""])]
    df = spark.createDataFrame(rows, "id string, type string, name string, status string, source string, version int, kind array<string>")
    got = {r["id"]: r["errors"] for r in schema.validation_errors(df).collect()}
    assert got["a"] == [] and got[""] == ["missing id", "missing name", "unknown status: odd", "version below 1", "empty kind"]
