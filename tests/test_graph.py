from loomgraph import schema
from loomgraph.operators import graph, search


def fixture(spark):
    rows = [
        ("f", 0, "function", "get_user", "active", "fetches a user by id", "auth/user.py", 10, []),
        ("c", 1, "class", "UserService", "active", "account management service layer", "auth/service.py", 1, ["run"]),
        ("m", 2, "module", "auth_module", "active", "authentication package", "auth/__init__.py", 1, []),
        ("d", 3, "class", "OldThing", "deleted", "", "old.py", 1, []),
        ("s", 4, "other", "Missing", "stub", "", "", None, []),
        ("t", 5, "function", "test_user", "active", "", "tests/test_user.py", 1, []),
    ]
    ents = spark.createDataFrame(rows, "id string, seq bigint, type string, name string, status string, summary string, file_path string, line_start int, methods array<string>")
    entities = schema.conform(ents, schema.ENTITIES)
    edges = spark.createDataFrame([(*r, None) for r in [("c", 0, "calls", "f", None, ["run"]), ("t", 0, "calls", "c", None, []), ("c", 1, "uses", "s", None, []), ("c", 2, "calls", "c", None, []), ("f", 0, "calls", "t", None, [])]], schema.EDGES)
    return entities, edges


def ids(df, *cols):
    return sorted(map(tuple, df.select("id", *cols).collect()))


def test_resolve_and_find(spark):
    e, g = fixture(spark)
    assert ids(graph.resolve(e, "f")) == [("f",)] and ids(graph.resolve(e, " GET_user ")) == [("f",)]
    assert ids(graph.resolve(e, "OldThing")) == [] and ids(graph.resolve(e, "nothing")) == []
    assert ids(search.find(e, "user"), "tier") == [("c", 2), ("f", 1), ("t", 1)]
    assert ids(search.method_definitions(e, "UserService.run"), "priority") == [("c", 0)]
    assert ids(search.method_definitions(e, "run"), "method") == [("c", "run")]
    assert [tuple(r) for r in search.callers(search.find(e, "get_user"), g).collect()] == [("f", "c", "calls", 1)]


def test_impact_depth_cycles_and_tests(spark):
    e, g = fixture(spark)
    # f <- c <- t <- f: the subject is never a row
    assert ids(graph.impact(e, g, "get_user", depth=1, strict_depth=True), "hop", "via") == [("c", 1, "calls")]
    assert ids(graph.impact(e, g, "get_user", depth=1), "hop", "via") == [("c", 1, "calls"), ("t", 2, "calls -> calls")]
    assert ids(graph.impact(e, g, "get_user", depth=3, exclude_tests=True)) == [("c",)]
    assert ids(graph.impact(e, g, "get_user", kinds=["uses"])) == [] and ids(graph.impact(e, g, "unknown")) == []


def test_path_orphans_neighborhood(spark):
    e, g = fixture(spark)
    steps = [tuple(r) for r in graph.shortest_path(e, g, "UserService", "get_user").orderBy("step").collect()]
    assert steps == [(0, "c", None, None, "semantic"), (1, "f", "calls", False, "semantic")]
    assert [r[0] for r in graph.shortest_path(e, g, "f", "f").collect()] == [0]
    assert graph.shortest_path(e, g, "f", "m").count() == 0
    only = spark.createDataFrame([("c", 0, "calls", "f", None, [], None)], schema.EDGES)
    assert ids(graph.orphans(e, only)) == [("c",)]
    n, inner = graph.neighborhood(e, g, "UserService", depth=1)
    assert ids(n, "hop") == [("c", 0), ("f", 1), ("s", 1), ("t", 1)]
    text = graph.diagram(n, inner, e).first()[0]
    assert text.startswith("```mermaid\ngraph TD\n") and 'nc["UserService"]' in text and "nc -->|calls| nf" in text


def test_context(spark):
    e, g = fixture(spark)
    got = search.context(e, g, "user authentication service")
    assert {"f", "c"} <= {r["id"] for r in got.collect()}
    assert search.context(e, g, "the of and").count() == 0
    assert ids(search.context(e, g, "", anchors=["auth_module"]), "score") == [("m", 30)]


def test_empty_graph(spark):
    e, g = schema.empty(spark, schema.ENTITIES), schema.empty(spark, schema.EDGES)
    assert graph.impact(e, g, "x").count() == 0 and graph.orphans(e, g).count() == 0 and search.context(e, g, "user").count() == 0
    assert graph.shortest_path(e, g, "a", "b").count() == 0 and search.stats_by_type(e).count() == 0


def test_method_callers(spark):
    e, g = fixture(spark)
    from pyspark.sql import functions as F

    call = F.array(F.struct(F.lit("UserService").alias("receiver"), F.lit("run").alias("method"), F.lit("go").alias("via")))
    e = e.withColumn("called_methods", F.when(F.col("id") == "f", call))
    got = search.method_callers(e, g, search.method_definitions(e, "run").select("id"), "run")
    assert sorted(map(tuple, got.collect())) == [("c", "f", "calls run (in go)", 10)]
