from datetime import datetime

import pytest

from loomgraph.operators.references import orphan_references, orphan_report

T = datetime(2030, 1, 1)
REFS = [(1, "a", "x", T), (2, "a", "y", T), (3, "a", None, T), (4, None, "x", T), (5, None, None, T), (6, "b", "x", T), (6, "b", "x", T), (7, "c", "z", T), (8, "d", "q", None), (9, "b", None, T)]
TARGETS = [("a", "x", False, datetime(2029, 1, 1)), ("c", "z", True, datetime(2029, 1, 1)), ("c", "z", True, datetime(2029, 1, 1)), ("b", "x", False, datetime(2031, 1, 1)), ("d", "q", False, datetime(2031, 1, 1)), (None, "k", False, T)]


def run(spark, refs=REFS, targets=TARGETS, **more):
    r = spark.createDataFrame(refs, "n int, p string, q string, at timestamp")
    t = spark.createDataFrame(targets, "p string, name string, gone boolean, created timestamp")
    got = orphan_references(r, t, on={"p": "p", "q": "name"}, at="at", deleted="gone", created="created", **more)
    assert got.columns == ["n", "p", "q", "at", "reason"]
    return sorted((x["n"], x["reason"]) for x in got.collect())


@pytest.mark.parametrize("hot", [1_000_000, 2, 1])
def test_match_semantics(spark, hot):
    whole = [(2, "missing"), (6, "late"), (6, "late"), (7, "deleted")]
    assert run(spark, hot_from=hot) == whole
    assert run(spark, match="full", hot_from=hot) == sorted(whole + [(3, "missing"), (4, "missing"), (9, "missing")])
    # partial: (a, null) and (null, x) are there; (b, null) came late
    assert run(spark, match="partial", hot_from=hot) == sorted(whole + [(9, "late")])


def test_edges(spark):
    assert run(spark, refs=[]) == []
    assert run(spark, refs=[(1, "a", "x", T)], targets=[]) == [(1, "missing")]
    with pytest.raises(ValueError):
        run(spark, match="other")
    clash = spark.createDataFrame([(1, "a", "reason")], "n int, p string, reason string")
    with pytest.raises(ValueError):
        orphan_references(clash, clash, on={"p": "p"})


def test_report(spark):
    refs = spark.createDataFrame([("t", "2030-01")] * 4 + [("u", "2030-02")], "t string, period string")
    bad = spark.createDataFrame([("t", "2030-01")], "t string, period string")
    assert sorted(map(tuple, orphan_report(bad, refs, by=["t", "period"]).collect())) == [("t", "2030-01", 4, 1, 0.25), ("u", "2030-02", 1, 0, 0.0)]
