import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.incremental import ConflictError, VersionedTable, changed_keys, process_new, take_up, versions_by_cutoff


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_deltas_and_deletion_vectors(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.versions() == [] and t.changes(-1) is None
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.append(spark.createDataFrame([(3, "c")], "k int, v string"))
    t.delete_where("k = 2")
    t.delete_where("k = 1")
    assert rows(t.read()) == [(3, "c")] and rows(t.read(0)) == [(1, "a"), (2, "b")] and rows(t.read(2)) == [(1, "a"), (3, "c")]
    assert rows(t.changes(-1, 0).select("k", "_version", "_op")) == [(1, 0, "add"), (2, 0, "add")]
    assert rows(t.changes(0).select("k", "_version", "_op")) == [(1, 3, "remove"), (2, 2, "remove"), (3, 1, "add")]
    # compaction: one file for all, without a net change
    new = [f for g in t.write_files(t.read()).values() for f in g]
    t.commit(dict.fromkeys(new))
    net = t.changes(3).groupBy("k").agg(F.sum(F.when(F.col("_op") == "add", 1).otherwise(-1)).alias("n")).filter("n != 0")
    assert net.count() == 0


def test_one_writer_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit({}, on=-1)
    with pytest.raises(ConflictError):
        t.commit({}, on=-1)


def test_failed_run_is_repeated_and_nothing_twice(spark, tmp_path):
    src, out = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    src.append(spark.createDataFrame([(1,), (2,)], "k int"))
    take = lambda d, held: d.filter("_op = 'add'").select("k")

    def fail(delta, held):
        out.write_files(delta.select("k"))  # files of a run that dies before its commit
        raise RuntimeError("worker lost")

    with pytest.raises(RuntimeError):
        process_new(src, out, fail)
    assert out.latest() == -1
    assert process_new(src, out, take) == 0 and process_new(src, out, take) is None
    src.append(spark.createDataFrame([(3,)], "k int"))
    process_new(src, out, take)
    assert rows(out.read()) == [(1,), (2,), (3,)]


def brute(rows_, cutoffs):
    found, before = [], {}
    for i, c in enumerate(cutoffs):
        best = {}
        for r, p, at, seen, n, h in rows_:
            if at is not None and at <= c and h is not None:
                if (r, p) not in best or (seen, n, h) > best[r, p]:
                    best[r, p] = (seen, n, h)
        found += [(i, r, p) for (r, p), b in best.items() if before.get((r, p)) != b[2]]
        before = {k: b[2] for k, b in best.items()}
    return sorted(found, key=str)


def test_states_as_of_versions(spark, tmp_path):
    rng, t0 = random.Random(3), datetime(2030, 1, 1)
    data = []
    for n in range(400):
        at = None if rng.random() < 0.02 else t0 + timedelta(hours=rng.randint(0, 50))
        data.append((rng.choice(["a", "b", None]), f"p{rng.choice([0, 0, 0, rng.randint(1, 30)])}", at, t0 + timedelta(hours=rng.randint(0, 20)), rng.randint(0, 400), rng.choice(["x", "y", None])))
    data += data[:20]
    cutoffs = [t0 + timedelta(hours=h) for h in (5, 10, 10, 20, 40)][:2] + [t0 + timedelta(hours=h) for h in (20, 40)]
    df = spark.createDataFrame(data, "repo string, path string, arrived timestamp, seen timestamp, n int, hash string")
    log = versions_by_cutoff(spark, str(tmp_path / "l"), df, "arrived", cutoffs)
    how = {"key": ["repo", "path"], "state": "hash", "order": ["seen", "n"]}
    got = changed_keys(log.changes(-1).filter("_op = 'add'"), **how)
    pick = lambda d: sorted(map(tuple, d.filter("changed").select("_version", "repo", "path").collect()), key=str)
    assert pick(got) == brute(data, cutoffs)
    # run by run, or two versions at a time, the same; a run that dies between two others leaves no trace
    for step in (1, 2):
        out, dead = VersionedTable(spark, str(tmp_path / f"o{step}")), []
        for upto in range(step - 1, len(cutoffs), step):
            if not dead:
                dead.append(out.write_files(changed_keys(log.changes(-1, upto).filter("_op = 'add'"), **how)))  # written, never committed
            take_up(log, out, upto=upto, **how)
        assert pick(out.read()) == brute(data, cutoffs)
        assert take_up(log, out, **how) is None and out.manifest(out.latest())["meta"] == {"processed": len(cutoffs) - 1}


def test_a_run_reads_its_own_delta_only(spark, tmp_path):
    t0 = datetime(2030, 1, 1)
    df = spark.createDataFrame([("r", f"p{i}", t0 + timedelta(hours=i), "h") for i in range(6)], "repo string, path string, arrived timestamp, hash string")
    log = versions_by_cutoff(spark, str(tmp_path / "l"), df, "arrived", [t0 + timedelta(hours=h) for h in range(6)])
    seen = []

    def transform(delta, held):
        seen.append((delta.count(), set(delta.inputFiles()), held.count() if held is not None else 0))
        return delta.select("path", "_version")

    out = VersionedTable(spark, str(tmp_path / "o"))
    for v in range(6):
        process_new(log, out, transform, upto=v)
    assert [n for n, _, _ in seen] == [1] * 6 and [n for _, _, n in seen] == list(range(6))
    assert sum(len(f) for _, f, _ in seen) == len(set().union(*(f for _, f, _ in seen)))


def test_log_entries_list_changes_and_now_and_then_all_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(23):
        t.append(spark.createDataFrame([(i,)], "k int"))
    t.delete_where("k = 3")
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert rows(again.read()) == [(i,) for i in range(23) if i != 3] and rows(again.read(11)) == [(i,) for i in range(12)]
    assert "files" in again._entry(20) and "files" not in again._entry(21) and len(again._entry(21)["put"]) == len(t.manifest(21)["files"]) - len(t.manifest(20)["files"])


def test_large_versions_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(1000).repartition(1).selectExpr("cast(id as string) AS repo", "timestamp'2030-01-01' AS arrived", "'h' AS hash")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    files = [len(versions_by_cutoff(spark, str(tmp_path / f"t{n}"), df, "arrived", [datetime(2030, 1, 2)], rows_per_file=n).manifest(0)["files"]) for n in (10, 10_000)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files[0] > files[1] == 1


def test_empty_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([], "repo string, path string, arrived timestamp, hash string, before string, best int, now int")
    log = versions_by_cutoff(spark, str(tmp_path / "l"), df, "arrived", [datetime(2030, 1, 1)])
    assert log.versions() == [0]
    one = spark.createDataFrame([("r", "p", datetime(2029, 1, 1), "h", "b", 1, 2)], df.schema)
    log = versions_by_cutoff(spark, str(tmp_path / "m"), one, "arrived", [datetime(2030, 1, 1)])
    got = changed_keys(log.changes(-1), key=["repo", "path"], state="hash", order=["arrived"])
    assert rows(got.select("_version", "repo", "path", "hash", "changed")) == [(0, "r", "p", "h", True)]
