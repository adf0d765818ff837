from datetime import datetime, timedelta

from loomgraph.operators.incremental import VersionedTable
from loomgraph.streaming import watch


def test_review_states(spark, tmp_path):
    t = datetime(2030, 1, 1)
    rows = [("a", "resolved", t), ("a", "unreviewed", t + timedelta(hours=1)), ("b", None, t), ("c", "false_positive", t)]
    spark.createDataFrame(rows, "id string, status string, seen_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, status string, seen_at timestamp").parquet(str(tmp_path / "in"))
    out = watch.run_to_table(watch.review_states(stream), VersionedTable(spark, str(tmp_path / "out")), mode="update")
    assert sorted(map(tuple, out.read().collect())) == [("a", "unreviewed", 2), ("b", "unreviewed", 1), ("c", "false_positive", 1)]


def test_watch_sees_files_and_deletions(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    seen = []
    query = watch.watch(spark, str(root), lambda df, n: seen.extend(r["path"].rsplit("/", 1)[1] for r in df.collect()), suffix="*.py", interval="1 second", checkpoint=str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        (root / "b.py").write_text("y = 1\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen) == ["a.py", "b.py"]
    listing = spark.createDataFrame([("a.py", "h", 1, 1.0)], "path string, hash string, size bigint, mtime double")
    manifest = spark.createDataFrame([("a.py", "h", [], "python", 1, 1.0), ("z.py", "h", [], "python", 1, 1.0)], "path string, hash string, entity_ids array<string>, language string, size bigint, mtime double")
    assert [r[0] for r in watch.deletions(listing, manifest).collect()] == ["z.py"]


def test_sessions(spark, tmp_path):
    t = datetime(2030, 1, 1)
    spark.createDataFrame([("u", t), ("u", t + timedelta(minutes=10)), ("u", t + timedelta(hours=3))], "u string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "in"))
    out = watch.run_to_table(watch.session_counts(stream, ts="ts", by=["u"]), VersionedTable(spark, str(tmp_path / "out")))
    assert sorted(r["n"] for r in out.read().collect()) == [1, 2]
