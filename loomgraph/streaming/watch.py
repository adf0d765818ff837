"""Structured Streaming: watching a tree, windows over events, review status per finding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.incremental import VersionedTable
from loomgraph.operators.maintain import delta
from loomgraph.session import scratch_path

FILE_EVENTS = "path string, change string"
STATUS = "id string, status string, n_seen int"


def watch(spark: SparkSession, root: str, scan: Callable[[DataFrame, int], None], *, suffix: str = "*", interval: str = "10 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Call ``scan(paths, batch)`` with the files that appear or change below ``root``.

    The file source takes each (path, modification time) once and remembers it in
    the checkpoint, so a restart goes on where it stopped.  It never reports
    deletions: compare a listing with the manifest (``deletions``) inside ``scan``.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root)
    seen = stream.select("path", F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000).alias("mtime"))
    return seen.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint or scratch_path(spark, "watch")).trigger(processingTime=interval).start()


def deletions(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths of the manifest that a listing no longer has."""
    return delta(listing, manifest, compute_hashes=False).filter("change = 'deleted'").select("path")


def windowed_counts(stream: DataFrame, *, ts: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows per event-time window and key; state older than the watermark is dropped, so it stays bounded."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, *, ts: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows per session of a key."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def review_states(stream: DataFrame) -> DataFrame:
    """Status of each finding (``id, status, seen_at``) as observations arrive, kept as state per id.

    A finding that was resolved and is seen again becomes unreviewed; any other
    status replaces the one before.  Observations of a batch apply in time order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["seen_at", "status"])
        for new in rows["status"]:
            status = "unreviewed" if status == "resolved" and new in (None, "", "unreviewed") else new or status or "unreviewed"
            n += 1
        state.update((status, n))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "n_seen": [n]})

    return stream.groupBy("id").applyInPandasWithState(step, STATUS, "status string, n int", "update", "NoTimeout")


def run_to_table(stream: DataFrame, target: VersionedTable, *, mode: str = "complete", checkpoint: str | None = None) -> VersionedTable:
    """Run a streaming query over what is there now; each batch is one version of the table.

    The batch number is saved in the commit, so a batch that is repeated after a
    failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        now = target.latest()
        if target.manifest(now)["meta"].get("batch", -1) >= number:
            return
        held = {} if mode == "complete" else target.manifest(now)["files"]
        new = [f for group in target.write_files(batch).values() for f in group]
        target.commit({**held, **dict.fromkeys(new)}, {"batch": number}, on=now)

    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return target


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted by a streaming query."""
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed_counts(events, ts="ts", by=["event_type"])
    return run_to_table(counted, VersionedTable(spark, scratch_path(spark, "windows"))).read().select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


QUERIES = {"streamed_windows": streamed_windows}
ORACLES = {"streamed_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"}
