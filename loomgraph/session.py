"""Session-level helpers: reading tables and materialising intermediate results.

``stage`` is the only way intermediate results are cut from their lineage.  It
writes a compressed, column-pruned parquet table under the folder named by
``spark.checkpoint.dir`` - storage that every executor can read, so losing an
executor never loses a staged table.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_scope = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors.

    Taken from ``spark.checkpoint.dir``.  Only a local master may run without
    that setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when its scope or the driver ends."""
    root = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex[:12]}"
    held = getattr(_scope, "paths", None)
    if held is not None:
        held.append(path)
    else:
        atexit.register(remove, spark, path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes what this thread stages within it: for services, whose driver does not end.

    Results must be read inside; DataFrames over staged tables are dead after it.
    """
    before, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            remove(spark, path)
        _scope.paths = before


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; silently does nothing once the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may already be down at exit
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped or spark.sparkContext.master.startswith("local["):
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="loomgraph-ship-")
    made = shutil.make_archive(os.path.join(folder, "loomgraph"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(made)
    # the driver serves the archive from here to every executor that starts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
