"""Source trees as tables: listing, pruning, decoding, hashing, language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import content_hash, lookup, suffix
from loomgraph.functions.vocab import MANIFEST_LANGUAGES, SCAN_LANGUAGES, SCAN_SKIP_DIRS, SCAN_SKIP_FILES, SCAN_SKIP_SUFFIXES, SCAN_SUFFIXES, SIZE_CAP, SIZE_CAPS


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (relative), ``uri, size, mtime`` of all files below ``root``; contents are not read."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length", "modificationTime")
    return raw.select(F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split("://")[-1]) + "/", "").alias("path"), F.col("path").alias("uri"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("ms")).withColumn("mtime", F.col("ms") / 1000).drop("ms")


def size_cap(path: Column) -> Column:
    return lookup(suffix(path), SIZE_CAPS, SIZE_CAP)


def prefilter(files: DataFrame) -> DataFrame:
    """Files that a scan looks at: supported suffix, within its size cap, no skipped or dot folder, no credential file."""
    folders = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    bad_dir = F.arrays_overlap(folders, F.array(*map(F.lit, SCAN_SKIP_DIRS))) | F.exists(folders, lambda p: p.startswith(".") & (F.length(p) > 1)) | F.col("path").contains("node_modules")
    return files.filter(suffix(F.col("path")).isin(SCAN_SUFFIXES) & ~bad_dir & ~name.isin(SCAN_SKIP_FILES) & ~suffix(F.col("path")).isin(SCAN_SKIP_SUFFIXES) & (F.col("size") <= size_cap(F.col("path"))))


def stat_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or mtime differs from the manifest's; unknown (null or 0) never counts as equal.  Contents need not be read for the others."""
    old = manifest.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    same = (F.col("_s") > 0) & (F.col("_m") > 0) & (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))
    return files.join(old, "path", "left").filter(~F.coalesce(same, F.lit(False))).drop("_s", "_m")


TASK_BYTES = 64 << 20  # bytes of files that one task opens


def _opened(uri: str, most: int | None) -> bytes | None:
    """Content of one file, or its first bytes; None if it is gone."""
    try:
        if uri.startswith("/") or urlsplit(uri).scheme == "file":
            with open(re.sub("^file:/*", "/", uri), "rb") as f:
                return f.read(most)
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as f:
            return f.read(most)
    except FileNotFoundError:
        return None


def read_bytes(files: DataFrame, *, most: int | None = None) -> DataFrame:
    """``path, content`` of exactly the listed files (``path, uri, size``): tasks open them, no other file is touched.

    Files are spread over tasks of about TASK_BYTES each; ``most`` reads only so
    many bytes of each.  A file that is gone since it was listed gives no row.
    """
    total = files.agg(F.sum(F.least("size", F.lit(most)) if most else "size")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(*[batch.column(i).to_pylist() for i in range(2)]):
                found = _opened(uri, most)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([found], pa.binary())], names=["path", "content"])

    return files.select("path", "uri").repartition(max(1, -(-total // TASK_BYTES)), "uri").mapInArrow(run, "path string, content binary")


def read_texts(files: DataFrame) -> DataFrame:
    """``path, content`` of the listed files; bytes that are no UTF-8 are replaced and line ends made one kind."""
    return read_bytes(files).select("path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("content"))


def skip_reason(text: Column) -> Column:
    """``empty``, ``binary``, ``minified`` or null."""
    zeros = F.length(text) - F.length(F.replace(text, F.lit("\u0000"), F.lit("")))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when((F.length(text) > 100) & (zeros > F.length(text) * 0.1), "binary")
        .when((F.length(text) > 10_000) & (breaks < 5), "minified")
        .when(F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$"), "empty")
    )


def scan_language(path: Column) -> Column:
    return lookup(suffix(path), SCAN_LANGUAGES)


def manifest_language(path: Column) -> Column:
    return lookup(suffix(path), MANIFEST_LANGUAGES)


def manifest_of(hashes: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """Manifest rows of files (``path, size, mtime``) with known hashes (``path, hash``), without entities."""
    return hashes.join(files.select("path", "size", "mtime"), "path").select("path", "hash", F.array().cast("array<string>").alias("entity_ids"), manifest_language(F.col("path")).alias("language"), "size", "mtime", at.alias("last_scanned"))


def preview(files: DataFrame, top: int = 10) -> DataFrame:
    """``ext, n, supported``: the most frequent suffixes; ties by suffix."""
    ext = suffix(F.col("path"))
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n")).withColumn("supported", F.col("ext").isin(SCAN_SUFFIXES)).orderBy(F.desc("n"), "ext").limit(top)


def asset_guids(files: DataFrame) -> DataFrame:
    """``path, guid`` of files with a side file ``<path>.meta`` in the listing."""
    raw = read_bytes(files.filter(F.col("path").endswith(".meta")), most=1024)
    guid = F.lower(F.regexp_extract(F.decode("content", "UTF-8"), r"guid:\s*([0-9a-fA-F]{32})", 1))
    return raw.select(F.regexp_replace("path", r"\.meta$", "").alias("path"), guid.alias("guid")).filter("guid != ''")
