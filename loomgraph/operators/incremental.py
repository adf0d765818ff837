"""Processing only new or changed records, over an immutable versioned table.

``VersionedTable`` keeps a table as parquet data files plus one small JSON log
entry per version.  An entry is written once, under a name that only one writer
can take, and lists the data files that the version adds, removes or gives
another deletion vector; every tenth lists all of them.  The difference of two
versions gives the record delta without reading the files both have: added
files, removed files and grown deletion vectors.  The version that an output has
processed is saved in the output's own log, in the same atomic commit as its
rows and states, so a run that fails leaves no trace and the next run takes up
exactly what it should have.
"""

from __future__ import annotations

import json
import uuid

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_FILE = 2_000_000  # rows of one version that a task writes
FULL_EVERY = 10  # versions between two log entries that list all files
SEPARATE_READS = 16  # groups of files up to which a delta reads each group on its own


class ConflictError(Exception):
    """Another writer committed the version first."""


class VersionedTable:
    """A table of immutable files and versions below ``path`` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}  # versions never change
        self._schema: str | None = None

    def _at(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    # manifests -----------------------------------------------------------

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("_log")):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._at("_log")) if s.getPath().getName().endswith(".json"))

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"_log/{version:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def manifest(self, version: int) -> dict:
        """``files``: data file -> deletion vector file or null; ``meta``: what the commit saved beside its rows.  Version -1 is the empty table."""
        if version < 0:
            return {"files": {}, "meta": {}, "schema": None}
        behind, at = [], version
        while at not in self._known:
            entry = self._entry(at)
            behind.append((at, entry))
            if "files" in entry:
                break
            at -= 1
            if at < 0:
                break
        for at, entry in reversed(behind):
            before = self._known.get(at - 1, {"files": {}, "schema": None})
            files = entry["files"] if "files" in entry else {f: dv for f, dv in {**before["files"], **entry["put"]}.items() if f not in set(entry["gone"])}
            self._known[at] = {"files": files, "meta": entry["meta"], "schema": entry.get("schema") or before["schema"]}
        for old in [v for v in self._known if v < version - 2 * FULL_EVERY]:
            del self._known[old]
        return self._known[version]

    def latest(self) -> int:
        return max(self.versions(), default=-1)

    def commit(self, files: dict[str, str | None], meta: dict | None = None, *, on: int | None = None) -> int:
        """Publish a version with exactly these files, after version ``on`` (default: the latest).

        Raises ConflictError if that successor exists already.
        """
        version = (self.latest() if on is None else on) + 1
        self._fs.mkdirs(self._at("_log"))
        temp, final = self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/{version:012d}.json")
        entry: dict = {"meta": meta or {}, "schema": self._schema}
        if version % FULL_EVERY == 0:
            entry["files"] = files
        else:
            before = self.manifest(version - 1)["files"]
            entry["put"] = {f: dv for f, dv in files.items() if f not in before or before[f] != dv}
            entry["gone"] = [f for f in before if f not in files]
        out = self._fs.create(temp, False)
        out.write(json.dumps(entry).encode())
        out.close()
        # a rename never replaces a file, so one writer wins
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise ConflictError(f"version {version} of {self.path} was committed by another writer")
        return version

    # data files ----------------------------------------------------------

    def write_files(self, df: DataFrame, *, split: str | None = None) -> dict[str, list[str]]:
        """Write data files that no version holds yet; with ``split`` by the value of that column, which is not stored."""
        rel = f"data/{uuid.uuid4().hex}"
        self._schema = StructType([f for f in df.schema.fields if f.name != split]).json()
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(split) if split else writer).parquet(f"{self.path}/{rel}")
        found: dict[str, list[str]] = {}
        files = self._fs.listFiles(self._at(rel), True)
        while files.hasNext():
            p = files.next().getPath().toString()
            if p.endswith(".parquet"):
                tail = p[p.index(rel) :]
                value = next((x.split("=", 1)[1] for x in tail.split("/") if split and x.startswith(f"{split}=")), "")
                found.setdefault(value, []).append(tail)
        return found

    def append(self, df: DataFrame, meta: dict | None = None) -> int:
        now = self.latest()
        files = [f for group in self.write_files(df).values() for f in group]
        return self.commit({**self.manifest(now)["files"], **dict.fromkeys(files)}, meta, on=now)

    def delete_where(self, condition: str, meta: dict | None = None) -> int:
        """Delete rows by deletion vectors; the data files stay as they are."""
        now = self.latest()
        files = dict(self.manifest(now)["files"])
        rel = f"dv/{uuid.uuid4().hex}"
        gone = self._rows(files).filter(condition).select("_file", "_pos")
        old = self._vectors(files)
        (gone.union(old) if old is not None else gone).distinct().write.parquet(f"{self.path}/{rel}")
        hit = {r["_file"] for r in self.spark.read.parquet(f"{self.path}/{rel}").select("_file").distinct().collect()}  # a row per data file
        return self.commit({f: rel if f in hit else dv for f, dv in files.items()}, meta, on=now)

    def _vectors(self, files: dict[str, str | None]) -> DataFrame | None:
        rels = sorted({dv for dv in files.values() if dv})
        if not rels:
            return None
        pairs = self.spark.createDataFrame([(f, dv) for f, dv in files.items() if dv], "_file string, _dv string")
        read = self.spark.read.parquet(*[f"{self.path}/{r}" for r in rels]).withColumn("_dv", F.regexp_extract(F.col("_metadata.file_path"), r"(dv/[0-9a-f]+)/", 1))
        return read.join(pairs, ["_file", "_dv"]).select("_file", "_pos")

    def _open(self, files: list[str], schema: str | None) -> DataFrame:
        """Data files with the schema of their table, so that none is opened to find it."""
        reader = self.spark.read
        if schema:
            reader = reader.schema(StructType.fromJson(json.loads(schema)))
        return reader.parquet(*[f"{self.path}/{f}" for f in files])

    def _rows(self, files: dict[str, str | None], schema: str | None = None) -> DataFrame:
        """Live rows with their file and position."""
        if not files:
            raise ValueError("the version holds no files")
        read = self._open(list(files), schema)
        rows = read.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]+/.*)$", 1)).withColumn("_pos", F.col("_metadata.row_index"))
        gone = self._vectors(files)
        return rows if gone is None else rows.join(gone, ["_file", "_pos"], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(self.latest() if version is None else version)
        if any(held["files"].values()):
            return self._rows(held["files"], held["schema"]).drop("_file", "_pos")
        if not held["files"] and held["schema"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(held["schema"])))
        if not held["files"]:
            raise ValueError("the version holds no files")
        return self._open(list(held["files"]), held["schema"])

    # deltas --------------------------------------------------------------

    def changes(self, after: int, to: int | None = None) -> DataFrame | None:
        """Record deltas of all versions in (after, to]: the rows with ``_version`` and ``_op`` (``add``/``remove``).

        Only manifests are compared on the driver; what is read is the added
        and removed files and those whose deletion vector changed.  None if
        nothing changed.
        """
        to = self.latest() if to is None else to
        added: list[tuple] = []  # file, version, op, vector whose rows don't count, vector whose rows count or None for all
        before = self.manifest(after)["files"]
        for v in (x for x in self.versions() if after < x <= to):
            files = self.manifest(v)["files"]
            added += [(f, v, "add", dv, None) for f, dv in files.items() if f not in before]
            added += [(f, v, "remove", dv, None) for f, dv in before.items() if f not in files]
            added += [(f, v, "remove", before[f], dv) for f, dv in files.items() if f in before and dv != before[f]]
            before = files
        if not added:
            return None
        held = self.manifest(to)["schema"]
        groups: dict[tuple, list[str]] = {}
        for f, *how in added:
            groups.setdefault(tuple(how), []).append(f)
        if len(groups) <= SEPARATE_READS and all(how[2:] == (None, None) for how in groups):
            # a run's usual delta: whole files of few versions, told apart without a join
            return reduce(DataFrame.unionByName, [self._open(files, held).withColumns({"_version": F.lit(v), "_op": F.lit(op)}) for (v, op, _, _), files in groups.items()])
        schema = "_file string, _version int, _op string, _without string, _only string"
        plan = self.spark.createDataFrame(added, schema)
        read = self._open(sorted({x[0] for x in added}), held).withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]+/.*)$", 1)).withColumn("_pos", F.col("_metadata.row_index"))
        rows = read.join(plan, "_file")
        rels = sorted({dv for x in added for dv in x[3:] if dv})
        if rels:
            vectors = self.spark.read.parquet(*[f"{self.path}/{r}" for r in rels]).withColumn("_dv", F.regexp_extract(F.col("_metadata.file_path"), r"(dv/[0-9a-f]+)/", 1)).select("_file", "_pos", "_dv")
            rows = rows.join(vectors.withColumnRenamed("_dv", "_without"), ["_file", "_pos", "_without"], "left_anti")
            listed = rows.filter("_only is not null").join(vectors.withColumnRenamed("_dv", "_only"), ["_file", "_pos", "_only"], "left_semi")
            rows = rows.filter("_only is null").unionByName(listed)
        return rows.drop("_file", "_pos", "_without", "_only")


def process_new(source: VersionedTable, output: VersionedTable, transform, *, upto: int | None = None) -> int | None:
    """Run ``transform(delta, held) -> DataFrame`` on what the output has not processed yet, and commit its rows.

    ``held`` are the rows of the output so far, None if it has none.  The
    processed version is read from and saved in the output's log, so rows and
    progress become visible together or not at all.  Returns the version
    committed to the output; None if there was nothing to do.
    """
    now = output.latest()
    before = output.manifest(now)
    done = before["meta"].get("processed", -1)
    upto = source.latest() if upto is None else upto
    if upto <= done:
        return None
    delta = source.changes(done, upto)
    held = output.read(now) if before["files"] else None
    new = output.write_files(transform(delta, held)) if delta is not None else {}
    return output.commit({**before["files"], **{f: None for group in new.values() for f in group}}, {"processed": upto}, on=now)


def versions_by_cutoff(spark: SparkSession, path: str, rows: DataFrame, arrived: str, cutoffs: list, *, rows_per_file: int = ROWS_PER_FILE) -> VersionedTable:
    """Lay ``rows`` out as a table with one version per cutoff: version i holds what arrived by ``cutoffs[i]``.

    Rows that arrived after the last cutoff, or at an unknown time, belong to no
    version.  ``cutoffs`` is sorted; its length is that of a run log.  A version
    of n rows is written by about n / ``rows_per_file`` tasks.
    """
    log = VersionedTable(spark, path)
    known = F.array(*[F.lit(c).cast("timestamp_ntz" if dict(rows.dtypes)[arrived] == "timestamp_ntz" else "timestamp") for c in cutoffs])
    stamped = rows.filter(F.col(arrived).isNotNull()).withColumn("_at", F.size(F.filter(known, lambda c: c < F.col(arrived)))).filter(F.col("_at") < len(cutoffs))
    sizes = dict(stamped.groupBy("_at").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per version
    tasks = F.element_at(F.array(*[F.lit(-(-sizes.get(i, 1) // rows_per_file)) for i in range(len(cutoffs))]), F.col("_at") + 1)
    spread = stamped.repartition(F.col("_at"), F.pmod(F.xxhash64(*[c for c in rows.columns if c != arrived]), tasks))
    groups = log.write_files(spread, split="_at")
    files: dict[str, str | None] = {}
    for i in range(len(cutoffs)):
        files = {**files, **dict.fromkeys(groups.get(str(i), []))}
        log.commit(files, {"cutoff": str(cutoffs[i])}, on=i - 1)
    return log


def changed_keys(delta: DataFrame, held: DataFrame | None = None, *, key: list[str], state: str, order: list[str], version: int | None = None) -> DataFrame:
    """States of keys that are new as of a version: ``_version, key..., order..., state, changed``.

    ``delta`` are added rows with ``_version``; the state of a key as of a
    version is that of its greatest row by ``order`` up to then, rows without a
    state (null) not counting.  ``held`` is what this function returned for all
    versions before the delta: the greatest row of a key in it is the key's
    state there, so a delta is told from any version on.  ``changed``: the state
    differs from that as of the version before, or is the key's first; rows
    with the same state but a greater ``order`` are not.

    Rows are first reduced to one per (key, version), so the window holds at
    most one row per version whatever the row count, and only held keys that are
    in the delta count.  ``version``: the delta's only one, if that is known,
    which saves the window.  Null key parts are values like any other; repeated
    rows change nothing; ties in ``order`` go to the greatest state.
    """
    row = F.struct(*[F.col(c) for c in order], F.col(state).alias("_state"))
    rows = delta.filter(F.col(state).isNotNull()).select(*key, "_version", row.alias("best"), F.lit(True).alias("_new"))
    if held is not None:
        touched = rows.select(*[F.col(k).alias(f"_k_{k}") for k in key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
        last = held.join(touched, same, "left_semi").select(*key, "_version", row.alias("best"), F.lit(False).alias("_new"))
        rows = rows.unionByName(last if version is not None else last.groupBy(*key, "_new").agg(F.max("best").alias("best"), F.max("_version").alias("_version")))
    if version is not None:
        both = rows.groupBy(*key).agg(F.max(F.when(F.col("_new"), F.col("best"))).alias("now"), F.max(F.when(~F.col("_new"), F.col("best"))).alias("before"))
        fresh = both.filter("now is not null and (before is null or now > before)").withColumn("_version", F.lit(version))
    else:
        seen = rows.groupBy(*key, "_version", "_new").agg(F.max("best").alias("best"))
        w = Window.partitionBy(*key).orderBy("_new", "_version")
        running = seen.withColumn("now", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("now").over(w))
        fresh = running.filter("_new and (before is null or before != now)")
    changed = F.col("before").isNull() | (F.col("before._state") != F.col("now._state"))
    return fresh.select("_version", *key, *[F.col(f"now.{c}").alias(c) for c in order], F.col("now._state").alias(state), changed.alias("changed"))


def take_up(source: VersionedTable, output: VersionedTable, *, key: list[str], state: str, order: list[str], upto: int | None = None) -> int | None:
    """One run over a log of observations: the states of keys that the versions since the last run bring, see ``changed_keys``, are committed to ``output``.

    The output holds the states as of the processed version, so the run reads its
    own delta and the states of the keys in it, whatever the log holds.  Rows
    removed from the log don't undo a state.
    """

    done = output.manifest(output.latest())["meta"].get("processed", -1)
    upto = source.latest() if upto is None else upto

    def transform(delta: DataFrame, held: DataFrame | None) -> DataFrame:
        return changed_keys(delta.filter("_op = 'add'"), held, key=key, state=state, order=order, version=upto if upto == done + 1 else None)

    return process_new(source, output, transform, upto=upto)
