"""Names of graph stores, kept as one small file per change, and background runs."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

# Fixed value: what a store may be called.
SAFE_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


class Registry:
    """``name -> {path, description, created}`` below a folder of any Hadoop file system; the last writer of a name wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    def register(self, name: str, path: str, description: str = "") -> dict:
        """Add or change a name; ``created`` stays that of the first registration."""
        if not SAFE_NAME.fullmatch(name):
            raise ValueError(f"not a safe name: {name!r}")
        old = self.get(name) or {}
        entry = {"path": path or old.get("path", ""), "description": description or old.get("description", ""), "created": old.get("created") or datetime.now(timezone.utc).isoformat(timespec="seconds")}
        temp = self._at(f".{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(json.dumps(entry).encode())
        out.close()
        # each change has a name of its own, so a crash leaves the entry before it
        past = self._changes(name)
        if not self._fs.rename(temp, self._at(f"{name}.{len(past) and past[-1] + 1:012d}.json")):
            self._fs.delete(temp, False)
            raise RuntimeError(f"{name} was registered by another writer")
        for old_change in past:
            self._fs.delete(self._at(f"{name}.{old_change:012d}.json"), False)
        return entry

    def _changes(self, name: str) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._at("")))
        return sorted(int(f[len(name) + 1 : -5]) for f in found if re.fullmatch(re.escape(name) + r"\.\d{12}\.json", f))

    def get(self, name: str) -> dict | None:
        past = self._changes(name) if SAFE_NAME.fullmatch(name) else []
        if not past:
            return None
        stream = self._fs.open(self._at(f"{name}.{past[-1]:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def list(self) -> dict[str, dict]:
        if not self._fs.exists(self._at("")):
            return {}
        names = sorted({s.getPath().getName().rsplit(".", 2)[0] for s in self._fs.listStatus(self._at("")) if s.getPath().getName().endswith(".json")})
        return {n: self.get(n) for n in names}

    def remove(self, name: str) -> bool:
        past = self._changes(name) if SAFE_NAME.fullmatch(name) else []
        return bool([self._fs.delete(self._at(f"{name}.{c:012d}.json"), False) for c in past])

    def resolve(self, name_or_path: str) -> str:
        """The path of a registered name whose folder is still there, else the argument itself."""
        entry = self.get(name_or_path)
        if entry and self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(entry["path"])):
            return entry["path"]
        return name_or_path


class BackgroundRun:
    """A function on a thread of its own, whose Spark jobs can be counted and cancelled together."""

    def __init__(self, spark: SparkSession, work: Callable[[], object], description: str = "") -> None:
        self.spark, self.group, self.result, self.error = spark, uuid.uuid4().hex, None, None

        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, description, interruptOnCancel=True)
            try:
                self.result = work()
            except Exception as ex:  # noqa: BLE001 - kept for whoever asks
                self.error = ex

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def status(self) -> dict:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.group)
        running = [j for j in jobs if (info := tracker.getJobInfo(j)) and info.status == "RUNNING"]
        state = "running" if self._thread.is_alive() else "failed" if self.error else "completed"
        return {"state": state, "jobs": len(jobs), "running": len(running), "error": str(self.error)[:200] if self.error else ""}

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> object:
        self._thread.join(timeout)
        if self.error:
            raise self.error
        return self.result
