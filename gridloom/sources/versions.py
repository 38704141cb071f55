"""A keyed log that is read as its latest rows: a base in buckets, deltas beside it, and numbered manifests that say which files count."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.shared import drop_path

#: Column of the bucket, and how often a writer that others overtake tries again.
BUCKET, TRIES = "__bucket", 50


class Conflict(RuntimeError):
    """Another writer changed what this one had read."""


class VersionedLog:
    """Entries (the keys, ``updated_at``, ``event_id`` and any others) under ``root``, a folder that all executors share.

    An append writes its rows first and then a manifest, which makes them known at once or not at all; a reader sees the files of one manifest. Two writers race for a manifest's number: who
    finds it taken reads the newer one and tries again, so no entry is lost. Where names can't be taken exclusively (object stores without it) one writer at a time is allowed.
    ``compact`` folds the deltas into the base, and rewrites those buckets only that the deltas touch. Rows fold to the last by (updated_at, event_id) for each key, with
    the time of the key's first entry as ``created_at``; folding folded rows changes nothing, so the state is that of the whole log. Keys may be null, and null is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("cell_id", "run_id"), buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.root = root.rstrip("/") if "://" in root or root.startswith("file:/") else "file://" + os.path.abspath(root)

    # -- files -------------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._hadoop(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the newest without one; empty before the first."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "base": {}, "deltas": []}
        if (version or known[-1]) not in known:
            raise KeyError(version)
        path = f"{self.root}/versions/{version or known[-1]:09d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first().value)

    def _publish(self, manifest: dict) -> bool:
        """Write a manifest under its number unless that is taken. It is whole before it has its name."""
        name = f"{self.root}/versions/{manifest['version']:09d}.json"
        draft, fs = self._hadoop(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if name.startswith("file:"):
                os.link(draft.toUri().getPath(), self._hadoop(name)[0].toUri().getPath())
                return True
            rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(rename, 1)
            none[0] = getattr(rename, "NONE")
            context.rename(draft, self._hadoop(name)[0], none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _commit(self, change: Callable[[dict], dict]) -> int:
        for _ in range(TRIES):
            now = self.manifest()
            new = change(dict(now)) | {"version": now["version"] + 1}
            if self._publish(new):
                return new["version"]
        raise Conflict(f"{TRIES} times another writer was first")

    # -- rows --------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows written by bucket: the bucket's number and its folder, for the buckets that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        key = F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.manifest()["buckets"])).cast("int")
        placed = rows.withColumn(BUCKET, key)
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(BUCKET)}

    def fold(self, rows: DataFrame) -> DataFrame:
        """The last entry of each key, with the time of its first; aggregated map-side."""
        order = [c for c in rows.columns if c not in (*self.keys, "created_at")]
        last = F.max_by(F.struct(*order), F.struct("updated_at", "event_id"))
        return rows.groupBy(*self.keys).agg(last.alias("last"), F.min("created_at").alias("created_at")).select(*self.keys, "last.*", "created_at")

    def append(self, entries: DataFrame) -> int:
        """Add entries, folded already; the version that holds them. A frame without rows makes none."""
        buckets = self.manifest()["buckets"]
        found = self._write(self.fold(entries.withColumn("created_at", F.col("updated_at"))))
        if not found:
            return self.manifest()["version"]

        def change(now: dict) -> dict:
            if now["buckets"] != buckets:
                raise Conflict("another writer began the log with another number of buckets")
            return now | {"deltas": [*now["deltas"], found]}

        return self._commit(change)

    def _rows(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The state at a version, the newest without one; None if nothing was ever written. Buckets that no delta touches are read as they are."""
        m = self.manifest(version)
        touched = {b for d in m["deltas"] for b in d}
        still = self._rows([f for b, f in m["base"].items() if b not in touched])
        moving = self._rows([f for b, f in m["base"].items() if b in touched] + [f for d in m["deltas"] for f in d.values()])
        parts = [p for p in (still, moving and self.fold(moving)) if p is not None]
        return parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else parts[0] if parts else None

    def compact(self) -> int:
        """Fold the deltas into the buckets they touch. Entries that arrive meanwhile stay deltas; of two compactions the second gives way with Conflict."""
        m = self.manifest()
        if not m["deltas"]:
            return m["version"]
        touched = {b for d in m["deltas"] for b in d}
        rows = self._rows([f for b, f in m["base"].items() if b in touched] + [f for d in m["deltas"] for f in d.values()])
        found = self._write(self.fold(rows))

        def change(now: dict) -> dict:
            if now["base"] != m["base"] or now["deltas"][: len(m["deltas"])] != m["deltas"]:
                raise Conflict("the base has changed since it was read")
            return now | {"base": now["base"] | found, "deltas": now["deltas"][len(m["deltas"]) :]}

        return self._commit(change)

    def vacuum(self, keep: int = 10) -> int:
        """Drop all but the newest ``keep`` versions and the folders that only those name; rows of appends under way are named nowhere yet and stay. The number of versions dropped."""
        known = self.versions()
        old, kept = known[: -max(keep, 1)], known[-max(keep, 1) :]
        named = lambda vs: {f for v in vs for m in [self.manifest(v)] for f in (*m["base"].values(), *(f for d in m["deltas"] for f in d.values()))}
        for folder in named(old) - named(kept):
            drop_path(self.spark, f"{self.root}/{folder}")
        for v in old:
            drop_path(self.spark, f"{self.root}/versions/{v:09d}.json")
        return len(old)
