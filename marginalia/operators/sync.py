"""Change detection, versioned state, and provenance of imported files."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """path and action of files on disk (path, hash, size, mtime_ns) against known ones: new, changed,
    touched (other time or size, same hash), unchanged or removed.  Repeated paths count once, the newest."""
    one = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("mtime_ns"), "hash"))).filter("n = 1").drop("n")
    a, b = one(listing).alias("a"), one(known).alias("b")
    j = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime_ns").eqNullSafe(F.col("b.mtime_ns"))
    action = F.when(F.col("b.path").isNull(), "new").when(F.col("a.path").isNull(), "removed").when(same, "unchanged").when(F.col("a.hash").eqNullSafe(F.col("b.hash")), "touched").otherwise("changed")
    return j.select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def merged(old: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The table after a sync: old rows that are neither rewritten nor gone, and the fresh ones."""
    drop = fresh.select(key).unionByName(gone.select(key)).distinct()
    return old.join(drop, key, "left_anti").unionByName(fresh)


def without_imported(sources: DataFrame, imported: DataFrame) -> DataFrame:
    """Source files (path) that no imported document (source_path) stands for."""
    return sources.join(imported.filter("source_path is not null").select(F.col("source_path").alias("path")), "path", "left_anti")


def orphans(imported: DataFrame, sources: DataFrame) -> DataFrame:
    """Imported documents whose source is gone."""
    return imported.join(sources.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def import_actions(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """target and action of converted files (target, source_hash, body_hash, error) against those on disk
    (target, source_hash, body_hash as recorded, disk_hash): new, update, unchanged, edited, error or
    orphan."""
    p, e = planned.alias("p"), existing.alias("e")
    j = p.join(e, F.col("p.target") == F.col("e.target"), "full_outer")
    action = (
        F.when(F.col("p.target").isNull(), "orphan").when(F.col("p.error").isNotNull(), "error").when(F.col("e.target").isNull(), "new")
        .when(~F.col("e.disk_hash").eqNullSafe(F.col("e.body_hash")), "edited").when(F.col("p.source_hash").eqNullSafe(F.col("e.source_hash")), "unchanged").otherwise("update")
    )
    return j.select(F.coalesce("p.target", "e.target").alias("target"), action.alias("action"))


class State:
    """Tables as versioned Parquet folders; a small pointer file names the version that readers see, and is
    replaced in one step.  The folder must be one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, identity: str = "1"):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity

    def _pointer(self) -> str:
        return f"{self.folder}/current.json"

    def current(self) -> dict | None:
        """The version in force; None if there is none or it was written with another identity."""
        at, fs = self._file_system()
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            v = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return v if v["identity"] == self.identity else None

    def read(self, table: str) -> DataFrame | None:
        v = self.current()
        return self.spark.read.parquet(f"{self.folder}/{v['tables'][table]}/{table}") if v and table in v["tables"] else None

    def commit(self, tables: dict[str, DataFrame]) -> str:
        """Writes the tables as a new version; those not given stay as they are."""
        version = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{version}/{name}")
        known = (self.current() or {"tables": {}})["tables"]
        text = json.dumps({"version": version, "identity": self.identity, "tables": known | dict.fromkeys(tables, version), "at": time.time()})
        self._replace(text)
        return version

    def _file_system(self):
        """The folder's file system, whatever its scheme."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._pointer())
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _replace(self, text: str) -> None:
        at, fs = self._file_system()
        fs.mkdirs(at.getParent())
        new = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._pointer()}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(new, at):  # some file systems don't rename over a file
            fs.delete(at, False)
            if not fs.rename(new, at):
                raise OSError(f"can't replace {self._pointer()}")


class Claims:
    """Leases of batches: a claim older than its time is free again."""

    def __init__(self, seconds: int = 1800):
        self.seconds, self.held = seconds, {}

    def next(self, batches: list[int], answered: set[int], now: float) -> int | None:
        for b in batches:
            if b not in answered and now - self.held.get(b, float("-inf")) >= self.seconds:
                self.held[b] = now
                return b
        return None
