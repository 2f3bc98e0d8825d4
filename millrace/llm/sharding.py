"""A shard store with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards (Parquet files).  Compaction
groups shards of one size tier (powers of ``fanout``) and merges runs of them
into files of about the target size.  Every change commits a new manifest
version: the shard list is written aside as Parquet and renamed to its
version number; the rename fails if that version exists, so of two writers one
wins and the other retries on top.  Readers use the shards of one manifest
only, so they never see half a change.

A merge reads a run's files in one task and writes one file: no shuffle, and
a task's data is bounded by the target size.  Failed tasks and lost executors
are retried by Spark; files not named by a manifest are garbage.  Nulls, empty
texts, repeated rows and any columns pass through unchanged; an arrival
without rows commits a version too.  The driver holds the names of
one version's shards at a time, about 100 bytes each: 80 MB for 100 TB in
files of 128 MB.
"""

from __future__ import annotations

import math
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "shard string, bytes long, seq long, tier int, version long"
#: Runs merged by one Spark job.
RUNS_A_JOB = 64


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, base_bytes: int = 1 << 20):
        if fanout < 2 or target_bytes < 1 or base_bytes < 1:
            raise ValueError("fanout must be 2 or more, sizes positive")
        self.spark, self.root, self.target, self.fanout, self.base = spark, root.rstrip("/"), target_bytes, fanout, base_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # -- manifests

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        top = self._path(f"{self.root}/manifests")
        if not self._fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        if not self._fs.exists(self._path(self._manifest(v))):
            raise ValueError(f"there is no version {v}, or no more")
        return self.spark.read.schema(MANIFEST).parquet(self._manifest(v))

    def _manifest(self, v: int) -> str:
        return f"{self.root}/manifests/v{v:09d}"

    def commit(self, shards: DataFrame, on: int) -> int:
        """Make ``shards`` the version after ``on``, all or nothing."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        new = on + 1
        shards.withColumn("version", F.lit(new).cast("long")).select("shard", "bytes", "seq", "tier", "version").coalesce(1).write.parquet(aside)
        top = self._path(f"{self.root}/manifests")
        self._fs.mkdirs(top)
        final = self._path(self._manifest(new))
        try:
            self._context.rename(self._path(aside), final, self._plain)  # never replaces
        except Py4JJavaError as e:
            if "already exists" not in str(e.java_exception) and not self._fs.exists(final):
                raise
            self._fs.delete(self._path(aside), True)
            raise CommitConflict(f"version {new} exists") from None
        return new

    # -- writing

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Data files below a folder of ours with their sizes, in the order of their names."""
        found, at = [], self._fs.listFiles(self._path(folder), True)
        while at.hasNext():
            s = at.next()
            if s.getPath().getName().startswith("part-") and s.getLen():
                found.append((s.getPath().toString(), s.getLen()))
        return sorted(found)

    def _tier(self):
        steps = F.ln(F.col("bytes") / F.lit(self.base)) / F.lit(math.log(self.fanout))
        return F.greatest(F.lit(0), F.floor(steps) + 1).cast("int")

    def _listed(self, rows: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "shard string, bytes long, seq long").withColumn("tier", self._tier())

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as shards and commit them."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(folder)
        return self._add([folder])

    def append_each(self, rows: DataFrame, arrival_col: str) -> int:
        """Append all arrivals in ``rows``, each as shards of its own in their order, in one pass and one version."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy(arrival_col).parquet(folder)
        top = self._path(folder)
        names = sorted(s.getPath().toString() for s in self._fs.listStatus(top) if s.isDirectory())
        return self._add(names or [folder])

    def _add(self, folders: list[str]) -> int:
        files = [self._files(folder) for folder in folders]
        while True:
            v = self.version()
            new = [(name, size, v + 1 + k) for k, listed in enumerate(files) for name, size in listed]
            try:
                return self.commit(self.manifest(v).select("shard", "bytes", "seq", "tier").unionByName(self._listed(new)), v)
            except CommitConflict:
                continue

    # -- compaction

    def runs(self, version: int) -> DataFrame:
        """``(tier, run, shards)``: runs of two or more shards of a tier that fill a target-sized file."""
        small = self.manifest(version).where(F.col("bytes") < self.target)
        before = Window.partitionBy("tier").orderBy("seq", "shard").rowsBetween(Window.unboundedPreceding, -1)
        run = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / self.target)
        packed = small.withColumn("run", run).groupBy("tier", "run").agg(F.array_sort(F.collect_list("shard")).alias("shards"), F.min("seq").alias("seq"), F.sum("bytes").alias("bytes"))
        return packed.where((F.size("shards") >= self.fanout) | ((F.size("shards") > 1) & (F.col("bytes") >= self.target)))

    def compact(self, schema) -> int:
        """Merge until no tier has a full run; returns the version reached."""
        while True:
            v = self.version()
            runs = self.runs(v).select("shards", "seq").orderBy("seq").collect()  # names only
            if not runs:
                return v
            gone, made = [], []
            for k in range(0, len(runs), RUNS_A_JOB):
                some = runs[k : k + RUNS_A_JOB]
                merged = reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(*r["shards"]).coalesce(1) for r in some])
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                merged.write.option("compression", "zstd").parquet(folder)
                gone += [s for r in some for s in r["shards"]]
                made += self._files(folder)
            try:
                old = self.manifest(v).select("shard", "bytes", "seq", "tier")
                dropped = self.spark.createDataFrame([(s,) for s in gone], "shard string")
                self.commit(old.join(dropped, "shard", "left_anti").unionByName(self._listed([(f, n, v + 1) for f, n in made])), v)
            except CommitConflict:
                continue

    def vacuum(self, keep_versions: int = 10, grace_seconds: float = 7 * 86_400) -> None:
        """Delete old manifests, and data files that none of the last ``keep_versions`` names.

        Files younger than ``grace_seconds`` stay: a writer may have written
        but not yet committed them.
        """
        if keep_versions < 1 or grace_seconds < 0:
            raise ValueError("keep_versions must be positive, grace_seconds not negative")
        before = time.time() - grace_seconds
        last = self.version()
        live: set[str] = set()
        for v in range(max(1, last - keep_versions + 1), last + 1):
            if self._fs.exists(self._path(self._manifest(v))):
                live.update(r["shard"] for r in self.manifest(v).select("shard").toLocalIterator())
        for v in range(last - keep_versions, 0, -1):  # first, so that no version names what is gone
            if not self._fs.delete(self._path(self._manifest(v)), True):
                break
        data = self._path(f"{self.root}/data")
        found = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        while found is not None and found.hasNext():
            s = found.next()
            if s.getModificationTime() < 1000 * before and s.getPath().toString() not in live:
                self._fs.delete(s.getPath(), False)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of one version."""
        names = [r["shard"] for r in self.manifest(version).select("shard").collect()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
