"""Sharding by size-tiered compaction, with DataFrame functions only.

A store is a folder: data/ holds immutable Parquet shards, a folder for each generation (an
arrival or a round of merges), manifest/ a table of the shards that make up a version. Arrivals
are appended as small shards. Compaction groups shards into tiers of similar size, cuts each tier
into runs of about the target size and rewrites runs as one shard each; a shard over the target
is split.

A version exists once its marker vNNNNNNNNNN does: a file that names the version's manifest
folder, written aside and put in place by one step that fails where the marker is there already
(a hard link on a local disk, a rename without overwriting elsewhere). So of two writers that
both start from one version, the second gets VersionConflict and must start again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, whole_rows

MANIFEST = "path string, n_rows long, n_bytes long, tier int"
#: Shards planned by one task, and paths that one merge job reads: what the driver holds at a time.
PLAN_ROWS, JOB_PATHS = 100_000, 20_000


class VersionConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fan_in: int = 4, least_bytes: int = 64 << 10):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- versions

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(f"{self.root}/manifest") if n.startswith("v"))

    def _marker(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:010d}"

    def _folder(self, version: int) -> str:
        """The manifest folder that a version's marker names."""
        stream = self._fs.open(self._path(self._marker(version)))
        try:
            return f"{self.root}/manifest/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._folder(known[-1] if version is None else version))

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes `shards` version `version`, or raises VersionConflict and leaves nothing behind."""
        name = f"t{uuid.uuid4().hex}"
        folder, aside = f"{self.root}/manifest/{name}", f"{self.root}/manifest/.{name}"
        shards.select("path", "n_rows", "n_bytes", "tier").write.parquet(folder)
        stream = self._fs.create(self._path(aside), False)
        stream.write(name.encode())
        stream.close()
        if not self._place(aside, self._marker(version)):
            self._fs.delete(self._path(aside), False)
            self._fs.delete(self._path(folder), True)
            raise VersionConflict(f"version {version} exists")
        return version

    def _place(self, aside: str, marker: str) -> bool:
        """Moves a file to where none may be yet; False if one is."""
        source, place = (self._fs.makeQualified(self._path(p)) for p in (aside, marker))
        if place.toUri().getScheme() == "file":  # the local file system's rename would overwrite
            try:
                os.link(source.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(source, False)
            return True
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(source, place, options)
        except Exception:
            if self._fs.exists(place):
                return False
            raise
        return True

    # -- shards

    def tier(self, n_bytes: Column) -> Column:
        """0 up to least_bytes, then one more for each factor fan_in."""
        return F.greatest(F.lit(0), F.ceil(F.log(float(self.fan_in), F.greatest(n_bytes, F.lit(1)) / F.lit(float(self.least_bytes))))).cast("int")

    def _generation(self, version: int) -> str:
        return f"{self.root}/data/{version:010d}-{uuid.uuid4().hex}"

    def _written(self, folder: str) -> DataFrame:
        names = self._names(folder)
        if not any("=" in n or not n.startswith(("_", ".")) for n in names):
            return self.spark.createDataFrame([], MANIFEST)
        read = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        meta = read.metadataColumn("_metadata")
        files = read.select(meta["file_path"].alias("path"), meta["file_size"].alias("n_bytes"))
        return files.groupBy("path").agg(F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes")).withColumn("tier", self.tier(F.col("n_bytes")))

    def append(self, docs: DataFrame, rows_per_shard: int = 512) -> int:
        """Arrivals, as they lie, as small immutable shards; then a version with them. Very long rows can make a shard of
        that many rows larger than the target: compact() splits it."""
        version = (self.versions() or [0])[-1] + 1
        folder = self._generation(version)
        docs.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(folder)
        return self.commit(self.manifest().unionByName(self._written(folder)), version)

    def plan(self) -> DataFrame:
        """(path, run, pieces) of the shards to rewrite: runs of at least fan_in shards of one tier, of at most target_bytes,
        to be merged into one piece; shards over the target, of two rows or more, to be cut into pieces."""
        shards = self.manifest().withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(1 << 20)))
        small = shards.where(F.col("n_bytes") * 2 <= self.target_bytes)
        # a tier of very many shards is planned in parts, so that no task sorts them all
        parts = small.groupBy("tier").agg(F.ceil(F.count("*") / PLAN_ROWS).alias("_parts"), F.max("n_bytes").alias("_most"))
        small = small.join(F.broadcast(parts), "tier").withColumn("_part", F.col("_salt") % F.col("_parts"))
        part = Window.partitionBy("tier", "_part")
        before = F.coalesce(F.sum("n_bytes").over(part.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # an eighth is left free, so that a merged shard that compresses worse than its parts is not cut again
        room = F.greatest(F.lit(self.target_bytes * 7 // 8) - F.col("_most"), F.lit(1))
        cut = small.withColumn("run", F.concat_ws("-", F.lit("merge"), "tier", "_part", F.floor(before / room)))
        runs = cut.withColumn("_n", F.count("*").over(Window.partitionBy("run"))).where(F.col("_n") >= self.fan_in).select("path", "run", F.lit(1).cast("long").alias("pieces"))
        large = shards.where(f"n_bytes > {self.target_bytes} and n_rows > 1")
        pieces = F.least(F.ceil(F.col("n_bytes") / self.target_bytes) + 1, F.col("n_rows")).cast("long")
        return runs.unionByName(large.select("path", F.concat(F.lit("cut-"), F.md5("path")).alias("run"), pieces.alias("pieces")))

    def _jobs(self, planned: DataFrame) -> Iterator[list]:
        """The plan in lists of whole runs, of JOB_PATHS paths or one run."""
        rows: list = []
        for r in planned.orderBy("run").toLocalIterator():
            if len(rows) >= JOB_PATHS and r.run != rows[-1].run:
                yield rows
                rows = []
            rows.append(r)
        if rows:
            yield rows

    def compact(self, most_rounds: int = 64) -> int:
        """Rewrites until no tier has a run to merge and no shard is too large; each round is a version. Returns the last version.

        RuntimeError if most_rounds rounds leave work: each takes fan_in times fewer shards, so they don't.
        """
        for _ in range(most_rounds):
            version = (self.versions() or [0])[-1] + 1
            aside = f"{self.root}/plan-{uuid.uuid4().hex}"
            self.plan().write.parquet(aside)
            planned = self.spark.read.schema("path string, run string, pieces long").parquet(aside)
            after, before, worked = self.manifest().join(planned, "path", "left_anti"), self.manifest(), False
            for job in self._jobs(planned):
                worked, folder = True, self._generation(version)
                self._rewrite(job, folder)
                after = after.unionByName(self._written(folder))
            if worked:
                if before.agg(F.sum("n_rows")).first() != after.agg(F.sum("n_rows")).first():
                    raise RuntimeError("a merge lost or repeated rows; the version is not committed")
                self.commit(after, version)
            self._fs.delete(self._path(aside), True)
            if not worked:
                return version - 1
        raise RuntimeError(f"shards are left to merge after {most_rounds} rounds")

    def _rewrite(self, job: list, folder: str) -> None:
        """Writes each run of the job as its pieces, a task for each; a piece is one shard."""
        names = {run: k for k, run in enumerate(sorted({r.run for r in job}))}
        steps = self.spark.createDataFrame([(r.path, names[r.run], r.pieces) for r in job], "path string, run long, pieces long")  # at most JOB_PATHS rows or one run: broadcast
        read = self.spark.read.parquet(*(r.path for r in job))
        rows = read.select(whole_rows(read).alias("row"), read.metadataColumn("_metadata")["file_path"].alias("path"), F.monotonically_increasing_id().alias("at"))
        run = free_name(read.columns, "_run")
        dealt = rows.join(F.broadcast(steps), "path").select("row.*", F.concat_ws("-", "run", F.col("at") % F.col("pieces")).alias(run))
        # eight partitions a piece: two pieces seldom meet in a task, and empty partitions cost nothing
        dealt.repartition(8 * sum({r.run: r.pieces for r in job}.values()), run).write.partitionBy(run).option("compression", "zstd").parquet(folder)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes shards and manifests of which none of the last `keep` versions knows; returns how many shards went.

        Generations without a live shard go as whole folders; of the others, dead shards go one by one.
        """
        known = self.versions()
        paths = lambda some: [self.manifest(v).select("path") for v in some]
        union = lambda frames: frames[0].unionByName(union(frames[1:])) if len(frames) > 1 else frames[0] if frames else self.spark.createDataFrame([], "path string")
        folder = F.regexp_extract("path", r"^(.*/data/[^/]*)/", 1).alias("folder")
        live = union(paths(known[-keep:])).distinct().select("path", folder)
        dead = union(paths(known[:-keep])).distinct().join(live, "path", "left_anti").select("path", folder)
        whole = dead.join(live.select("folder").distinct(), "folder", "left_anti").groupBy("folder").count()
        gone = 0
        for r in whole.toLocalIterator():
            gone += r["count"]
            self._fs.delete(self._path(r.folder), True)
        for r in dead.join(live.select("folder").distinct(), "folder", "left_semi").toLocalIterator():
            gone += self._fs.delete(self._path(r.path), False)
        for v in known[:-keep]:
            folder = self._folder(v)
            self._fs.delete(self._path(self._marker(v)), False)
            self._fs.delete(self._path(folder), True)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the path and the size of the shard that holds each: `_shard` and `_shard_bytes`,
        with underscores added where the rows have columns of these names. Spark's own file index holds one path a shard, as it
        does for any table of that many files."""
        read = self.spark.read.parquet(*(r.path for r in self.manifest(version).select("path").toLocalIterator()))
        meta = read.metadataColumn("_metadata")
        return read.select("*", meta["file_path"].alias(free_name(read.columns, "_shard")), meta["file_size"].alias(free_name(read.columns, "_shard_bytes")))


def compact_documents(docs: DataFrame, root: str, target_bytes: int = 64 << 20) -> DataFrame:
    """Appends docs, compacts, vacuums, and reads the last version: rows as they were, each in one shard.

    Nulls, empty and long texts, ties and repeated rows are stored like any other. Columns keep
    their names and values; `_shard` and `_shard_bytes` are added, with underscores added to them
    where docs have columns of these names. An empty table makes one empty shard or none, and no rows.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes)
    store.append(docs)
    store.compact()
    store.vacuum()
    if store.manifest().isEmpty():
        return docs.limit(0).select("*", F.lit("").alias(free_name(docs.columns, "_shard")), F.lit(0).cast("long").alias(free_name(docs.columns, "_shard_bytes")))
    return store.read()
