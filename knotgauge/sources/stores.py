"""Cache tables (u03, s13, k09-k11): entries in Parquet under any path that Spark reaches, a local folder or s3a:// alike."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.artifacts import latest_entries
from ..operators.compare import cache_state, evict_least_recent


class CacheTable:
    """Append-only; of several entries for a key the latest counts. `now` is always given, never read from a clock (u06).

    An entry goes by a row that says so: readers of older files see what they saw, and no file is
    rewritten while one reads it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.fields = [f.split()[0] for f in schema.split(", ")]
        self.schema = f"key string, stored_at timestamp, gone boolean, {schema}"

    def _append(self, rows: DataFrame, now: dt.datetime, gone: bool) -> None:
        filled = rows.select("key", F.lit(now).cast("timestamp").alias("stored_at"), F.lit(gone).alias("gone"), *((F.col(f) if f in rows.columns else F.lit(None)).alias(f) for f in self.fields))
        self.spark.createDataFrame([], self.schema).unionByName(filled).write.mode("append").parquet(self.path)

    def put(self, rows: DataFrame, now: dt.datetime, size: str | None = None, limit: int | None = None) -> int:
        """Stores rows (key, ...). With a limit, of column `size` in all, entries stored longest ago go first until the new ones fit (k10);
        returns how many went. Rows that do not fit by themselves are not stored."""
        gone = 0
        if size and limit is not None:
            need = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
            if need > limit:
                return 0
            kept = self.latest().join(rows.select("key"), "key", "left_anti")
            entries = kept.select(F.lit(0).alias("cache"), F.col("key").alias("entry_id"), F.col("stored_at").alias("used_at"), F.coalesce(size, F.lit(0)).alias("n_bytes"))
            out = evict_least_recent(entries, limit, need).where("evicted").select(F.col("entry_id").alias("key"))
            gone = out.count()
            if gone:
                self._append(out, now, True)
        self._append(rows, now, False)
        return gone

    def latest(self) -> DataFrame:
        """(key, stored_at, ...) of the entries that count; a missing table has none (a missing key is a miss, s13)."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return latest_entries(rows, "gone").where("not gone").drop("gone")

    def get(self, key: str, size: str | None = None, most: int | None = None) -> dict | None:
        """One entry, or None; ValueError if it is larger than `most` (s13)."""
        found = self.latest().where(F.col("key") == key).first()
        if found is not None and size and most is not None and (found[size] or 0) > most:
            raise ValueError(f"entry {key} has more than {most} bytes")
        return found.asDict() if found is not None else None

    def probe(self, items: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
        """(hits with their entry and state, misses): only misses go to the provider (j12)."""
        state = cache_state(F.col("stored_at"), F.lit(now).cast("timestamp"))
        good = self.latest().withColumn("state", state).where("state <> 'miss'")
        return items.join(good, "key"), items.join(good, "key", "left_anti")
