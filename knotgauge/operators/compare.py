"""Snapshot comparison: work items, cache probes, packing, worker results, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import coverage, delta
from .ranks import global_place
from .rules import supported

CATEGORIES = ("runtime", "tests", "tooling")
DAY = 86400


def items(inventories: DataFrame) -> DataFrame:
    """Scorable files of both sides, once per key, base first (e01, a26, j21)."""
    order = F.struct((F.col("side") != "base").alias("a"), F.col("path").alias("b"))
    return inventories.where("scorable").groupBy("key").agg(F.min_by("blob_id", order).alias("blob_id"), F.min_by("language", order).alias("language"), F.min_by("size", order).alias("size"), F.min_by("path", order).alias("display_path"))


def cache_state(stored_at: Column, now: Column, expiry_days: int = 30, refresh_days: int = 20) -> Column:
    """miss, refresh or hit (p13): younger than now, at most expiry_days old; refreshed when over refresh_days."""
    age = (now.cast("double") - stored_at.cast("double")) / DAY
    return F.when(stored_at.isNull() | (stored_at > now) | (age > expiry_days), "miss").when(age > refresh_days, "refresh").otherwise("hit")


def is_expired(used_at: Column, now: Column, days: int = 20) -> Column:
    """p14: an unknown time never expires."""
    return F.coalesce(now.cast("double") - used_at.cast("double") >= days * DAY, F.lit(False))


def admitted(source_bytes: Column, n_records: Column) -> Column:
    """p19: small enough to be cached."""
    return (source_bytes <= 16 << 20) & (n_records * 256 + source_bytes <= 64 << 20)


def evict_least_recent(entries: DataFrame, limit: int, need: int) -> DataFrame:
    """Entries (entry_id, used_at, n_bytes, group) with `evicted`: per cache, oldest use first until `need` more bytes fit under `limit` (w10)."""
    order = Window.partitionBy("cache").orderBy("used_at", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n_bytes").over(Window.partitionBy("cache"))
    freed = F.coalesce(F.sum("n_bytes").over(order), F.lit(0))
    return entries.withColumn("evicted", total - freed + need > limit)


def valid_result(fingerprint: Column) -> Column:
    """p15: provenance, finite and non-negative numbers, counts within their caps."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    counts = (F.col("token_count") >= 0) & (F.col("token_count") <= 1 << 30) & (F.col("high_entropy_tokens") >= 0) & (F.col("high_entropy_tokens") <= F.col("token_count"))
    return F.coalesce((F.col("fingerprint") == fingerprint) & finite("tree_score") & finite("entropy_sum") & counts & (F.col("total_comp_level") <= 1 << 53), F.lit(False))


def assign_longest_first(work: DataFrame, most_bins: int = 4) -> DataFrame:
    """Per group: items largest first (then key), each to the least loaded, lowest bin (i05, o05): group, bin, key, size.

    A group's items pass one task in order, which holds the bins' loads and nothing else; the number
    of bins is the least of most_bins and the group's items.
    """
    schema = work.select("group", F.lit(0).alias("bin"), "key", "size").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, load = object(), []
        for batch in batches:
            put = []
            for group, size, bins in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if group != at:
                    at, load = group, [0] * bins
                put.append(least := load.index(min(load)))
                load[least] += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(put, pa.int32()), batch.column(1), batch.column(2)], names=["group", "bin", "key", "size"])

    counts = work.groupBy("group").agg(F.least(F.lit(most_bins), F.count("*")).cast("int").alias("bins"))
    rows = work.join(counts, "group").select("group", "key", "size", "bins")
    return rows.repartition("group").sortWithinPartitions("group", F.col("size").desc(), "key").mapInArrow(run, schema)


def pack_longest_first(work: DataFrame, most_bins: int = 4) -> DataFrame:
    """The same as group, bin, keys, bytes."""
    return assign_longest_first(work, most_bins).groupBy("group", "bin").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.sum("size").alias("bytes"))


def key_mismatch(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """Keys expected but absent, and present but not expected, per worker (j13)."""
    both = expected.select(by, "key", F.lit(1).alias("_e")).join(actual.select(by, "key", F.lit(1).alias("_a")), [by, "key"], "full_outer")
    return both.groupBy(by).agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"))


def artifact_errors(artifacts: DataFrame, workers: DataFrame, fingerprint: str) -> DataFrame:
    """Each artifact's fault, the first that holds: foreign, unexpected, duplicate, failed; and workers without one: missing (j14, v06)."""
    order = Window.partitionBy("worker_id").orderBy("name")
    known = workers.select("worker_id", F.lit(True).alias("_known"))
    judged = artifacts.join(known, "worker_id", "left").withColumn("_n", F.row_number().over(order))
    fault = F.when(F.col("fingerprint") != fingerprint, "foreign").when(F.col("_known").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate").when(F.col("status") != "complete", "failed")
    gone = workers.join(artifacts.where(F.col("fingerprint") == fingerprint), "worker_id", "left_anti")
    return judged.select("worker_id", "name", fault.alias("fault")).unionByName(gone.select("worker_id", F.lit(None).cast("string").alias("name"), F.lit("missing").alias("fault")))


def measured(inventories: DataFrame, results: DataFrame) -> DataFrame:
    """Inventory rows with their result (j10) and whether they are supported and measured."""
    joined = inventories.join(results.drop("blob_id", "language"), "key", "left")
    return joined.withColumn("supported", supported()).withColumn("measured", F.col("tree_score").isNotNull())


def side_totals(rows: DataFrame) -> DataFrame:
    """Per side and category of the fixed three, and per side in all (category null): counts, bytes, coverage; scores only if every supported path is measured (a09, j15)."""
    size = F.coalesce("size", F.lit(0))
    sums = [F.count("path").alias("paths"), F.count_if("supported").alias("supported"), F.count_if("measured").alias("measured"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("supported"), size)), F.lit(0)).alias("supported_bytes"), F.coalesce(F.sum(F.when(F.col("measured"), size)), F.lit(0)).alias("measured_bytes"), F.sum("tree_score").alias("_cc"), F.sum("token_count").alias("_tokens")]
    sides = rows.select("side").distinct()
    domain = sides.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")))
    each = domain.join(rows, ["side", "category"], "left").groupBy("side", "category").agg(*sums)
    every = rows.groupBy("side").agg(*sums).withColumn("category", F.lit(None).cast("string"))
    whole = F.col("supported") == F.col("measured")
    out = each.unionByName(every.select(each.columns))
    return out.select("side", "category", "paths", "supported", "measured", "bytes", "supported_bytes", "measured_bytes", F.when(whole, F.coalesce("_cc", F.lit(0.0))).alias("tree_score"), F.when(whole, F.coalesce("_tokens", F.lit(0))).alias("tokens"), coverage(F.col("measured"), F.col("supported")).alias("coverage"), coverage(F.col("measured_bytes"), F.col("supported_bytes")).alias("byte_coverage"))


def side_deltas(totals: DataFrame) -> DataFrame:
    """category and {base, head, absolute, percent} of the score."""
    wide = totals.groupBy("category").pivot("side", ["base", "head"]).agg(F.first("tree_score"))
    return wide.select("category", delta(F.col("base"), F.col("head")).alias("d")).select("category", "d.*")


def changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """status, old_path, new_path by comparing two listings (path, blob_id) (j09, s06): a deletion and an addition of one content are a rename.

    Of several candidates, paths pair up in order.
    """
    both = base.select("path", F.col("blob_id").alias("_b")).join(head.select("path", F.col("blob_id").alias("_h")), "path", "full_outer")
    kept = both.where("_b is not null and _h is not null and _b <> _h").select(F.lit("M").alias("status"), F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    number = lambda df, c: df.withColumn("_n", F.row_number().over(Window.partitionBy(c).orderBy("path"))).withColumnRenamed(c, "blob")
    gone = number(both.where("_h is null").select("path", "_b"), "_b").withColumnRenamed("path", "old_path")
    come = number(both.where("_b is null").select("path", "_h"), "_h").withColumnRenamed("path", "new_path")
    moved = gone.join(come, ["blob", "_n"], "full_outer")
    status = F.when(F.col("old_path").isNull(), "A").when(F.col("new_path").isNull(), "D").otherwise("R100")
    return kept.unionByName(moved.select(status.alias("status"), "old_path", "new_path"))


def changed_files(change: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Changes with both sides' category and score (j11) and the score's delta. An absent side counts 0; a present, unmeasured one makes the delta null."""
    old = base.select(F.col("path").alias("old_path"), F.col("category").alias("old_category"), F.col("tree_score").alias("_b"))
    new = head.select(F.col("path").alias("new_path"), F.col("category").alias("new_category"), F.col("tree_score").alias("_h"))
    joined = change.join(old, "old_path", "left").join(new, "new_path", "left")
    before = F.when(F.col("old_path").isNull(), F.lit(0.0)).otherwise(F.col("_b"))
    after = F.when(F.col("new_path").isNull(), F.lit(0.0)).otherwise(F.col("_h"))
    return joined.select("status", "old_path", "new_path", "old_category", "new_category", F.coalesce("new_path", "old_path").alias("path"), before.alias("base"), after.alias("head"), (after - before).alias("absolute"))


def change_counts(rows: DataFrame) -> DataFrame:
    """a11, p17."""
    kind = lambda c: F.count_if(F.col("status").startswith(c))
    return rows.agg(kind("A").alias("additions"), kind("D").alias("deletions"), kind("R").alias("renames"), F.count_if(F.col("old_category") != F.col("new_category")).alias("category_moves"))


def ranked(rows: DataFrame) -> DataFrame:
    """Rank by score, then path, in all and within a category (w01, w02)."""
    order = [F.col("tree_score").desc(), F.col("path")]
    return global_place(rows, F.col("tree_score"), order, "rank").withColumn("category_rank", F.row_number().over(Window.partitionBy("category").orderBy(*order)))


def leaders(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k greatest rises and falls (o02)."""
    up = rows.where("absolute > 0").orderBy(F.col("absolute").desc(), "path").limit(k).withColumn("kind", F.lit("regression"))
    down = rows.where("absolute < 0").orderBy(F.col("absolute").asc(), "path").limit(k).withColumn("kind", F.lit("improvement"))
    return up.unionByName(down)


def report_status(errors: Column, missing: Column, coverage_of_head: Column) -> Column:
    return F.when(errors > 0, "failed").when((missing > 0) | (coverage_of_head < 1), "incomplete").otherwise("complete")


def cache_stats(probed: DataFrame) -> DataFrame:
    """a12, from items with `hit`."""
    hit = F.col("hit")
    return probed.agg(F.count("*").alias("items"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).alias("hit_bytes"), F.coalesce(F.sum(F.when(~hit, F.col("size"))), F.lit(0)).alias("miss_bytes"))


def plan_faults(inventories: DataFrame, work: DataFrame) -> DataFrame:
    """Scorable rows without an item of the same blob, language and size, and items without a row (j22, v05): both must be empty."""
    same = ["key", "blob_id", "language"]
    rows = inventories.where("scorable").select("key", "blob_id", "language", F.coalesce("size", F.lit(0)).alias("size")).distinct()
    own = work.select("key", "blob_id", "language", F.coalesce("size", F.lit(0)).alias("size"))
    keys = [*same, "size"]
    return rows.join(own, keys, "left_anti").select("key", F.lit("row without item").alias("fault")).unionByName(own.join(rows, keys, "left_anti").select("key", F.lit("item without row").alias("fault")))
