"""Documents that workers and planners hand each other: plans, worker artifacts, publication markers, cache entries (k05-k07, k09, k14, i09, v05-v07, a24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .compare import key_mismatch, valid_result

SCHEMA_VERSION = 2
MOST_WORKERS = 4
DAY = 86400


# -- worker artifacts


def worker_artifacts(assignments: DataFrame, results: DataFrame, errors: DataFrame, identity: str, fingerprint: str) -> DataFrame:
    """One header a worker of assignments (worker_id, key), always, whatever became of its work (k07).

    results (worker_id, key, ...), errors (worker_id, error). The status starts as failed; it is
    complete if there is no error and every assigned key has a result. Results stay rows: a worker
    may have any number of them.
    """
    assigned = assignments.groupBy("worker_id").agg(F.count_distinct("key").alias("n_assigned"))
    done = results.join(assignments.select("worker_id", "key").distinct(), ["worker_id", "key"]).groupBy("worker_id").agg(F.count_distinct("key").alias("n_results"))
    told = errors.groupBy("worker_id").agg(F.count("*").alias("n_errors"))
    every = assigned.join(done, "worker_id", "left").join(told, "worker_id", "left").na.fill(0, ["n_results", "n_errors"])
    status = F.when((F.col("n_errors") == 0) & (F.col("n_results") == F.col("n_assigned")), "complete").otherwise("failed")
    return every.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(identity).alias("identity"), F.lit(fingerprint).alias("fingerprint"), "worker_id", status.alias("status"), "n_results", "n_errors")


def write_artifacts(headers: DataFrame, results: DataFrame, path: str) -> None:
    """A folder worker_id=<id> for each worker, of JSON lines: its header, and a line a result."""
    rows = headers.select("worker_id", F.to_json(F.struct(*(c for c in headers.columns if c != "worker_id"))).alias("value"))
    lines = results.select("worker_id", F.to_json(F.struct(*(c for c in results.columns if c != "worker_id"))).alias("value"))
    rows.unionByName(lines).write.partitionBy("worker_id").text(path)


def artifact_report(headers: DataFrame, results: DataFrame, assignments: DataFrame, identity: str, fingerprint: str) -> DataFrame:
    """(worker_id, name, fault, n) of every fault of worker artifacts (v06); an artifact without one may be merged.

    headers: (name, schema_version, identity, fingerprint, worker_id, status, n_errors), results:
    (name, key, ...). Refused whole, by the first that holds: malformed (no worker, status or number
    of errors), foreign (another identity or fingerprint), unexpected (no such worker), duplicate
    (not the worker's first by name). Of the others, all that hold: schema, missing and extra keys (n
    of them), failed (n errors), told (complete with n errors), invalid (n results). And of workers:
    absent.
    """
    known = assignments.select("worker_id").distinct().withColumn("_known", F.lit(True))
    malformed = F.col("worker_id").isNull() | F.col("status").isNull() | F.col("n_errors").isNull()
    foreign = ~(F.col("identity").eqNullSafe(F.lit(identity)) & F.col("fingerprint").eqNullSafe(F.lit(fingerprint)))
    judged = headers.join(known, "worker_id", "left").withColumn("_refused", F.when(malformed, "malformed").when(foreign, "foreign").when(F.col("_known").isNull(), "unexpected"))
    first = judged.where("_refused is null").groupBy("worker_id").agg(F.min("name").alias("_first"))
    judged = judged.join(first, "worker_id", "left").withColumn("_refused", F.when(F.col("_refused").isNull() & (F.col("name") != F.col("_first")), "duplicate").otherwise(F.col("_refused")))
    one = F.lit(1).cast("long")
    row = lambda df, fault, n=one: df.select("worker_id", "name", (F.lit(fault) if isinstance(fault, str) else fault).alias("fault"), n.cast("long").alias("n"))
    taken = judged.where("_refused is null")
    own = results.join(taken.select("name", "worker_id"), "name")
    expected = assignments.select("worker_id", "key").distinct()
    gaps = taken.select("worker_id", "name").join(key_mismatch(expected, own.select("worker_id", "key").distinct(), "worker_id"), "worker_id")
    wrong = own.join(expected, ["worker_id", "key"], "left_semi").where(~valid_result(F.lit(fingerprint)))
    parts = [
        row(judged.where("_refused is not null"), F.col("_refused")),
        row(taken.where(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True))), "schema"),
        row(gaps.where("missing > 0"), "missing", F.col("missing")),
        row(gaps.where("extra > 0"), "extra", F.col("extra")),
        row(taken.where("status <> 'complete'"), "failed", F.col("n_errors")),
        row(taken.where("status = 'complete' and n_errors > 0"), "told", F.col("n_errors")),
        row(wrong.groupBy("worker_id", "name").agg(F.count("*").alias("_n")), "invalid", F.col("_n")),
        row(known.join(taken.select("worker_id"), "worker_id", "left_anti").withColumn("name", F.lit(None).cast("string")), "absent"),
    ]
    return reduce(DataFrame.unionByName, parts)


# -- plans


def plan_checks(inventories: DataFrame, items: DataFrame, hits: DataFrame, assignments: DataFrame, fingerprint: str) -> DataFrame:
    """(check_name, faults) of a plan (v05): items against inventories, cached results, and the workers' cover of the misses.

    assignments: (worker_id, key, bytes), bytes being what the plan says of the worker in all. All
    that the plan says of a key meets in one shuffle by key.
    """
    content = F.struct("blob_id", "language", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    kinds = {"item": "struct<blob_id:string,language:string,size:bigint>", "row": "struct<blob_id:string,language:string,size:bigint>", "valid": "boolean", "put": "struct<worker_id:bigint,bytes:bigint>"}
    said = lambda df, name, value: df.select("key", *((value if c == name else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))
    parts = [said(items, "item", content), said(inventories.where("scorable"), "row", content), said(hits, "valid", valid_result(F.lit(fingerprint))), said(assignments, "put", F.struct("worker_id", "bytes"))]
    keys = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("item").alias("item"), F.collect_set("row").alias("rows"), F.min("valid").alias("valid"), F.collect_list("put").alias("puts"))
    item, puts = F.col("item"), F.size("puts")
    well = F.coalesce(F.col("key").rlike("^[0-9a-f]{64}$") & (item["size"] >= 0) & item["language"].isNotNull(), F.lit(False))
    miss = item.isNotNull() & F.col("valid").isNull()
    odd = F.size(F.filter("rows", lambda r: ~r.eqNullSafe(item))) + (item.isNotNull() & ~F.exists("rows", lambda r: r.eqNullSafe(item))).cast("int")
    told = {
        "rows without item or items without row": F.coalesce(F.sum(odd), F.lit(0)),
        "items that are malformed": F.count_if(item.isNotNull() & ~well),
        "cached results that are invalid": F.count_if(F.col("valid").isNotNull() & (item.isNull() | ~F.col("valid"))),
        "misses without a worker": F.count_if(miss & (puts == 0)),
        "assignments of no miss": F.count_if((puts > 0) & ~miss),
        "keys with two workers": F.count_if(puts > 1),
    }
    loads = keys.select(item["size"].alias("size"), F.explode("puts").alias("p")).groupBy("p.worker_id").agg(F.sum("size").alias("own"), F.max("p.bytes").alias("bytes"))
    work = {"workers with other bytes than told": F.count_if(F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("bytes"))), "workers beyond the most": F.count_if((F.col("worker_id") < 0) | (F.col("worker_id") >= MOST_WORKERS))}
    listed = lambda df, checks: df.agg(F.array(*(F.struct(F.lit(name).alias("check_name"), n.cast("long").alias("faults")) for name, n in checks.items())).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return listed(keys, told).unionByName(listed(loads, work))


def plan_document(items: DataFrame, assignments: DataFrame, identity: str, fingerprint: str) -> DataFrame:
    """The plan as JSON lines (part, ord, line): a header, then items by key, then workers (k05).

    One object in one cell would hold every item of a snapshot in one task; a line an item is read and written in parts.
    """
    line = lambda df, part, order, *columns: df.select(F.lit(part).alias("part"), order.cast("string").alias("ord"), F.to_json(F.struct(*columns)).alias("line"))
    head = items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    header = line(head, "0-header", F.lit(""), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(identity).alias("identity"), F.lit(fingerprint).alias("fingerprint"), "n_items", "bytes")
    body = line(items, "1-items", F.col("key"), "key", "blob_id", "language", "size")
    work = line(assignments, "2-workers", F.concat_ws(":", "worker_id", "key"), "worker_id", "key", "bytes")
    return header.unionByName(body).unionByName(work)


def write_plan(document: DataFrame, path: str) -> None:
    """In order over the files written, each file in order."""
    document.orderBy("part", "ord").select("line").write.text(path)


def read_plan(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, items, assignments); a line that is none of them raises."""
    rows = spark.read.text(path).select(F.from_json("value", "schema_version int, identity string, fingerprint string, n_items bigint, bytes bigint, key string, blob_id string, language string, size bigint, worker_id bigint", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.where("schema_version is not null").select("schema_version", "identity", "fingerprint", "n_items", "bytes"), rows.where("blob_id is not null").select("key", "blob_id", "language", "size"), rows.where("worker_id is not null").select("worker_id", "key", "bytes")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """(blob_id, content), each content once, dealt by its id (k06)."""
    blobs.groupBy("blob_id").agg(F.first("content").alias("content")).repartition("blob_id").write.parquet(path)


def blob_faults(blobs: DataFrame) -> DataFrame:
    """(blob_id, content, ...) -> all but content, n_bytes, fault: null, malformed (no digest) or content (another digest, by SHA-256 or the SHA-1 of a version control blob) (v07)."""
    body = F.col("content").cast("binary")
    sha1 = F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.lit("\0")).cast("binary"), body))
    own = F.when(F.length("blob_id") == 64, F.sha2(body, 256)).when(F.length("blob_id") == 40, sha1)
    fault = F.when(~F.coalesce(F.col("blob_id").rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False)), "malformed").when(~own.eqNullSafe(F.col("blob_id")), "content")
    return blobs.select(*(c for c in blobs.columns if c != "content"), F.octet_length(body).cast("long").alias("n_bytes"), fault.alias("fault"))


# -- publication


def publication_states(records: DataFrame) -> DataFrame:
    """Records (target, seq, ordinal, pipeline_id) in the order seq of their arrival, with `state` (i09, k14).

    superseded: a marker of a greater ordinal stands. conflict: one of the same ordinal stands, of
    another pipeline. accepted otherwise: the record is the marker now. A pipeline may come again.
    """
    earlier = Window.partitionBy("target").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # of the greatest ordinal so far, the first to come holds the marker: later ones of that ordinal are its own or conflicts
    standing = F.max(F.struct(F.col("ordinal").alias("o"), (-F.col("seq")).alias("s"), F.col("pipeline_id").alias("p"))).over(earlier)
    rows = records.withColumn("_m", standing)
    state = F.when(F.col("_m.o") > F.col("ordinal"), "superseded").when((F.col("_m.o") == F.col("ordinal")) & (F.col("_m.p") != F.col("pipeline_id")), "conflict").otherwise("accepted")
    return rows.withColumn("state", state).drop("_m")


def markers(records: DataFrame) -> DataFrame:
    """(target, ordinal, pipeline_id, seq) of the marker that stands after all records: the greatest ordinal's first pipeline, its last record (k14)."""
    # sums up before the shuffle: a target with many records is no single task's
    best = records.groupBy("target").agg(F.max(F.struct("ordinal", (-F.col("seq")).alias("s"), "pipeline_id")).alias("m")).select(F.col("target").alias("_t"), F.col("m.ordinal").alias("_o"), F.col("m.pipeline_id").alias("_p"))
    own = records.join(best, (F.col("target") == F.col("_t")) & (F.col("ordinal") == F.col("_o")) & (F.col("pipeline_id") == F.col("_p")))
    return own.groupBy("target", "ordinal", "pipeline_id").agg(F.max("seq").alias("seq"))


# -- cache entries


def latest_entries(entries: DataFrame, *tie: str) -> DataFrame:
    """Of each key the entry stored last, ties by the columns `tie` (k09). One aggregation, summed up before the shuffle; no window."""
    rest = [c for c in entries.columns if c != "key"]
    newest = F.max_by(F.struct(*rest), F.struct("stored_at", *tie))
    return entries.groupBy("key").agg(newest.alias("e")).select("key", *(F.col("e")[c].alias(c) for c in rest))


def cache_accounting(entries: DataFrame, days: int = 20) -> DataFrame:
    """Entries (cache, n_bytes, used_at) -> cache, n, n_bytes, next_expiry; entries of unknown time never expire (a24)."""
    return entries.groupBy("cache").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), (F.min("used_at") + F.expr(f"interval {days} days")).alias("next_expiry"))


