"""Queries of record readers, worker artifacts, plans, publication, cache entries and settings, over inputs with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import artifacts as ar
from ..operators import compare as cp
from ..operators import stats as st
from ..operators.rules import BadRules, Rules
from ..operators.settings import RULES, settings_fault
from ..sources import records as rc
from .registry import query, sql_over, table
from .snapshots import FINGERPRINT, INVENTORY, inventories, results

W = f"WITH {INVENTORY}"


# -- readers


@query(
    "s10_jsonl_reader",
    """WITH n AS (SELECT user_id AS file_id, event_id, event_id % 997 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events),
p AS (SELECT *, sum(CASE WHEN v = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS place FROM n),
f AS (SELECT *, CASE WHEN v IN (1, 2) THEN 'json' WHEN v IN (3, 4) THEN 'position' WHEN v = 5 THEN 'order' WHEN v IN (6, 7) THEN 'bytes' WHEN v = 8 THEN 'entropy' WHEN v = 9 THEN 'number' WHEN v = 10 THEN 'range' WHEN v = 11 AND place > 0 THEN 'null' END AS fault FROM p WHERE v <> 0),
g AS (SELECT file_id, arg_min(fault, line_no) FILTER (fault IS NOT NULL) AS first_fault, min(line_no) FILTER (fault IS NOT NULL) AS fault_line, count(*) AS n, sum(CASE WHEN place > 0 AND v <> 11 THEN CAST(event_id % 40 AS DOUBLE) / 8 END) AS s FROM f GROUP BY file_id)
SELECT file_id, first_fault, CAST(fault_line AS BIGINT) AS fault_line, CASE WHEN first_fault IS NULL THEN n ELSE 0 END AS n_records, CASE WHEN first_fault IS NULL THEN coalesce(s, 0) ELSE 0 END AS entropy_sum FROM g""",
)
def jsonl(spark, sf_dir):
    """Events as record lines, a file for each user; some lines are blank or broken, each in a way of its own."""
    lines = sql_over(
        spark,
        """WITH n AS (SELECT user_id AS file_id, event_id, event_id % 997 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM {events}),
        p AS (SELECT *, sum(CASE WHEN v = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS place FROM n)
        SELECT file_id, line_no, CASE v WHEN 0 THEN ' \\t' WHEN 1 THEN '{"position":' WHEN 2 THEN '[1]' WHEN 3 THEN '{"bytes_hex":"6b","entropy":1}'
          ELSE concat('{"position":', CASE v WHEN 4 THEN '"0"' WHEN 5 THEN cast(place + 1 AS string) ELSE cast(place AS string) END,
            ',"bytes_hex":', CASE v WHEN 6 THEN '"6b6"' WHEN 7 THEN '6' ELSE '"6b"' END,
            CASE v WHEN 8 THEN '' WHEN 9 THEN ',"entropy":"1"' WHEN 10 THEN ',"entropy":-1' WHEN 11 THEN ',"entropy":null' ELSE concat(',"entropy":', CASE WHEN place = 0 THEN 'null' ELSE cast(double(event_id % 40) / 8 AS string) END) END, '}') END AS line FROM p""",
        events=table(spark, sf_dir, "events"),
    )
    good, faults = rc.read_records(lines)
    files = good.groupBy("file_id").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("entropy_sum"))
    wrong = faults.select("file_id", F.col("fault").alias("first_fault"), F.col("line_no").cast("long").alias("fault_line"), F.lit(0).cast("long").alias("n_records"), F.lit(0.0).alias("entropy_sum"))
    return files.select("file_id", F.lit(None).cast("string").alias("first_fault"), F.lit(None).cast("long").alias("fault_line"), "n_records", "entropy_sum").unionByName(wrong)


ENTRIES = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)"""
_STATES = f"""{ENTRIES}, l AS (SELECT conv_id, max(n) AS n, max(CASE WHEN k = n - 1 THEN octet_length(encode(text)) END) AS last FROM t GROUP BY conv_id),
states AS (SELECT conv_id AS key, CASE WHEN conv_id % 7 = 5 THEN 'malformed' WHEN conv_id % 7 = 1 THEN 'version' WHEN conv_id % 7 = 2 THEN 'size' WHEN conv_id % 7 = 3 THEN 'provenance' WHEN conv_id % 7 = 4 AND last > 0 THEN 'incomplete' WHEN conv_id % 7 = 6 AND n > 1 THEN 'incomplete' ELSE 'ok' END AS state FROM l)"""


def entries(spark, sf_dir):
    """Conversations as cache entries, a record a turn; each seventh has a fault of its own kind."""
    sql = f"""WITH {ENTRIES.replace("FROM conversations", "FROM {conversations}")}
    SELECT conv_id AS key, conv_id % 5 AS abi, CASE WHEN conv_id % 7 = 1 THEN 1 ELSE 2 END AS version, sum(octet_length(text)) + max(CASE WHEN conv_id % 7 = 2 THEN 1 ELSE 0 END) AS source_size, CASE WHEN conv_id % 7 = 3 THEN 'old' ELSE 'now' END AS provenance,
      transform(filter(array_sort(collect_list(struct(k, text, n))), x -> conv_id % 7 <> 4 OR x.k < x.n - 1), x -> struct(CASE WHEN conv_id % 7 = 5 THEN NULL ELSE cast(x.text AS binary) END AS bytes, CASE WHEN x.k > 0 AND conv_id % 7 <> 6 THEN 1D END AS entropy)) AS records,
      array_join(transform(array_sort(collect_list(struct(k, text))), x -> x.text), '') AS text FROM t GROUP BY conv_id"""
    rows = spark.sql(sql, conversations=table(spark, sf_dir, "conversations"))
    return rows.join(rc.entry_states(rows.drop("text"), rows.select("key", "text"), F.lit("now")), "key")


@query("s11_entry_reader", f"WITH {_STATES} SELECT key, state FROM states")
def entry_reader(spark, sf_dir):
    return entries(spark, sf_dir).select("key", "state")


@query("a23_entries_by_abi", f"WITH {_STATES} SELECT CASE WHEN state = 'malformed' THEN 'malformed' ELSE CAST(key % 5 AS VARCHAR) END AS abi, count(*) AS n FROM states GROUP BY 1")
def by_abi(spark, sf_dir):
    return rc.entries_by_abi(entries(spark, sf_dir).select("key", F.col("abi").cast("string").alias("abi"), "state"))


@query("s18_run_records", "WITH r AS (SELECT 'r' || CAST(o_custkey % 400 AS VARCHAR) AS run, CASE WHEN o_custkey % 400 = 7 AND o_orderkey % 2 = 0 THEN 'other' ELSE 'm' || CAST(o_custkey % 400 % 3 AS VARCHAR) END AS model, o_orderkey % 1999 = 0 AS bad FROM orders) SELECT run, min(model) AS model, count(*) AS n_records, count(*) FILTER (bad) AS n_unreadable, count(*) FILTER (bad) = 0 AND min(model) = max(model) AS admitted FROM r GROUP BY run")
def run_records(spark, sf_dir):
    """Records of scoring runs as JSON lines; some scores are no numbers, and one run mixes two models."""
    lines = sql_over(
        spark,
        """SELECT concat('{"run":"r', o_custkey % 400, '","model":"', CASE WHEN o_custkey % 400 = 7 AND o_orderkey % 2 = 0 THEN 'other' ELSE concat('m', o_custkey % 400 % 3) END,
        '","file":"f', o_orderkey, '","tree_score":', CASE WHEN o_orderkey % 1999 = 0 THEN '"x"' ELSE cast(o_totalprice AS string) END, ',"token_count":', o_orderkey, '}') AS line FROM {orders}""",
        orders=table(spark, sf_dir, "orders"),
    )
    return rc.admitted_runs(rc.parse_runs(lines))


# -- plans and workers


_WORK = "wk AS (SELECT CAST('0x' || substr(key, 1, 4) AS BIGINT) % 4 AS worker_id, key, size FROM items), rs AS (SELECT * FROM wk WHERE worker_id = 2 OR substr(key, 6, 1) <> 'b')"


def assignments(work):
    return work.select((F.conv(F.substring("key", 1, 4), 16, 10).cast("long") % 4).alias("worker_id"), "key", "size")


@query("k07_worker_artifacts", f"{W}, {_WORK}, a AS (SELECT worker_id, count(*) AS n FROM wk GROUP BY 1), d AS (SELECT worker_id, count(*) AS n FROM rs GROUP BY 1) SELECT a.worker_id, CASE WHEN a.worker_id <> 1 AND a.n = coalesce(d.n, 0) THEN 'complete' ELSE 'failed' END AS status, coalesce(d.n, 0) AS n_results, CAST(CASE WHEN a.worker_id = 1 THEN 3 ELSE 0 END AS BIGINT) AS n_errors FROM a LEFT JOIN d USING (worker_id)")
def worker_artifacts(spark, sf_dir):
    put = assignments(cp.items(inventories(spark, sf_dir)))
    done = put.where("worker_id = 2 or substr(key, 6, 1) <> 'b'")
    errors = spark.range(3).select(F.lit(1).cast("long").alias("worker_id"), F.col("id").cast("string").alias("error"))
    return ar.worker_artifacts(put, done, errors, "pipeline", FINGERPRINT).select("worker_id", "status", "n_results", "n_errors")


_HEADS = """heads AS (SELECT * FROM (VALUES ('a0', 0, 'now', 'complete', 0), ('a1', 1, 'now', 'failed', 2), ('a1-again', 1, 'now', 'complete', 0), ('a3', 3, 'now', 'complete', 1), ('a9', 9, 'now', 'complete', 0), ('b2', 2, 'old', 'complete', 0), ('c0', 0, 'now', NULL, 0)) h(name, worker_id, identity, status, n_errors))"""


@query(
    "v06_artifact_report",
    f"""WITH {_HEADS}, p AS (SELECT p_partkey % 4 AS worker_id, p_partkey AS k FROM part),
g AS (SELECT h.name, h.worker_id, (SELECT count(*) FROM p WHERE p.worker_id = h.worker_id AND k % 10 = 3) AS missing, (SELECT count(*) FROM p WHERE p.worker_id = (h.worker_id + 1) % 4 AND k % 50 = 7) AS extra, (SELECT count(*) FROM p WHERE p.worker_id = h.worker_id AND k % 10 <> 3 AND k % 70 = 11) AS invalid FROM heads h WHERE name IN ('a0', 'a1', 'a3'))
SELECT CAST(worker_id AS BIGINT) AS worker_id, name, fault, CAST(n AS BIGINT) AS n FROM (
SELECT worker_id, name, 'missing' AS fault, missing AS n FROM g WHERE missing > 0 UNION ALL SELECT worker_id, name, 'extra', extra FROM g WHERE extra > 0 UNION ALL SELECT worker_id, name, 'invalid', invalid FROM g WHERE invalid > 0
UNION ALL VALUES (1, 'a1', 'failed', 2), (1, 'a1-again', 'duplicate', 1), (3, 'a3', 'told', 1), (9, 'a9', 'unexpected', 1), (2, 'b2', 'foreign', 1), (0, 'c0', 'malformed', 1), (2, NULL, 'absent', 1), (3, 'a3', 'schema', 1))""",
)
def artifact_report(spark, sf_dir):
    """Artifacts of four workers with a fault of each kind: one is foreign, one comes twice, one has no status, one worker none at all."""
    heads = [("a0", 0, "now", "complete", 0), ("a1", 1, "now", "failed", 2), ("a1-again", 1, "now", "complete", 0), ("a3", 3, "now", "complete", 1), ("a9", 9, "now", "complete", 0), ("b2", 2, "old", "complete", 0), ("c0", 0, "now", None, 0)]
    heads = spark.createDataFrame(heads, "name string, worker_id long, identity string, status string, n_errors long").withColumns({"fingerprint": F.lit(FINGERPRINT), "schema_version": F.when(F.col("name") == "a3", 1).otherwise(2)})
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("worker_id"))
    put = part.select("worker_id", F.col("p_partkey").cast("string").alias("key"))
    own = part.where("p_partkey % 10 <> 3").select("worker_id", "p_partkey")
    other = part.where("p_partkey % 50 = 7").select(((F.col("worker_id") + 3) % 4).alias("worker_id"), "p_partkey")
    # an artifact of worker 0 is a0, and so on; the number of tokens is wrong where the twin counts it invalid
    name = F.concat(F.lit("a"), F.col("worker_id").cast("string"))
    done = own.unionByName(other).select(name.alias("name"), F.col("p_partkey").cast("string").alias("key"), F.lit(FINGERPRINT).alias("fingerprint"), F.lit(1.0).alias("tree_score"), F.lit(1.0).alias("entropy_sum"), F.lit(5).alias("token_count"), F.when(F.expr("p_partkey % 70 = 11"), 6).otherwise(5).alias("high_entropy_tokens"), F.lit(1).alias("total_comp_level"))
    return ar.artifact_report(heads, done, put, "now", FINGERPRINT)


@query(
    "v05_plan_validation",
    f"""{W}, hits AS (SELECT * FROM results WHERE substr(key, 2, 1) <> 'e'), ms AS (SELECT key, size FROM items WHERE key NOT IN (SELECT key FROM hits)),
puts AS (SELECT CAST('0x' || substr(key, 1, 4) AS BIGINT) % 5 AS worker_id, key FROM ms WHERE substr(key, 3, 1) <> 'a' UNION ALL SELECT CAST(3 AS BIGINT), key FROM hits WHERE substr(key, 3, 2) = 'bb' UNION ALL SELECT CAST(0 AS BIGINT), key FROM ms WHERE substr(key, 3, 1) = 'c')
SELECT * FROM (VALUES ('items that are malformed', CAST(0 AS BIGINT)), ('workers beyond the most', (SELECT count(DISTINCT worker_id) FROM puts WHERE worker_id > 3)),
('rows without item or items without row', (SELECT count(*) FROM (SELECT DISTINCT key, blob_id, language FROM inv WHERE scorable AND substr(key, 1, 2) <> 'ab') WHERE substr(key, 1, 2) = 'cd') + (SELECT count(*) FROM items WHERE substr(key, 1, 2) = 'ab')),
('cached results that are invalid', (SELECT count(*) FROM hits WHERE substr(key, 4, 1) = '7' OR substr(key, 1, 2) = 'cd')),
('misses without a worker', (SELECT count(*) FROM ms WHERE substr(key, 1, 2) <> 'cd' AND substr(key, 3, 1) = 'a')),
('assignments of no miss', (SELECT count(DISTINCT key) FROM puts WHERE key NOT IN (SELECT key FROM ms WHERE substr(key, 1, 2) <> 'cd'))),
('keys with two workers', (SELECT count(*) FROM (SELECT key FROM puts GROUP BY key HAVING count(*) > 1))),
('workers with other bytes than told', (SELECT count(*) FROM (SELECT worker_id, sum(i.size) AS own, CASE WHEN worker_id = 1 THEN -1 ELSE sum(i.size) END AS told FROM puts p LEFT JOIN (SELECT * FROM items WHERE substr(key, 1, 2) <> 'cd') i ON p.key = i.key GROUP BY worker_id) WHERE own IS NULL OR own <> told))) t(check_name, faults)""",
)
def plan_validation(spark, sf_dir):
    """A plan with planted faults: items and rows taken away, results spoilt, misses left out, hits and keys assigned twice."""
    inv = inventories(spark, sf_dir)
    work = cp.items(inv)
    hits = results(work).where("substr(key, 2, 1) <> 'e'").withColumn("high_entropy_tokens", F.when(F.expr("substr(key, 4, 1) = '7'"), F.col("token_count") + 1).otherwise(F.col("high_entropy_tokens")))
    ms = work.join(hits, "key", "left_anti")
    worker = (F.conv(F.substring("key", 1, 4), 16, 10).cast("long") % 5).alias("worker_id")
    puts = ms.where("substr(key, 3, 1) <> 'a'").select(worker, "key").unionByName(hits.where("substr(key, 3, 2) = 'bb'").select(F.lit(3).cast("long").alias("worker_id"), "key")).unionByName(ms.where("substr(key, 3, 1) = 'c'").select(F.lit(0).cast("long").alias("worker_id"), "key"))
    left = work.where("substr(key, 1, 2) <> 'cd'")
    told = puts.join(left.select("key", "size"), "key", "left").groupBy("worker_id").agg(F.sum("size").alias("bytes")).withColumn("bytes", F.when(F.col("worker_id") == 1, F.lit(-1)).otherwise(F.col("bytes")))
    return ar.plan_checks(inv.where("key is null or substr(key, 1, 2) <> 'ab'"), left, hits, puts.join(told, "worker_id"), FINGERPRINT)


@query("k05_plan_document", f"{W} SELECT '1-items' AS part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS first_key FROM items UNION ALL SELECT '2-workers', count(*), CAST(sum(size) AS BIGINT), min(key) FROM items WHERE key NOT IN (SELECT key FROM results) UNION ALL SELECT '0-header', (SELECT count(*) FROM items), (SELECT CAST(sum(size) AS BIGINT) FROM items), NULL")
def plan_document(spark, sf_dir):
    """The plan's lines, parsed again: the header tells what the other parts hold."""
    work = cp.items(inventories(spark, sf_dir))
    puts = assignments(work.join(results(work), "key", "left_anti")).withColumnRenamed("size", "bytes")
    lines = ar.plan_document(work, puts, "pipeline", FINGERPRINT)
    back = lines.select("part", F.from_json("line", "key string, size bigint, bytes bigint, n_items bigint").alias("r")).select("part", "r.*")
    header = back.where("part = '0-header'").select("part", F.col("n_items").alias("n"), "bytes", F.lit(None).cast("string").alias("first_key"))
    return header.unionByName(back.where("part <> '0-header'").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", "bytes")).alias("bytes"), F.min("key").alias("first_key")))


@query("v07_blob_digest", "SELECT doc_id, CAST(octet_length(encode(text)) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bytes, CASE WHEN doc_id % 17 = 0 THEN 'malformed' WHEN doc_id % 13 = 0 THEN 'content' END AS fault FROM documents")
def blob_digests(spark, sf_dir):
    """Contents under the id of their digest, of either kind; some are changed, some ids are no digests."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    own = F.when(F.col("doc_id") % 17 == 0, F.lit("no-digest")).when(F.col("doc_id") % 2 == 0, F.sha2(text, 256)).otherwise(sc.blob_id(text))
    rows = docs.select("doc_id", own.alias("blob_id"), F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("x"))).otherwise(text).alias("content"))
    return ar.blob_faults(rows).select("doc_id", "n_bytes", "fault")


# -- publication and caches


@query("i09_publication_order", "WITH r AS (SELECT o_custkey AS target, o_orderkey AS seq, CAST(floor(o_totalprice / 20000) AS BIGINT) AS ordinal, o_orderpriority AS pipeline_id FROM orders), m AS (SELECT r.*, max(ordinal) OVER w AS top, list({'o': ordinal, 'p': pipeline_id}) OVER w AS before FROM r WINDOW w AS (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT target, seq, CASE WHEN top > ordinal THEN 'superseded' WHEN top = ordinal AND list_filter(before, lambda x: x.o = ordinal)[1].p <> pipeline_id THEN 'conflict' ELSE 'accepted' END AS state FROM m")
def publication_order(spark, sf_dir):
    return ar.publication_states(publications(spark, sf_dir)).select("target", "seq", "state")


def publications(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("seq"), F.floor(F.col("o_totalprice") / 20000).cast("long").alias("ordinal"), F.col("o_orderpriority").alias("pipeline_id"))


@query("k14_publication_marker", "WITH r AS (SELECT o_custkey AS target, o_orderkey AS seq, CAST(floor(o_totalprice / 20000) AS BIGINT) AS ordinal, o_orderpriority AS pipeline_id FROM orders), t AS (SELECT *, first_value(pipeline_id) OVER (PARTITION BY target ORDER BY ordinal DESC, seq) AS p, max(ordinal) OVER (PARTITION BY target) AS o FROM r) SELECT target, ordinal, pipeline_id, max(seq) AS seq FROM t WHERE ordinal = o AND pipeline_id = p GROUP BY target, ordinal, pipeline_id")
def publication_marker(spark, sf_dir):
    return ar.markers(publications(spark, sf_dir))


@query("k09_latest_entry", "SELECT user_id AS key, max(ts) AS stored_at, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id")
def latest_entry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("stored_at"), "event_id", F.col("event_type").alias("kind"))
    return ar.latest_entries(rows, "event_id")


@query("a24_cache_accounting", "SELECT user_id AS cache, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS n_bytes, min(CASE WHEN event_type <> 'view' THEN ts END) + INTERVAL 20 DAY AS next_expiry FROM events GROUP BY user_id")
def accounting(spark, sf_dir):
    """Entries seen only (never used) have no time and never expire."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cache"), F.floor("value").cast("long").alias("n_bytes"), F.when(F.col("event_type") != "view", F.col("ts")).alias("used_at"))
    return ar.cache_accounting(rows)


# -- settings, rules, formats


_SET = "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size - 12 AS DOUBLE) / 4 END AS tau, CASE WHEN p_size % 3 = 1 OR p_size % 9 = 0 THEN CAST(p_size AS DOUBLE) * 3 END AS tau_percentile, CAST(p_partkey % 13 AS DOUBLE) / 11 AS alpha, CASE p_partkey % 5 WHEN 0 THEN 'cpu' WHEN 1 THEN 'tpu' ELSE 'auto' END AS backend, CASE WHEN p_size % 4 = 0 THEN 'q8_0' ELSE 'f16' END AS kv_cache_type, CASE WHEN p_partkey % 3 = 0 THEN 'off' ELSE 'auto' END AS flash_attention, CASE WHEN p_size % 10 = 0 THEN 'device' ELSE 'host' END AS entropy_reduction, 'structural' AS hierarchy_mode, p_partkey % 7 = 0 AS force_cpu, CAST(p_partkey % 6 - 2 AS INT) AS gpu_layers FROM part"


@query(
    "p22_settings_validation",
    f"""WITH s AS ({_SET}) SELECT p_partkey, CASE WHEN tau IS NOT NULL AND tau_percentile IS NOT NULL THEN '{RULES[0][0]}' WHEN kv_cache_type <> 'f16' AND flash_attention = 'off' THEN '{RULES[1][0]}' WHEN tau < 0 THEN 'tau is out of range' WHEN tau_percentile > 100 THEN 'tau_percentile is out of range' WHEN alpha > 1 THEN 'alpha is out of range' WHEN backend = 'tpu' THEN 'backend is unknown' WHEN force_cpu AND gpu_layers <> 0 THEN 'force_cpu and gpu_layers exclude each other' WHEN gpu_layers < -1 THEN 'gpu_layers is out of range' WHEN entropy_reduction = 'device' AND gpu_layers <> -1 THEN 'device reduction needs all layers on a GPU' END AS fault FROM s""",
)
def settings_validation(spark, sf_dir):
    rows = spark.sql(_SET.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return rows.select("p_partkey", settings_fault().alias("fault"))


_RULE_FILES = {
    "defaults": (b"{}", True), "list as text": (b'{"tests": "abc"}', False), "number as glob": (b'{"exclude": [5]}', False), "half a path": (b'{"paths": [{"pattern": "a"}]}', False),
    "extension without dot": (b'{"extensions": {"nodot": "c"}}', False), "extension in capitals": (b'{"extensions": {".C": "c"}}', False), "good extension": (b'{"extensions": {".c+1_x-": "c"}}', True),
    "unknown key": (b'{"other": []}', False), "unknown language": (b'{"paths": [{"pattern": "a", "language": "cobol"}]}', False), "language as number": (b'{"extensions": {".x": 3}}', False),
    "too large": (b" " * 65537, False), "most patterns": (b'{"tests": [' + b",".join([b'"a"'] * 512) + b"]}", True), "a pattern too many": (b'{"tests": [' + b",".join([b'"a"'] * 513) + b"]}", False),
    "longest pattern": (b'{"tests": ["' + b"a" * 256 + b'"]}', True), "pattern too long": (b'{"tests": ["' + b"a" * 257 + b'"]}', False), "no object": (b"[]", False), "no JSON": (b"{", False), "empty glob": (b'{"tests": [""]}', False),
}


def _accepts(raw: bytes) -> bool:
    try:
        Rules.parse(raw)
    except BadRules:
        return False
    return True


@query("v10_rules_limits", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {str(ok).upper()})" for name, (_, ok) in _RULE_FILES.items()) + ") t(name, accepted)")
def rules_limits(spark, sf_dir):
    """Rules files at and beyond each limit, read by the driver as any rules file is."""
    return spark.createDataFrame([(name, _accepts(raw)) for name, (raw, _) in _RULE_FILES.items()], "name string, accepted boolean")


@query("f08_numeric_format", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.6g', l_extendedprice) AS short, printf('%+.1f', l_discount * 100 - l_quantity) AS signed FROM lineitem")
def numeric_formats(spark, sf_dir):
    """The reports' number formats, on whole columns by Arrow batches."""
    import pandas as pd

    short = F.pandas_udf(lambda x: pd.Series([sc.short_number(v) for v in x]), "string")
    signed = F.pandas_udf(lambda x: pd.Series([sc.signed_number(v) for v in x]), "string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", short("l_extendedprice").alias("short"), signed(F.col("l_discount") * 100 - F.col("l_quantity")).alias("signed"))


# -- agreement of runs


@query("a21_repeat_difference", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_runs, round(max(o_totalprice) - min(o_totalprice), 7) AS most FROM orders GROUP BY o_custkey")
def repeat_difference(spark, sf_dir):
    return st.repeat_difference(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], "o_orderpriority").withColumn("most", F.round("most", 7))


@query("j18_function_pairing", "WITH a AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) * 10 AS BIGINT) AS t, min(l_partkey) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, t - 100 AS t, s + 1 AS s FROM a WHERE l_orderkey % 3 <> 0) SELECT a.l_orderkey AS path, a.l_linenumber AS start_line, a.t AS token_count, b.t AS other_tokens, CAST(b.s AS DOUBLE) AS other_score FROM a JOIN b USING (l_orderkey, l_linenumber) WHERE a.t >= 100 AND b.t >= 100")
def function_pairing(spark, sf_dir):
    """Order lines as functions of two runs: the second has fewer tokens, and some files are gone."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum("l_quantity") * 10).cast("long").alias("token_count"), F.min("l_partkey").cast("double").alias("tree_score"))
    a = a.select(F.col("l_orderkey").alias("path"), F.lit("f").alias("name"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line"), "token_count", "tree_score")
    b = a.where("path % 3 <> 0").withColumns({"token_count": F.col("token_count") - 100, "tree_score": F.col("tree_score") + 1})
    return st.pair_functions(a, b).select("path", "start_line", "token_count", "other_tokens", "other_score")


_GATE = "g AS (SELECT p_partkey % 20 AS g, p_partkey AS id, p_retailprice AS old, CASE WHEN p_partkey % 20 = 3 THEN -p_retailprice WHEN p_partkey % 20 = 4 AND p_size > 45 THEN 0 ELSE p_retailprice + CAST(p_size AS DOUBLE) / 1000 END AS new, p_size FROM part)"


@query(
    "a22_promotion_gate",
    f"""WITH {_GATE}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY old) + (count(*) OVER (PARTITION BY g, old) - 1) / CAST(2 AS DOUBLE) AS x, rank() OVER (PARTITION BY g ORDER BY new) + (count(*) OVER (PARTITION BY g, new) - 1) / CAST(2 AS DOUBLE) AS y, p_size FROM g), rho AS (SELECT g, corr(x, y) AS file_rho FROM r GROUP BY g),
f AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY old) + (count(*) OVER (PARTITION BY g, old) - 1) / CAST(2 AS DOUBLE) AS x, rank() OVER (PARTITION BY g ORDER BY new) + (count(*) OVER (PARTITION BY g, new) - 1) / CAST(2 AS DOUBLE) AS y FROM g WHERE p_size > 10), frho AS (SELECT g, corr(x, y) AS function_rho FROM f GROUP BY g),
t AS (SELECT g, list_sort(list(id ORDER BY old DESC, id)[1:5]) = list_sort(list(id ORDER BY new DESC, id)[1:5]) AS top_kept FROM g GROUP BY g),
s AS (SELECT g, count(*) FILTER ((old - 1400) * CASE WHEN g = 5 AND p_size = 7 THEN -1 ELSE 1 END * (old - 1400) < 0) AS reversals FROM g GROUP BY g)
SELECT g, round(file_rho, 8) AS file_rho, round(function_rho, 8) AS function_rho, top_kept, reversals, CASE WHEN g = 6 THEN 0.5 ELSE 0.0 END AS difference, coalesce(file_rho >= 0.98 AND function_rho >= 0.98 AND top_kept AND reversals = 0 AND g <> 6, false) AS promoted FROM rho JOIN frho USING (g) JOIN t USING (g) JOIN s USING (g)""",
)
def promotion_gate(spark, sf_dir):
    """Parts as the files of twenty runs: one run turns the order round, one drops files to the end, one reverses signs, one does not repeat itself."""
    rows = spark.sql(f"WITH {_GATE.replace('FROM part', 'FROM {part}')} SELECT * FROM g", part=table(spark, sf_dir, "part"))
    change = (F.col("old") - 1400).alias("old")
    changes = rows.select("g", "id", change, (F.when(F.expr("g = 5 and p_size = 7"), -1).otherwise(1) * (F.col("old") - 1400)).alias("new"))
    repeats = rows.select("g", "id", F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col("old").alias("value")), F.struct(F.lit("b").alias("run"), (F.col("old") + F.when(F.col("g") == 6, 0.5).otherwise(0.0)).alias("value")))).alias("r")).select("g", "id", "r.run", "r.value")
    gate = st.promotion_gate(rows, rows.where("p_size > 10"), changes, repeats, ["g"])
    return gate.select("g", F.round("file_rho", 8).alias("file_rho"), F.round("function_rho", 8).alias("function_rho"), "top_kept", "reversals", F.round("difference", 6).alias("difference"), "promoted")
