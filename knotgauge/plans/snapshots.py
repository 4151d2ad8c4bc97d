"""Queries over two snapshots of a tree: rules, inventories, work, caches, packing, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.globs import any_glob_regex, glob_regex, prunes_directory
from ..operators import compare as cp
from ..operators import rules as ru
from ..operators.ranks import global_place, text_lead
from .registry import query, table

FINGERPRINT = "f" * 64
NOW = "2024-01-31 00:00:00"
OVERSIZED = 9000

# The same text builds paths and snapshots in both engines; operators and their twins start from there.
PATH = """concat(CASE doc_id % 9 WHEN 0 THEN 'tools/' WHEN 1 THEN 'src/tests/' WHEN 2 THEN 'vendor/' WHEN 3 THEN 'out/' WHEN 4 THEN 'a/.git/' WHEN 5 THEN 'pkg/bin/x/' ELSE 'src/' END,
 source, '/f', CAST(doc_id AS STRING), CASE doc_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.RS' WHEN 2 THEN '.cs' WHEN 3 THEN '.cc' WHEN 4 THEN '.h' WHEN 5 THEN '' WHEN 6 THEN '_test.go' WHEN 7 THEN '.txt' WHEN 8 THEN '.java' ELSE '.js' END)"""
SIDES = f"""SELECT 'base' AS side, doc_id, {PATH} AS path, text FROM documents WHERE doc_id % 10 < 8
 UNION ALL SELECT 'head' AS side, doc_id, CASE WHEN doc_id % 10 = 6 THEN concat('moved/', {PATH}) ELSE {PATH} END AS path, CASE WHEN doc_id % 10 = 5 THEN concat(text, 'x') ELSE text END AS text FROM documents WHERE doc_id % 10 >= 1"""
MODE = "CASE WHEN doc_id % 97 = 0 THEN '160000' WHEN doc_id % 89 = 0 THEN '120000' ELSE '100644' END"
KIND = "CASE WHEN doc_id % 97 = 0 THEN 'commit' ELSE 'blob' END"

_LANGUAGE = "CASE " + " ".join("WHEN ext IN ({}) THEN '{}'".format(", ".join(f"'{e}'" for e in es), x) for x, es in ru.EXTENSIONS.items()) + " END"
INVENTORY = f"""
snap AS ({SIDES}),
venv AS (SELECT DISTINCT side, 'src/src3' AS directory FROM snap),
ext AS (SELECT s.*, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, {MODE} AS mode, {KIND} AS type, sha256(text) AS blob_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, starts_with(path, 'src/src3/') AS in_venv FROM snap s),
cls AS (SELECT *, {_LANGUAGE} AS language,
  CASE WHEN regexp_matches(path, '{any_glob_regex(ru.TESTS)}') THEN 'tests' WHEN regexp_matches(path, '{any_glob_regex(ru.TOOLING)}') THEN 'tooling' ELSE 'runtime' END AS category,
  regexp_matches(path, '{any_glob_regex(ru.EXCLUDE)}') OR list_has_any(string_split(path, '/'), ['.git', '.kg-cache']) OR in_venv AS gone FROM ext),
judged AS (SELECT *, CASE WHEN mode = '160000' THEN 'submodule' WHEN mode = '120000' THEN 'symlink' WHEN type <> 'blob' THEN 'unsupported' WHEN gone THEN 'excluded' WHEN language IS NULL THEN 'unsupported' WHEN size > {OVERSIZED} THEN 'oversized' END AS reason FROM cls),
inv AS (SELECT side, path, language, category, size, blob_id, reason, reason IS NULL AS scorable, CASE WHEN reason IS NULL THEN sha256('kg-item' || chr(0) || blob_id || chr(0) || language || chr(0) || '{FINGERPRINT}') END AS key FROM judged),
items AS (SELECT key, blob_id, language, size, path AS display_path FROM inv WHERE scorable QUALIFY row_number() OVER (PARTITION BY key ORDER BY side, path) = 1),
results AS (SELECT key, blob_id, language, '{FINGERPRINT}' AS fingerprint, CAST(size % 1000 AS DOUBLE) / 8 AS tree_score, size // 3 AS token_count, size // 9 AS high_entropy_tokens, CAST(size AS DOUBLE) / 4 AS entropy_sum, size // 50 AS total_branch, size // 20 AS total_comp_level FROM items WHERE substr(key, 1, 1) <> '0'),
meas AS (SELECT i.*, r.tree_score, r.token_count, i.scorable OR coalesce(i.language IS NOT NULL AND i.reason = 'oversized', false) AS supported, r.tree_score IS NOT NULL AS measured FROM inv i LEFT JOIN results r ON i.key = r.key)"""


def snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sides = spark.sql(SIDES.replace("FROM documents", "FROM {docs}"), docs=docs)
    return sides.selectExpr("side", "doc_id", "path", "text", f"{MODE} AS mode", f"{KIND} AS type", "sha2(text, 256) AS blob_id", "CAST(octet_length(text) AS BIGINT) AS size")


def inventories(spark, sf_dir):
    snap = snapshots(spark, sf_dir).drop("text")
    markers = snap.select("side").distinct().withColumn("directory", F.lit("src/src3"))
    return ru.inventory(ru.in_virtualenv(snap, markers), ru.Rules(), FINGERPRINT, OVERSIZED).select("side", "path", "language", "category", "size", "blob_id", "reason", "scorable", "key")


def results(work):
    size = F.col("size")
    return work.where("substr(key, 1, 1) <> '0'").select("key", "blob_id", "language", F.lit(FINGERPRINT).alias("fingerprint"), ((size % 1000).cast("double") / 8).alias("tree_score"), F.expr("size div 3").alias("token_count"), F.expr("size div 9").alias("high_entropy_tokens"), (size.cast("double") / 4).alias("entropy_sum"), F.expr("size div 50").alias("total_branch"), F.expr("size div 20").alias("total_comp_level"))


def measured(spark, sf_dir):
    inv = inventories(spark, sf_dir)
    return cp.measured(inv, results(cp.items(inv)))


def paths(spark, sf_dir):
    return spark.sql(f"SELECT doc_id, {PATH} AS path FROM {{docs}}", docs=table(spark, sf_dir, "documents"))


P = f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents)"
W = f"WITH {INVENTORY}"


# -- path predicates


@query("p01_language", f"{P}, e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM p) SELECT doc_id, CASE WHEN starts_with(path, 'out/') THEN 'rust' WHEN ext = '.txt' THEN 'c' ELSE {_LANGUAGE} END AS language FROM e")
def language(spark, sf_dir):
    rules = ru.Rules(extensions={".txt": "c"}, paths=(("out/**", "rust"),))
    return paths(spark, sf_dir).select("doc_id", rules.language(F.col("path")).alias("language"))


@query("p02_category", f"{P} SELECT doc_id, CASE WHEN regexp_matches(path, '(^|/)(test|tests|testdata|fixtures|fuzz|fuzzers)/.') OR regexp_matches(path, '_test\\.[^/]*$') OR regexp_matches(path, '(^|/)test_[^/]*\\.[^/]*$') THEN 'tests' WHEN regexp_matches(path, '^(tools|examples|example|scripts|benchmarks)/') THEN 'tooling' ELSE 'runtime' END AS category FROM p")
def category(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", ru.Rules().category(F.col("path")).alias("category"))


@query("p03_excluded", f"{P} SELECT doc_id, regexp_matches(path, '(^|/)(vendor|target|build|dist|deps)/.') OR starts_with(path, 'out/') OR regexp_matches(path, '(^|/)(bin|obj)/(.*/)?[^/]*\\.cs$') AS excluded FROM p")
def excluded(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", ru.Rules().excluded(F.col("path")).alias("excluded"))


@query("p04_always_excluded", f"{P} SELECT doc_id, list_contains(string_split(path, '/'), '.git') AS always_excluded FROM p")
def always(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", ru.always_excluded(F.col("path")).alias("always_excluded"))


@query("p05_directory_pruning", f"{P} SELECT doc_id, regexp_matches(path, '^(vendor|out)/') AS pruned FROM p")
def pruned(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", prunes_directory(F.regexp_replace("path", "/[^/]*$", ""), ru.EXCLUDE).alias("pruned"))


GLOBS = ("src/**", "**/f1*.py", "*/src?/f[0-3]*", "**/*_test.*", "src/tests/src[!0-5]/**")


@query("p06_glob_match", f"{P} SELECT doc_id, " + ", ".join(f"regexp_matches(path, '{glob_regex(g)}') AS g{k}" for k, g in enumerate(GLOBS)) + " FROM p")
def globs(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", *(F.col("path").rlike(glob_regex(g)).alias(f"g{k}") for k, g in enumerate(GLOBS)))


@query("p07_extension", f"{P} SELECT doc_id, CASE WHEN instr(split_part(path, '/', -1), '.') > 0 THEN lower('.' || split_part(path, '.', -1)) ELSE '' END AS ext FROM p")
def extensions(spark, sf_dir):
    return paths(spark, sf_dir).select("doc_id", sc.extension(F.col("path")).alias("ext"))


@query("p08_in_virtualenv", f"{W} SELECT side, path, in_venv FROM ext")
def virtualenv(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    return ru.in_virtualenv(snap.select("side", "path"), snap.select("side").distinct().withColumn("directory", F.lit("src/src3")))


@query("p09_inventory_reason", f"{W} SELECT side, path, reason FROM inv")
def reasons(spark, sf_dir):
    return inventories(spark, sf_dir).select("side", "path", "reason")


@query("p10_scorable_key", f"{W} SELECT side, path, scorable, key FROM inv")
def keys(spark, sf_dir):
    return inventories(spark, sf_dir).select("side", "path", "scorable", "key")


@query("p11_supported", f"{W} SELECT side, path, supported FROM meas")
def supported(spark, sf_dir):
    return inventories(spark, sf_dir).select("side", "path", ru.supported().alias("supported"))


@query("p16_digests", f"{W} SELECT side, path, TRUE AS blob_ok, length(key) = 64 AS key_ok, FALSE AS path_ok FROM inv WHERE scorable")
def digests(spark, sf_dir):
    return inventories(spark, sf_dir).where("scorable").select("side", "path", sc.is_digest(F.col("blob_id")).alias("blob_ok"), sc.is_digest(F.col("key")).alias("key_ok"), sc.is_digest(F.col("path")).alias("path_ok"))


@query("s05_commit_snapshot", f"{W} SELECT side, mode, type, blob_id AS object_id, size, path FROM ext")
def commit_snapshot(spark, sf_dir):
    return snapshots(spark, sf_dir).select("side", "mode", "type", F.col("blob_id").alias("object_id"), "size", "path")


CHANGES = """
b AS (SELECT path, blob_id FROM inv WHERE side = 'base'), h AS (SELECT path, blob_id FROM inv WHERE side = 'head'),
gone AS (SELECT path AS old_path, blob_id, row_number() OVER (PARTITION BY blob_id ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM h)),
come AS (SELECT path AS new_path, blob_id, row_number() OVER (PARTITION BY blob_id ORDER BY path) AS n FROM h WHERE path NOT IN (SELECT path FROM b)),
chg AS (SELECT 'M' AS status, b.path AS old_path, h.path AS new_path FROM b JOIN h ON b.path = h.path AND b.blob_id <> h.blob_id
  UNION ALL SELECT CASE WHEN old_path IS NULL THEN 'A' WHEN new_path IS NULL THEN 'D' ELSE 'R100' END, old_path, new_path FROM gone FULL JOIN come ON gone.blob_id = come.blob_id AND gone.n = come.n),
full_chg AS (SELECT c.*, o.category AS old_category, w.category AS new_category, coalesce(c.new_path, c.old_path) AS path, CASE WHEN c.old_path IS NULL THEN 0 ELSE o.tree_score END AS base, CASE WHEN c.new_path IS NULL THEN 0 ELSE w.tree_score END AS head FROM chg c LEFT JOIN (SELECT * FROM meas WHERE side = 'base') o ON c.old_path = o.path LEFT JOIN (SELECT * FROM meas WHERE side = 'head') w ON c.new_path = w.path)"""


@query("j09_changes", f"{W}, {CHANGES} SELECT * FROM chg")
def change_rows(spark, sf_dir):
    inv = inventories(spark, sf_dir)
    return cp.changes(inv.where("side = 'base'"), inv.where("side = 'head'"))


@query("s06_snapshot_diff", f"{W}, {CHANGES} SELECT status, count(*) AS n FROM chg GROUP BY status")
def diff_counts(spark, sf_dir):
    return change_rows(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def changed(spark, sf_dir):
    rows = measured(spark, sf_dir)
    base, head = rows.where("side = 'base'"), rows.where("side = 'head'")
    return cp.changed_files(cp.changes(base, head), base, head)


@query("j11_changed_files", f"{W}, {CHANGES} SELECT status, old_path, new_path, old_category, new_category, base, head, head - base AS absolute FROM full_chg")
def changed_rows(spark, sf_dir):
    return changed(spark, sf_dir).drop("path")


@query("a11_change_counts", f"{W}, {CHANGES} SELECT count(*) FILTER (status = 'A') AS additions, count(*) FILTER (status = 'D') AS deletions, count(*) FILTER (status LIKE 'R%') AS renames, count(*) FILTER (old_category <> new_category) AS category_moves FROM full_chg")
def change_counts(spark, sf_dir):
    return cp.change_counts(changed(spark, sf_dir))


@query("p17_change_kind", f"{W}, {CHANGES} SELECT path, starts_with(status, 'A') AS added, starts_with(status, 'D') AS deleted, starts_with(status, 'R') AS renamed FROM full_chg")
def change_kind(spark, sf_dir):
    rows = change_rows(spark, sf_dir)
    return rows.select(F.coalesce("new_path", "old_path").alias("path"), *(F.col("status").startswith(c).alias(n) for c, n in (("A", "added"), ("D", "deleted"), ("R", "renamed"))))


@query("o02_leaders", f"{W}, {CHANGES}, d AS (SELECT path, head - base AS absolute FROM full_chg), u AS (SELECT path, absolute, 'regression' AS kind FROM d WHERE absolute > 0 ORDER BY absolute DESC, path LIMIT 10), v AS (SELECT path, absolute, 'improvement' AS kind FROM d WHERE absolute < 0 ORDER BY absolute, path LIMIT 10) SELECT * FROM u UNION ALL SELECT * FROM v")
def leaders(spark, sf_dir):
    return cp.leaders(changed(spark, sf_dir)).select("path", "absolute", "kind")


@query("o03_changed_order", f"{W}, {CHANGES}, d AS (SELECT path, head - base AS absolute FROM full_chg) SELECT path, row_number() OVER (ORDER BY absolute IS NULL, abs(absolute) DESC, path) AS place FROM d")
def changed_order(spark, sf_dir):
    rows = changed(spark, sf_dir)
    lead = F.coalesce(F.abs("absolute"), F.lit(-1.0))
    return global_place(rows, lead, [lead.desc(), F.col("path")], "place").select("path", "place")


@query("o04_changed_by_path", f"{W}, {CHANGES} SELECT path, row_number() OVER (ORDER BY path, status) AS place FROM full_chg")
def changed_by_path(spark, sf_dir):
    rows = change_rows(spark, sf_dir).withColumn("path", F.coalesce("new_path", "old_path"))
    return global_place(rows, -text_lead(F.col("path")), [F.col("path"), F.col("status")], "place").select("path", "place")


@query("o08_largest_change", f"{W}, {CHANGES}, d AS (SELECT path, head - base AS absolute FROM full_chg WHERE head - base <> 0) SELECT path, absolute FROM d ORDER BY abs(absolute) DESC, absolute DESC, path LIMIT 1")
def largest_change(spark, sf_dir):
    rows = changed(spark, sf_dir).where("absolute <> 0")
    return rows.orderBy(F.abs("absolute").desc(), F.col("absolute").desc(), "path").limit(1).select("path", "absolute")


@query("o09_capped_list", f"{W}, {CHANGES} SELECT path FROM full_chg ORDER BY path LIMIT 25")
def capped(spark, sf_dir):
    return change_rows(spark, sf_dir).select(F.coalesce("new_path", "old_path").alias("path")).orderBy("path").limit(25)


# -- work items, caches, packing


@query("e01_items", f"{W} SELECT key, blob_id, language, size, display_path FROM items")
def work_items(spark, sf_dir):
    return cp.items(inventories(spark, sf_dir))


@query("j21_display_path", f"{W} SELECT key, display_path FROM items")
def display_path(spark, sf_dir):
    return cp.items(inventories(spark, sf_dir)).select("key", "display_path")


@query("a26_distinct_blobs", f"{W} SELECT count(DISTINCT blob_id) AS blobs, count(DISTINCT path) AS paths, count(DISTINCT key) AS keys FROM inv")
def distinct_blobs(spark, sf_dir):
    return inventories(spark, sf_dir).agg(F.count_distinct("blob_id").alias("blobs"), F.count_distinct("path").alias("paths"), F.count_distinct("key").alias("keys"))


@query("o05_largest_first", f"{W} SELECT key, row_number() OVER (ORDER BY size DESC, key) AS place FROM items")
def largest_first(spark, sf_dir):
    return global_place(cp.items(inventories(spark, sf_dir)), F.col("size"), [F.col("size").desc(), F.col("key")], "place").select("key", "place")


def probed(spark, sf_dir):
    work = cp.items(inventories(spark, sf_dir))
    return work, work.join(results(work).select("key", F.lit(True).alias("hit")), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("j12_cache_probe", f"{W} SELECT i.key, r.key IS NOT NULL AS hit FROM items i LEFT JOIN results r ON i.key = r.key")
def cache_probe(spark, sf_dir):
    return probed(spark, sf_dir)[1].select("key", "hit")


@query("e02_misses", f"{W} SELECT key FROM items EXCEPT SELECT key FROM results")
def misses(spark, sf_dir):
    work = cp.items(inventories(spark, sf_dir))
    return work.select("key").subtract(results(work).select("key"))


@query("e03_set_equality", f"{W} SELECT (SELECT count(*) FROM (SELECT key FROM items EXCEPT ALL SELECT key FROM results)) AS only_items, (SELECT count(*) FROM (SELECT key FROM results EXCEPT ALL SELECT key FROM items)) AS only_results")
def set_equality(spark, sf_dir):
    work = cp.items(inventories(spark, sf_dir)).select("key", "blob_id", "language", "size")
    a, b = work.select("key"), results(work).select("key")
    return a.exceptAll(b).agg(F.count("*").alias("only_items")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_results")))


@query("a12_cache_stats", f"{W}, q AS (SELECT i.size, r.key IS NOT NULL AS hit FROM items i LEFT JOIN results r ON i.key = r.key) SELECT count(*) AS items, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(coalesce(sum(size) FILTER (hit), 0) AS BIGINT) AS hit_bytes, CAST(coalesce(sum(size) FILTER (NOT hit), 0) AS BIGINT) AS miss_bytes FROM q")
def cache_stats(spark, sf_dir):
    return cp.cache_stats(probed(spark, sf_dir)[1])


@query("a13_missing_results", f"{W} SELECT count(*) AS missing FROM items WHERE key NOT IN (SELECT key FROM results)")
def missing_results(spark, sf_dir):
    work = cp.items(inventories(spark, sf_dir))
    return work.join(results(work), "key", "left_anti").agg(F.count("*").alias("missing"))


@query("p13_result_ttl", f"SELECT event_id, CASE WHEN ts > TIMESTAMP '{NOW}' OR ts < TIMESTAMP '{NOW}' - INTERVAL 25 DAY THEN 'miss' WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 20 DAY THEN 'refresh' ELSE 'hit' END AS state FROM events")
def result_ttl(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cp.cache_state(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp"), 25, 20).alias("state"))


@query("p14_entropy_expiry", f"SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN ts END <= TIMESTAMP '{NOW}' - INTERVAL 20 DAY, false) AS expired FROM events")
def entropy_expiry(spark, sf_dir):
    used = F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", cp.is_expired(used, F.lit(NOW).cast("timestamp")).alias("expired"))


@query("p19_admission", "SELECT doc_id, octet_length(encode(text)) * 900 <= 16777216 AND octet_length(encode(text)) * 900 + 256 * (octet_length(encode(text)) * 20) <= 67108864 AS admitted FROM documents")
def admission(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", cp.admitted(n * 900, n * 20).alias("admitted"))


@query("w10_lru_eviction", "WITH e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e) SELECT user_id AS cache, event_id AS entry_id, total - freed + 50 > 900 AS evicted FROM r")
def lru(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cache"), F.col("event_id").alias("entry_id"), F.col("ts").alias("used_at"), F.floor("value").cast("long").alias("n_bytes"))
    return cp.evict_least_recent(rows, 900, 50).select("cache", "entry_id", "evicted")


PACKED = """WITH RECURSIVE todo AS (SELECT p_brand AS grp, CAST(p_partkey AS VARCHAR) AS key, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, CAST(p_partkey AS VARCHAR)) AS n, least(4, count(*) OVER (PARTITION BY p_brand)) AS bins FROM part),
step AS (SELECT grp, n, key, size, 0 AS bin, [size, CASE WHEN bins > 1 THEN 0 ELSE 1000000000 END, CASE WHEN bins > 2 THEN 0 ELSE 1000000000 END, CASE WHEN bins > 3 THEN 0 ELSE 1000000000 END]::BIGINT[] AS load FROM todo WHERE n = 1
  UNION ALL SELECT t.grp, t.n, t.key, t.size, list_position(s.load, list_min(s.load)) - 1, list_transform(s.load, lambda x, i: CASE WHEN i = list_position(s.load, list_min(s.load)) THEN x + t.size ELSE x END) FROM step s JOIN todo t ON t.grp = s.grp AND t.n = s.n + 1)
SELECT grp AS "group", CAST(bin AS INT) AS bin, list_sort(list(key)) AS keys, CAST(sum(size) AS BIGINT) AS bytes FROM step GROUP BY grp, bin"""


@query("i05_longest_first_packing", PACKED)
def packed(spark, sf_dir):
    work = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("size"))
    return cp.pack_longest_first(work)


# -- workers and reports


@query("j10_inventory_results", f"{W} SELECT side, path, tree_score, measured FROM meas")
def inventory_results(spark, sf_dir):
    return measured(spark, sf_dir).select("side", "path", "tree_score", "measured")


TOTALS = """
agg AS (SELECT side, category, count(*) AS paths, count(*) FILTER (supported) AS supported, count(*) FILTER (measured) AS measured, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (supported), 0) AS BIGINT) AS supported_bytes, CAST(coalesce(sum(size) FILTER (measured), 0) AS BIGINT) AS measured_bytes, coalesce(sum(tree_score), 0) AS cc, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tok FROM meas GROUP BY GROUPING SETS ((side, category), (side))),
tot AS (SELECT side, category, paths, supported, measured, bytes, supported_bytes, measured_bytes, CASE WHEN supported = measured THEN cc END AS tree_score, CASE WHEN supported = measured THEN tok END AS tokens, CASE WHEN supported = 0 THEN 1 ELSE CAST(measured AS DOUBLE) / supported END AS coverage, CASE WHEN supported_bytes = 0 THEN 1 ELSE CAST(measured_bytes AS DOUBLE) / supported_bytes END AS byte_coverage FROM agg)"""


@query("a09_side_totals", f"{W}, {TOTALS} SELECT side, category, paths, supported, measured, bytes, supported_bytes, measured_bytes, tree_score, tokens, round(coverage, 9) AS coverage, round(byte_coverage, 9) AS byte_coverage FROM tot")
def side_totals(spark, sf_dir):
    t = cp.side_totals(measured(spark, sf_dir))
    return t.withColumn("coverage", F.round("coverage", 9)).withColumn("byte_coverage", F.round("byte_coverage", 9))


@query("f13_side_deltas", f"{W}, full_meas AS (SELECT side, category, sum(tree_score) AS cc FROM (SELECT side, category, tree_score FROM meas WHERE measured UNION ALL SELECT side, NULL, tree_score FROM meas WHERE measured) GROUP BY side, category), j AS (SELECT b.category, b.cc AS base, h.cc AS head FROM full_meas b JOIN full_meas h ON b.category IS NOT DISTINCT FROM h.category WHERE b.side = 'base' AND h.side = 'head') SELECT category, base, head, head - base AS absolute, round(100 * (head - base) / nullif(base, 0), 6) AS percent FROM j")
def side_deltas(spark, sf_dir):
    rows = measured(spark, sf_dir).where("measured")
    return cp.side_deltas(cp.side_totals(rows)).withColumn("percent", F.round("percent", 6))


@query("j15_category_domain", f"{W}, d AS (SELECT * FROM (SELECT DISTINCT side FROM inv) CROSS JOIN (VALUES ('runtime'), ('tests'), ('tooling')) c(category)) SELECT d.side, d.category, count(i.path) AS paths FROM d LEFT JOIN (SELECT * FROM inv WHERE language = 'java') i ON i.side = d.side AND i.category = d.category GROUP BY d.side, d.category")
def category_domain(spark, sf_dir):
    rows = measured(spark, sf_dir)
    java = rows.where("language = 'java'")
    return cp.side_totals(java).where("category is not null").select("side", "category", "paths")


@query("a10_unmeasured_reasons", f"{W} SELECT side, reason, count(*) AS n FROM inv WHERE reason IS NOT NULL GROUP BY side, reason")
def unmeasured(spark, sf_dir):
    return inventories(spark, sf_dir).where("reason is not null").groupBy("side", "reason").agg(F.count("*").alias("n"))


@query("w01_global_rank", f"{W} SELECT path, row_number() OVER (ORDER BY tree_score DESC, path) AS rank FROM meas WHERE side = 'head' AND measured")
def global_rank(spark, sf_dir):
    return cp.ranked(measured(spark, sf_dir).where("side = 'head' and measured")).select("path", F.col("rank").cast("long").alias("rank"))


@query("w02_category_rank", f"{W} SELECT path, category, row_number() OVER (PARTITION BY category ORDER BY tree_score DESC, path) AS category_rank FROM meas WHERE side = 'head' AND measured")
def category_rank(spark, sf_dir):
    return cp.ranked(measured(spark, sf_dir).where("side = 'head' and measured")).select("path", "category", F.col("category_rank").cast("long").alias("category_rank"))


@query("w11_top_per_category", f"{W}, r AS (SELECT path, category, row_number() OVER (ORDER BY tree_score DESC, path) AS rank, row_number() OVER (PARTITION BY category ORDER BY tree_score DESC, path) AS category_rank FROM meas WHERE side = 'head' AND measured) SELECT path, category FROM r WHERE rank <= 50 OR category_rank <= 20")
def top_per_category(spark, sf_dir):
    return cp.ranked(measured(spark, sf_dir).where("side = 'head' and measured")).where("rank <= 50 or category_rank <= 20").select("path", "category")


@query("e06_changed_flag", f"{W}, {CHANGES} SELECT path, path IN (SELECT new_path FROM chg WHERE new_path IS NOT NULL) AS changed FROM inv WHERE side = 'head'")
def changed_flag(spark, sf_dir):
    inv = inventories(spark, sf_dir)
    touched = cp.changes(inv.where("side = 'base'"), inv.where("side = 'head'")).select(F.col("new_path").alias("path")).where("path is not null").distinct().withColumn("changed", F.lit(True))
    return inv.where("side = 'head'").join(touched, "path", "left").select("path", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("a14_report_status", f"{W}, {TOTALS}, m AS (SELECT count(*) AS missing FROM items WHERE key NOT IN (SELECT key FROM results)) SELECT CASE WHEN missing > 0 OR coverage < 1 THEN 'incomplete' ELSE 'complete' END AS status FROM tot, m WHERE side = 'head' AND category IS NULL")
def report_status(spark, sf_dir):
    inv = inventories(spark, sf_dir)
    work = cp.items(inv)
    missing = work.join(results(work), "key", "left_anti").agg(F.count("*").alias("missing"))
    head = cp.side_totals(cp.measured(inv, results(work))).where("side = 'head' and category is null")
    return head.crossJoin(missing).select(cp.report_status(F.lit(0), F.col("missing"), F.col("coverage")).alias("status"))


def worker_keys(spark, sf_dir):
    return cp.items(inventories(spark, sf_dir)).select((F.conv(F.substring("key", 1, 4), 16, 10).cast("long") % 4).alias("worker_id"), "key", "size")


WORKERS = "wk AS (SELECT CAST('0x' || substr(key, 1, 4) AS BIGINT) % 4 AS worker_id, key, size FROM items), ex AS (SELECT worker_id, key FROM wk WHERE substr(key, 5, 1) <> 'a'), ac AS (SELECT worker_id, key FROM wk WHERE substr(key, 6, 1) <> 'b')"


@query("j13_worker_key_mismatch", f"{W}, {WORKERS} SELECT coalesce(e.worker_id, a.worker_id) AS worker_id, count(*) FILTER (a.key IS NULL) AS missing, count(*) FILTER (e.key IS NULL) AS extra FROM ex e FULL JOIN ac a ON e.worker_id = a.worker_id AND e.key = a.key GROUP BY 1")
def worker_mismatch(spark, sf_dir):
    rows = worker_keys(spark, sf_dir)
    return cp.key_mismatch(rows.where("substr(key, 5, 1) <> 'a'"), rows.where("substr(key, 6, 1) <> 'b'"), "worker_id")


ARTIFACTS = "a AS (SELECT o_custkey % 60 AS worker_id, CAST(o_orderkey AS VARCHAR) AS name, CASE WHEN o_orderstatus = 'F' THEN 'bad' ELSE 'good' END AS fingerprint, CASE WHEN o_totalprice > 300000 THEN 'failed' ELSE 'complete' END AS status FROM orders), w AS (SELECT CAST(range AS BIGINT) AS worker_id FROM range(10, 70))"


@query("j14_artifact_faults", f"WITH {ARTIFACTS}, n AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY name) AS k FROM a) SELECT worker_id, name, CASE WHEN fingerprint <> 'good' THEN 'foreign' WHEN worker_id NOT IN (SELECT worker_id FROM w) THEN 'unexpected' WHEN k > 1 THEN 'duplicate' WHEN status <> 'complete' THEN 'failed' END AS fault FROM n UNION ALL SELECT worker_id, NULL, 'missing' FROM w WHERE worker_id NOT IN (SELECT worker_id FROM a WHERE fingerprint = 'good')")
def artifact_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("worker_id"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "bad").otherwise("good").alias("fingerprint"), F.when(F.col("o_totalprice") > 300000, "failed").otherwise("complete").alias("status"))
    return cp.artifact_errors(rows, spark.range(10, 70).toDF("worker_id"), "good")


@query("j22_item_references", f"{W} SELECT key, 'row without item' AS fault FROM (SELECT DISTINCT key FROM inv WHERE scorable) r WHERE r.key NOT IN (SELECT key FROM items WHERE substr(key, 1, 2) <> 'ab') UNION ALL SELECT key, 'item without row' FROM items WHERE substr(key, 1, 2) = 'cd' ")
def item_references(spark, sf_dir):
    inv = inventories(spark, sf_dir)
    return cp.plan_faults(inv.where("key is null or substr(key, 1, 2) <> 'cd'"), cp.items(inv).where("substr(key, 1, 2) <> 'ab'"))


@query("p15_valid_result", f"{W} SELECT key, high_entropy_tokens * 2 <= token_count AND substr(key, 2, 1) <> '1' AS ok FROM results")
def valid_results(spark, sf_dir):
    rows = results(cp.items(inventories(spark, sf_dir))).withColumn("high_entropy_tokens", F.col("high_entropy_tokens") * 2)
    rows = rows.withColumn("fingerprint", F.when(F.expr("substr(key, 2, 1) = '1'"), "other").otherwise(F.col("fingerprint")))
    return rows.select("key", cp.valid_result(F.lit(FINGERPRINT)).alias("ok"))


@query("a25_set_digest", "SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(0) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY o_custkey")
def set_digest(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(sc.set_digest(F.collect_list(F.col("o_orderkey").cast("string"))).alias("digest"))
