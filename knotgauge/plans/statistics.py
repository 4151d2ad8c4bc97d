"""Queries of inference arithmetic, run agreement, readers, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sc
from ..operators import stats as st
from ..operators.comments import strip_html_comments
from ..operators.offsets import map_offsets
from ..sources.models import MODELS, model_registry, resolve_tau
from .registry import query, table

LOGITS = "x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), y AS (SELECT vec_id, e[label + 1] - list_max(e) AS t, list_transform(e, lambda v: v - list_max(e)) AS d FROM x), z AS (SELECT vec_id, t, list_sum(list_transform(d, lambda v: exp(v))) AS s, list_sum(list_transform(d, lambda v: exp(v) * v)) AS w FROM y)"


@query("a15_softmax_statistics", f"WITH {LOGITS} SELECT vec_id, round(t - ln(s), 9) AS log_probability, round(exp(t - ln(s)), 9) AS probability, round(ln(s) - w / s, 9) AS entropy FROM z")
def softmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *st.softmax_statistics("embedding", "label"))
    return rows.select("vec_id", *(F.round(c, 9).alias(c) for c in ("log_probability", "probability", "entropy")))


@query("a16_perplexity", f"WITH {LOGITS} SELECT round(avg(ln(s) - t), 8) AS mean_nll, round(exp(avg(ln(s) - t)), 6) AS perplexity FROM z")
def perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(*st.softmax_statistics("embedding", "label"))
    return rows.agg(F.round(F.avg(-F.col("log_probability")), 8).alias("mean_nll"), F.round(st.perplexity(F.col("log_probability")), 6).alias("perplexity"))


@query("k03_score_records", f"WITH {LOGITS} SELECT vec_id AS position, label AS token_id, round(exp(t - ln(s)), 6) AS probability FROM z JOIN embeddings USING (vec_id)")
def score_records(spark, sf_dir):
    """Records as JSON lines, read back with their schema."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("label").alias("token_id"), *st.softmax_statistics("embedding", "label"))
    line = rows.select(F.to_json(F.struct("position", "token_id", "probability", "log_probability", "entropy")).alias("line"))
    back = line.select(F.from_json("line", "position bigint, token_id int, probability double").alias("r")).select("r.*")
    return back.withColumn("probability", F.round("probability", 6))


def counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.octet_length("text") / 3).cast("long").alias("token_count"))


COUNTS = "c AS (SELECT doc_id AS id, octet_length(encode(text)) // 3 AS n FROM documents)"


@query("w07_inference_windows", f"WITH RECURSIVE {COUNTS}, w AS (SELECT id, n, 0 AS k, CAST(0 AS BIGINT) AS b, least(n, 512) AS e, CAST(1 AS BIGINT) AS f FROM c WHERE n >= 2 UNION ALL SELECT id, n, k + 1, b + 256, least(n, b + 768), e FROM w WHERE e < n) SELECT id, CAST(k AS INT) AS \"window\", b AS token_begin, CAST(e AS BIGINT) AS token_end, CAST(f AS BIGINT) AS scored_target_begin FROM w")
def windows(spark, sf_dir):
    return st.inference_windows(counts(spark, sf_dir), 512)


@query("w08_window_count", f"WITH {COUNTS} SELECT id, CAST(CASE WHEN n < 2 THEN 0 WHEN n <= 512 THEN 1 ELSE 1 + (n - 512 + 255) // 256 END AS BIGINT) AS windows FROM c")
def window_counts(spark, sf_dir):
    return counts(spark, sf_dir).select("id", st.window_count(F.col("token_count"), 512).alias("windows"))


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))


ITEMS = "i AS (SELECT l_partkey % 100 AS g, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem)"
RANKS = f"{ITEMS}, r AS (SELECT g, " + ", ".join(f"rank() OVER (PARTITION BY g ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in "qpd") + " FROM i)"


@query("w09_average_rank", f"WITH {RANKS} SELECT g, q AS rank, count(*) AS n FROM r GROUP BY g, q")
def average_ranks(spark, sf_dir):
    return items(spark, sf_dir).withColumn("rank", st.average_rank("q", ["g"])).groupBy("g", "rank").agg(F.count("*").alias("n"))


@query("a18_spearman", f"WITH {RANKS} SELECT g, round(corr(q, p), 8) AS rho FROM r GROUP BY g")
def spearman(spark, sf_dir):
    return st.spearman(items(spark, sf_dir), "q", "p", ["g"]).withColumn("rho", F.round("rho", 8))


@query("a19_partial_spearman", f"WITH {RANKS}, c AS (SELECT g, corr(q, p) AS xy, corr(q, d) AS xz, corr(p, d) AS yz FROM r GROUP BY g) SELECT g, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS rho FROM c")
def partial(spark, sf_dir):
    return st.partial_spearman(items(spark, sf_dir), "q", "p", "d", ["g"]).withColumn("rho", F.round("rho", 8))


@query("a04_inverse_percentile", f"WITH {ITEMS}, s AS (SELECT g, p, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY g) AS n, lead(p) OVER w AS nx FROM i WINDOW w AS (PARTITION BY g ORDER BY p)), f AS (SELECT g, min(CASE WHEN p = 40000 THEN 100.0 * k / (n - 1) WHEN p < 40000 AND nx > 40000 THEN 100 * (k + (40000 - p) / (nx - p)) / (n - 1) END) AS v, min(p) AS lo, max(p) AS hi FROM s GROUP BY g) SELECT g, round(CASE WHEN lo >= 40000 THEN 0 WHEN hi < 40000 THEN 100 ELSE v END, 8) AS percentile FROM f")
def inverse(spark, sf_dir):
    return st.inverse_percentile(items(spark, sf_dir), "p", 40000.0, ["g"]).withColumn("percentile", F.round("percentile", 8))


@query("a17_mean_median", f"WITH {ITEMS} SELECT g, round(avg(p), 6) AS mean, round(median(p), 6) AS median FROM i GROUP BY g")
def mean_median(spark, sf_dir):
    return items(spark, sf_dir).groupBy("g").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.median("p"), 6).alias("median"))


@query("a20_bootstrap_interval")
def bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("g"), "p_size", "p_retailprice")
    return st.bootstrap_interval(rows, "p_size", "p_retailprice", ["g"])


TOP5 = f"{ITEMS}, t AS (SELECT g, list_distinct(list(CAST(p AS DOUBLE) ORDER BY p DESC)[1:5]) AS a, list_distinct(list(CAST(p AS DOUBLE) ORDER BY q DESC, p DESC)[1:5]) AS b FROM i GROUP BY g)"


def tops(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("p", F.col("p").cast("double"))
    top = lambda name, *order: st.top_set(rows, ["g"], list(order), "p").withColumnRenamed("top", name)
    return top("a", F.col("p").desc()).join(top("b", F.col("q").desc(), F.col("p").desc()), "g")


@query("e04_top5_intersection", f"WITH {TOP5} SELECT g, CAST(len(list_intersect(a, b)) AS INT) AS shared FROM t")
def top5(spark, sf_dir):
    return tops(spark, sf_dir).select("g", F.size(F.array_intersect("a", "b")).alias("shared"))


@query("e05_overlap_ratio", f"WITH {TOP5} SELECT g, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(a), 0), 9) AS ratio FROM t")
def overlap(spark, sf_dir):
    return tops(spark, sf_dir).select("g", F.round(st.overlap_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


_SHORT = "p_brand || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '-' END || CAST(p_partkey AS VARCHAR)"


@query("j19_suffix_pairing", f"WITH a AS (SELECT p_partkey, 'root/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part), b AS (SELECT p_partkey AS other, {_SHORT} AS short FROM part) SELECT p_partkey, min(short) AS short FROM a JOIN b ON a.path = b.short OR ends_with(a.path, b.short) GROUP BY p_partkey")
def suffix_pairs(spark, sf_dir):
    """Equal, or one path ends with the other: each path's suffixes are its keys, so the join is an equi-join. Two thirds of the other run's paths are written in another way and find no partner.

    Only suffixes of a length that the other run has are made. Both sides grow with the table: none is broadcast.
    """
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("root/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    short = part.select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "/").otherwise("-"), F.col("p_partkey").cast("string")).alias("short"))
    lengths = short.where("short is not null").agg(F.collect_set(F.length("short")).alias("ls"))
    cut = F.expr("transform(filter(ls, n -> n <= length(path)), n -> substr(path, length(path) - n + 1))")
    tails = part.select("p_partkey", path.alias("path")).crossJoin(F.broadcast(lengths)).select("p_partkey", F.explode(cut).alias("short"))
    return tails.join(short.distinct().hint("merge"), "short").groupBy("p_partkey").agg(F.min("short").alias("short"))


@query("j20_before_after", "WITH r AS (SELECT o_custkey, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT b.o_custkey, round(b.v, 7) AS before, round(a.v, 7) AS after, round(a.v - b.v, 7) AS delta FROM r b JOIN r a ON a.o_custkey = b.o_custkey AND b.s = 'O' AND a.s = 'F'")
def before_after(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    b, a = r.where("o_orderstatus = 'O'").select("o_custkey", F.col("v").alias("b")), r.where("o_orderstatus = 'F'").select("o_custkey", F.col("v").alias("a"))
    return b.join(a, "o_custkey").select("o_custkey", F.round("b", 7).alias("before"), F.round("a", 7).alias("after"), F.round(F.col("a") - F.col("b"), 7).alias("delta"))


@query("s12_bounded_reader", "SELECT doc_id, octet_length(encode(text)) <= 5000 AS admitted FROM documents")
def bounded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return docs.where("n <= 5000").select("doc_id", F.lit(True).alias("admitted")).unionByName(docs.where("n > 5000").select("doc_id", F.lit(False).alias("admitted")))


@query("s15_json_document", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def json_document(spark, sf_dir):
    doc = table(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("doc"))
    return doc.select(F.from_json("doc", "o_orderkey bigint, o_orderstatus string, o_orderpriority string", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("s17_model_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', '{m[1]}', '{m[2]}', CAST({m[3]} AS BIGINT), '{m[4]}', CAST({m[5]} AS DOUBLE))" for m in MODELS) + ") t(name, file, sha256, approx_bytes, note, default_tau)")
def models(spark, sf_dir):
    return model_registry(spark)


_TAUS = " ".join(f"WHEN {k} THEN {m[5]}" for k, m in enumerate(MODELS))


@query("p21_tau_resolution", f"SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN CAST(0.5 AS DOUBLE) WHEN p_partkey % 8 > 5 OR p_size % 7 = 2 THEN CAST(0.67 AS DOUBLE) ELSE CAST(CASE p_partkey % 8 {_TAUS} END AS DOUBLE) END AS resolved_tau, CASE WHEN p_size % 7 < 2 THEN 'cli' WHEN p_partkey % 8 > 5 THEN 'paper-default' WHEN p_size % 7 = 2 THEN 'model-digest-mismatch' ELSE 'model-default' END AS tau_source FROM part")
def taus(spark, sf_dir):
    names = F.array(*(F.lit(m[0]) for m in MODELS), F.lit("own"), F.lit("other"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.expr("p_size % 7 = 0"), F.lit(67.0)).alias("tau_percentile"), F.when(F.expr("p_size % 7 = 1"), F.lit(0.5)).alias("tau"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("model"), F.when(F.expr("p_size % 7 = 2"), F.lit("0" * 64)).otherwise("").alias("digest"))
    return resolve_tau(rows).select("p_partkey", "resolved_tau", "tau_source")


@query("v09_memory_precheck", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 536870912 <= p_retailprice * 1000000 AND floor(CAST(p_size AS DOUBLE) * 100000000 * CAST(1.1 AS DOUBLE)) <= 3000000000 ELSE floor(CAST(p_size AS DOUBLE) * 100000000 * CAST(1.1 AS DOUBLE)) + 536870912 <= p_retailprice * 1000000 END AS fits FROM part")
def memory(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", st.memory_fits(F.col("p_size").cast("double") * 100000000, F.col("p_retailprice") * 1000000, F.lit(3000000000), F.expr("p_size % 2 = 0")).alias("fits"))


@query("i07_comment_removal", "SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS n_left, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS digest FROM pages")
def comments(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("html", strip_html_comments(F.col("html"), keep_lines=False))
    return rows.select("page_id", F.length("html").cast("long").alias("n_left"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query("j16_offset_remap", "SELECT doc_id, CAST(CASE WHEN n <= 10 THEN n // 2 ELSE n // 2 + CASE WHEN n // 2 >= 10 THEN 7 ELSE 0 END END AS BIGINT) AS mapped FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def remap(spark, sf_dir):
    """Offsets in cleaned text back to the original, where seven bytes were cut at ten."""
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.floor(F.octet_length("text") / 2).cast("long").alias("at"))
    spans = points.select("file_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(1).alias("stride")), F.struct(F.lit(10).cast("long").alias("a"), F.lit(17).cast("long").alias("b"), F.lit(1).alias("stride")))).alias("s")).select("file_id", "s.a", "s.b", "s.stride")
    return map_offsets(points, spans).select(F.col("file_id").alias("doc_id"), "mapped")


@query("o06_sorted_unique_events", "SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS depth FROM events")
def unique_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").alias("depth")).dropDuplicates().orderBy("user_id", "event_type", "depth")


@query("k01_event_stream", "SELECT kind, count(*) AS n FROM (SELECT 'start' AS kind UNION ALL SELECT 'configuration' UNION ALL SELECT CASE WHEN n_chars > 8000 THEN 'error' ELSE 'file' END FROM documents UNION ALL SELECT 'file_start' FROM documents UNION ALL SELECT 'totals') GROUP BY kind")
def event_stream(spark, sf_dir):
    from ..sources.sinks import event_lines

    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("n_chars") > 8000, "too long").alias("error"), F.struct("lang", "n_chars").alias("result"))
    lines = event_lines(docs, {"alpha": 0.8}, docs.agg(F.count("*").alias("discovered")))
    return lines.select(F.get_json_object("line", "$.event").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# -- scalar functions


@query("f01_hex", "SELECT doc_id, CAST(2 * octet_length(encode(text)) AS BIGINT) AS digits, md5(hex(encode(text))) AS encoded, TRUE AS back, TRUE AS odd_is_null FROM documents")
def hexes(spark, sf_dir):
    """Whole texts, encoded and decoded; of the digits their number and their digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    e = F.hex(F.col("t").cast("binary"))
    return docs.select("doc_id", F.length(e).cast("long").alias("digits"), F.md5(e.cast("binary")).alias("encoded"), (sc.decode_hex(e) == F.col("t").cast("binary")).alias("back"), sc.decode_hex(F.concat(e, F.lit("F"))).isNull().alias("odd_is_null"))


@query("f02_utf8", "SELECT doc_id, TRUE AS valid, length(text) AS code_points, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def utf8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8("text").alias("valid"), F.length("text").cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("f03_json_escape", "SELECT page_id, contains(html, '\"') AS has_quote, TRUE AS back FROM pages")
def escapes(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "html", F.to_json(F.struct("html")).alias("j"))
    return rows.select("page_id", F.contains("j", F.lit('\\"')).alias("has_quote"), (F.from_json("j", "html string")["html"] == F.col("html")).alias("back"))


@query("f04_strings", "SELECT page_id, lower(url) AS low, split_part(url, '/', 3) AS host, starts_with(url, 'https') AS secure, replace(url, '/', ':') AS flat FROM pages")
def strings(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("low"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.startswith("url", F.lit("https")).alias("secure"), F.replace("url", F.lit("/"), F.lit(":")).alias("flat"))


@query("f06_hashes", "SELECT doc_id, sha256('kg' || chr(0) || text) AS item_key, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS VARCHAR) || chr(0) || text)) AS blob FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.joined_key(F.lit("kg"), F.col("text")).alias("item_key"), sc.blob_id(F.col("text")).alias("blob"))


@query("f07_math", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_suppkey + 6) // 7 AS BIGINT) AS ceil_div, least(l_suppkey + l_partkey, 1500) AS saturated, round(ln(l_quantity), 9) AS ln_q, CAST(floor(l_discount * 10) AS BIGINT) AS fl FROM lineitem")
def maths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.ceil_div(F.col("l_suppkey"), F.lit(7)).alias("ceil_div"), sc.saturating_add(F.col("l_suppkey"), F.col("l_partkey"), 1500).alias("saturated"), F.round(F.ln("l_quantity"), 9).alias("ln_q"), F.floor(F.col("l_discount") * 10).alias("fl"))


@query("f09_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc, TRUE AS back, TRUE AS strict FROM events")
def times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("utc", sc.format_utc(F.col("ts")))
    return rows.select("event_id", "utc", (sc.utc_time(F.col("utc")) == F.date_trunc("second", "ts")).alias("back"), sc.utc_time(F.concat("utc", F.lit("0"))).isNull().alias("strict"))


@query("f10_json_lookup", "SELECT event_id, coalesce(CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT), 0) AS k, CAST(-1 AS BIGINT) AS other FROM events")
def lookups(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.none").cast("long"), F.lit(-1)).alias("other"))


@query("f11_arrays", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS kinds, CAST(len(list(o_orderkey)) AS INT) AS n, list_max(list(o_orderkey)) AS most, list_contains(list(o_orderstatus), 'F') AS has_f FROM orders GROUP BY o_custkey")
def arrays(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_distinct(F.collect_list("o_orderpriority"))).alias("kinds"), F.size(F.collect_list("o_orderkey")).alias("n"), F.array_max(F.collect_list("o_orderkey")).alias("most"), F.array_contains(F.collect_list("o_orderstatus"), "F").alias("has_f"))


@query("f12_maps", "SELECT c_custkey, coalesce(n_name, '?') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def maps(spark, sf_dir):
    """A keyed lookup with a default, as a join; nations are 25 rows by definition, and Spark checks the size before it broadcasts."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("nation"))


@query("f13_delta", "SELECT p_partkey, p_size AS base, p_size % 7 - 3 AS head, p_size % 7 - 3 - p_size AS absolute, round(100 * CAST(p_size % 7 - 3 - p_size AS DOUBLE) / nullif(p_size, 0), 8) AS percent FROM part")
def deltas(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", sc.delta(F.col("p_size"), F.col("p_size") % 7 - 3).alias("d")).select("p_partkey", "d.*")
    return d.withColumn("percent", F.round("percent", 8))


@query("f14_truthiness", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount <> 0 AS number_true, l_returnflag <> 'N' AS text_true FROM lineitem")
def truths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sc.truthy(F.col("l_discount"), "double").alias("number_true"), sc.truthy(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(""), "string").alias("text_true"))


@query("a07_star_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())")
def star(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupingSets([[F.col("r_name")], [F.col("n_name")], []], "r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
