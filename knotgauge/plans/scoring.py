"""Queries over token streams: tokens, lines, blocks, trees, functions, hotspots, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analysis
from ..operators import texts as tx
from ..operators import tokens as tk
from ..operators import units as un
from .registry import query, table

TAU, ALPHA = 2.4, 0.8

# -- SQL building blocks, in a formulation of their own

TOKENS = """
files AS (SELECT doc_id AS file_id, text, lang, source FROM documents),
hexed AS (SELECT file_id, regexp_extract_all(hex(encode(text)), '.{1,6}') AS hs FROM files),
cut AS (SELECT file_id, unnest(hs) AS h, CAST(generate_subscripts(hs, 1) - 1 AS BIGINT) AS idx FROM hexed),
tok AS (SELECT file_id, idx, idx * 3 AS start_byte, idx * 3 + length(h) // 2 AS end_byte,
  CASE WHEN idx > 0 THEN (CAST('0x' || substr(h, 1, 2) AS BIGINT)
    + CASE WHEN length(h) > 2 THEN CAST('0x' || substr(h, 3, 2) AS BIGINT) ELSE 0 END
    + CASE WHEN length(h) > 4 THEN CAST('0x' || substr(h, 5, 2) AS BIGINT) ELSE 0 END + 7 * idx) % 97 END AS num FROM cut)"""
LINES = """
split AS (SELECT file_id, string_split(text, chr(10)) AS ls FROM files),
each AS (SELECT file_id, unnest(ls) AS line_text, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line FROM split),
lines AS (SELECT file_id, line, line_text, CAST(coalesce(sum(octet_length(encode(line_text)) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start FROM each),
ranges AS (SELECT file_id, line_start + octet_length(encode(regexp_extract(line_text, '^([ \\t\\r\\x0B\\f]*)', 1))) AS rs,
  line_start + octet_length(encode(regexp_replace(line_text, '[ \\t\\r\\x0B\\f]+$', ''))) AS re FROM lines WHERE regexp_replace(line_text, '[ \\t\\r\\x0B\\f]+', '', 'g') <> '')"""
SCOPES = """
parts AS (SELECT file_id, line, line_start, string_split(line_text, '. ') AS ps FROM lines),
sent AS (SELECT file_id, line, line_start, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM parts),
placed AS (SELECT file_id, line_start + coalesce(sum(octet_length(encode(p)) + 2) OVER (PARTITION BY file_id, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, octet_length(encode(p)) AS n FROM sent),
scopes AS (SELECT file_id, CAST(0 AS BIGINT) AS a, octet_length(encode(text)) AS b, 0 AS depth FROM files
  UNION ALL SELECT file_id, line_start, line_start + octet_length(encode(line_text)), 1 FROM lines
  UNION ALL SELECT file_id, CAST(a AS BIGINT), CAST(a + n AS BIGINT), 2 FROM placed)"""
LINED = """
counted AS (SELECT file_id, count(*) AS n, max(end_byte) AS size FROM tok GROUP BY file_id),
lined AS (SELECT t.*, l.line, l.line_start, min(t.idx) OVER (PARTITION BY t.file_id, l.line) AS line_first FROM tok t ASOF JOIN lines l ON t.file_id = l.file_id AND t.start_byte >= l.line_start),
bounds AS (SELECT r.file_id, min(rs) AS ms, max(re) AS me, CASE WHEN min(rs) >= max(c.size) THEN max(n) ELSE min(rs) // 3 END AS ss, least(max(n), (max(re) + 2) // 3) AS se FROM ranges r JOIN counted c ON r.file_id = c.file_id GROUP BY r.file_id)"""
UNITS = """
hot AS (SELECT DISTINCT l.file_id, greatest(line_first, ss) AS b, ss, se FROM lined l JOIN bounds USING (file_id) WHERE idx >= ss + 1 AND idx < se AND num >= 72),
ends AS (SELECT DISTINCT s.file_id, least(n, (s.b + 2) // 3) AS b FROM scopes s JOIN counted USING (file_id)),
cuts AS (SELECT file_id, b FROM hot WHERE b > ss AND b < se UNION SELECT e.file_id, b FROM ends e JOIN bounds USING (file_id) WHERE b > ss AND b < se
  UNION SELECT file_id, ss FROM bounds UNION SELECT file_id, se FROM bounds),
gaps AS (SELECT file_id, b AS a, lead(b) OVER (PARTITION BY file_id ORDER BY b) AS z FROM cuts),
spans AS (SELECT g.file_id, g.a * 3 AS ta, least(g.z * 3, c.size) AS tz FROM gaps g JOIN counted c USING (file_id) WHERE z IS NOT NULL),
near AS (SELECT s.file_id, s.ta, s.tz, min(rs) AS rs FROM spans s JOIN ranges r ON r.file_id = s.file_id AND r.re > s.ta GROUP BY s.file_id, s.ta, s.tz),
starts AS (SELECT n.file_id, greatest(ta, rs) AS s, least(tz, me) AS e FROM near n JOIN bounds USING (file_id) WHERE rs < tz),
deep AS (SELECT u.file_id, u.s, u.e, coalesce(max(c.depth), 0) AS depth FROM starts u LEFT JOIN scopes c ON c.file_id = u.file_id AND c.a <= u.s AND u.s < c.b GROUP BY u.file_id, u.s, u.e),
units AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, e) - 1 AS seq FROM deep QUALIFY count(*) OVER (PARTITION BY file_id) > 1)"""
# the level of a unit: 2 + how many earlier units have a smaller depth than everything after them up to it
TREE = """
lists AS (SELECT file_id, list(depth ORDER BY seq) AS d FROM units GROUP BY file_id),
folded AS (SELECT file_id, len(d) AS n, list_sum(list_transform(range(1, len(d) + 1), lambda i: 2 + len(list_filter(range(1, i), lambda j: d[j] < list_min(d[j + 1 : i]))))) AS lv FROM lists)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def scopes_of(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Sentence in line in document: scopes of depth 2, 1 and 0."""
    size = F.octet_length("line_text")
    part = lines.select("file_id", "line", "line_start", F.posexplode(F.split("line_text", r"\. ")).alias("k", "p"))
    before = Window.partitionBy("file_id", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("line_start") + F.coalesce(F.sum(F.octet_length("p") + 2).over(before), F.lit(0))
    names = ("file_id", "scope_start", "byte_offset", "depth")
    sentences = part.select("file_id", start.alias("scope_start"), (start + F.octet_length("p")).alias("byte_offset"), F.lit(2).cast("long").alias("depth"))
    whole = docs.select("file_id", F.lit(0).cast("long").alias("scope_start"), F.octet_length("text").cast("long").alias("byte_offset"), F.lit(0).cast("long").alias("depth"))
    each = lines.select("file_id", "line_start", (F.col("line_start") + size).cast("long"), F.lit(1).cast("long"))
    return whole.unionByName(each.toDF(*names)).unionByName(sentences)


def rounded(name: str, digits: int) -> Column:
    """Half away from zero of the binary product, as the twins' engine rounds; F.round() takes the shortest decimal, and may see a tie where there is none."""
    return (F.round(F.col(name) * 10.0**digits) / 10.0**digits).alias(name)


def parts(spark: SparkSession, sf_dir: str):
    """tokens, lines, scopes, meaningful ranges and the fixed tau of all documents."""
    docs = files(spark, sf_dir)
    lines = tk.line_starts(docs)
    tau = docs.select("file_id", F.lit(TAU).alias("tau"))
    return tk.deterministic_tokens(docs), lines, scopes_of(lines, docs), tk.meaningful_ranges(lines), tau


def texts_scored(spark: SparkSession, sf_dir: str, *names: str, by_line: bool = False) -> DataFrame:
    """One row for each document, or for each of its lines that is not empty, with the named columns of the document."""
    return tx.analyze_texts(files(spark, sf_dir).select("file_id", *names, "text"), TAU, ALPHA, by_line)


# -- tokens and lines


@query("u01_provider_tokens", f"WITH {TOKENS} SELECT file_id, idx, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte, num FROM tok")
def provider_tokens(spark, sf_dir):
    return tk.deterministic_tokens(files(spark, sf_dir)).select("file_id", "idx", "start_byte", "end_byte", "num")


@query("a01_token_metrics", f"WITH {TOKENS} SELECT file_id, count(num) AS token_count, count(*) FILTER (num >= 72) AS high_entropy_tokens, round(CAST(sum(num) AS DOUBLE) / 30, 6) AS entropy_sum, round(CAST(count(*) FILTER (num >= 72) AS DOUBLE) / nullif(count(num), 0), 9) AS density, round(CAST(sum(num) AS DOUBLE) / 30 / nullif(count(num), 0), 6) AS mean_entropy FROM tok GROUP BY file_id")
def token_metrics(spark, sf_dir):
    """Sums are of whole numbers, divided once: the order of adding does not show. Without a scored token there is no sum."""
    m = tk.deterministic_tokens(files(spark, sf_dir)).groupBy("file_id").agg(F.count("num").alias("token_count"), F.count_if(F.col("entropy") >= TAU).alias("high_entropy_tokens"), (F.sum("num").cast("double") / 30).alias("entropy_sum"))
    total = F.nullif("token_count", F.lit(0))
    m = m.withColumns({"density": F.try_divide("high_entropy_tokens", total), "mean_entropy": F.try_divide("entropy_sum", total)})
    return m.select("file_id", "token_count", "high_entropy_tokens", rounded("entropy_sum", 6), rounded("density", 9), rounded("mean_entropy", 6))


@query("a03_percentile_tau", f"WITH {TOKENS} SELECT file_id, round(coalesce(quantile_cont(CAST(num AS DOUBLE) / 30, 0.67), 0), 9) AS tau FROM tok GROUP BY file_id")
def percentile_tau(spark, sf_dir):
    return un.percentile_tau(tk.deterministic_tokens(files(spark, sf_dir)), 67).select("file_id", F.round("tau", 9).alias("tau"))


@query("p12_high_entropy_filter", f"WITH {TOKENS} SELECT file_id, idx, num FROM tok WHERE num >= 72")
def high_entropy(spark, sf_dir):
    return tk.deterministic_tokens(files(spark, sf_dir)).where(F.col("entropy") >= TAU).select("file_id", "idx", "num")


@query("w06_line_starts", f"WITH files AS (SELECT doc_id AS file_id, text FROM documents), {LINES} SELECT file_id, line, line_start, CAST(octet_length(encode(line_text)) AS BIGINT) AS n_bytes FROM lines")
def lines_of(spark, sf_dir):
    return tk.line_starts(files(spark, sf_dir)).select("file_id", "line", "line_start", F.octet_length("line_text").cast("long").alias("n_bytes"))


@query("j05_meaningful_ranges", f"WITH files AS (SELECT doc_id AS file_id, text FROM documents), {LINES} SELECT file_id, CAST(rs AS BIGINT) AS start_byte, CAST(re AS BIGINT) AS end_byte FROM ranges")
def ranges_of(spark, sf_dir):
    return tk.meaningful_ranges(tk.line_starts(files(spark, sf_dir)))


@query("j01_token_line", f"WITH {TOKENS}, {LINES}, {LINED} SELECT file_id, idx, line, line_start FROM lined")
def token_line(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    return tk.token_lines(tokens, lines).select("file_id", "idx", "line", "line_start")


@query("w03_first_token_on_line", f"WITH {TOKENS}, {LINES}, {LINED} SELECT file_id, line, min(idx) AS first_idx FROM lined GROUP BY file_id, line")
def first_on_line(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    return tk.token_lines(tokens, lines).groupBy("file_id", "line").agg(F.min("line_first").alias("first_idx"))


@query("j02_byte_to_token", f"WITH {TOKENS}, {LINES}, counted AS (SELECT file_id, count(*) AS n FROM tok GROUP BY file_id) SELECT l.file_id, l.line, coalesce(least(n, (line_start + 2) // 3), 0) AS at_or_after FROM lines l LEFT JOIN counted USING (file_id)")
def byte_to_token(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    return tk.count_before(lines.select("file_id", "line", "line_start"), F.col("line_start"), tokens, "start_byte", False, "at_or_after").drop("line_start")


@query("j03_first_overlapping_token", f"WITH {TOKENS}, {LINES}, counted AS (SELECT file_id, count(*) AS n, max(end_byte) AS size FROM tok GROUP BY file_id) SELECT l.file_id, l.line, CASE WHEN n IS NULL THEN 0 WHEN line_start >= size THEN n ELSE line_start // 3 END AS overlapping FROM lines l LEFT JOIN counted USING (file_id)")
def overlapping_token(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    return tk.count_before(lines.select("file_id", "line", "line_start"), F.col("line_start"), tokens, "end_byte", True, "overlapping").drop("line_start")


@query("a05_line_metrics", f"WITH {TOKENS}, {LINES}, {LINED} SELECT file_id, line, CAST(max(num) AS DOUBLE) / 30 AS max_entropy, round(CAST(sum(num) AS DOUBLE) / 30 / count(num), 9) AS mean_entropy, round(CAST(sum(num) AS DOUBLE) / 30, 6) AS entropy_sum, count(*) FILTER (num >= 72) AS high FROM lined GROUP BY file_id, line HAVING count(num) > 0")
def line_metrics(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    m = analysis.line_metrics(tk.token_lines(tokens, lines), TAU)
    return m.select("file_id", "line", "max_entropy", F.round("mean_entropy", 9).alias("mean_entropy"), F.round("entropy_sum", 6).alias("entropy_sum"), "high")


@query("o01_hotspots", f"WITH {TOKENS}, {LINES}, {LINED}, m AS (SELECT file_id, line, max(num) AS top, CAST(sum(num) AS DOUBLE) / count(num) AS mean, count(*) FILTER (num >= 72) AS high FROM lined GROUP BY file_id, line HAVING count(num) > 0) SELECT file_id, line, CAST(top AS DOUBLE) / 30 AS max_entropy, high, row_number() OVER (PARTITION BY file_id ORDER BY top DESC, mean DESC, line) AS rank FROM m QUALIFY rank <= 10")
def hotspots(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    exact = tk.token_lines(tokens, lines).withColumn("entropy", F.col("num").cast("double"))
    found = analysis.hotspots(analysis.line_metrics(exact, 72), 10)
    return found.select("file_id", "line", (F.col("max_entropy") / 30).alias("max_entropy"), "high", F.col("rank").cast("long").alias("rank"))


# -- blocks and trees


@query("i01_boundaries", f"WITH {TOKENS}, {LINES}, {SCOPES}, {LINED}, {UNITS} SELECT file_id, CAST(b AS BIGINT) AS boundary FROM cuts")
def boundaries(spark, sf_dir):
    return un.boundaries(*parts(spark, sf_dir)).select("file_id", "boundary")


@query("w04_intervals", f"WITH {TOKENS}, {LINES}, {SCOPES}, {LINED}, {UNITS} SELECT file_id, CAST(a AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM gaps WHERE z IS NOT NULL")
def gaps(spark, sf_dir):
    order = Window.partitionBy("file_id").orderBy("boundary")
    return boundaries(spark, sf_dir).select("file_id", F.col("boundary").alias("a"), F.lead("boundary").over(order).alias("z")).where("z is not null")


@query("j04_unit_depth", f"WITH {TOKENS}, {LINES}, {SCOPES}, {LINED}, {UNITS} SELECT file_id, CAST(seq AS BIGINT) AS seq, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte, CAST(depth AS BIGINT) AS depth FROM units")
def unit_depth(spark, sf_dir):
    found = tx.blocks_of_texts(files(spark, sf_dir).select("file_id", "text"), TAU).select("file_id", F.posexplode(F.arrays_zip("starts", "ends", "depths")).alias("seq", "u"))
    return found.select("file_id", F.col("seq").cast("long").alias("seq"), F.col("u.starts").alias("start_byte"), F.col("u.ends").alias("end_byte"), F.col("u.depths").alias("depth"))


ANALYZED = f"WITH {TOKENS}, {LINES}, {SCOPES}, {LINED}, {UNITS}, {TREE}, m AS (SELECT file_id, count(num) AS tokens, sum(num) AS total FROM tok GROUP BY file_id), analyzed AS (SELECT m.file_id, coalesce(n, 0) AS n_units, coalesce(1 + lv, 1) AS level, tokens, total FROM m LEFT JOIN folded USING (file_id))"


@query("a02_lm_cc", ANALYZED + " SELECT file_id, CAST(n_units AS BIGINT) AS total_branch, CAST(level AS BIGINT) AS total_comp_level, round(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level, 6) AS tree_score, tokens AS token_count FROM analyzed")
def analyzed(spark, sf_dir):
    return texts_scored(spark, sf_dir).select("file_id", "total_branch", "total_comp_level", rounded("tree_score", 6), "token_count")


@query("a28_per_token_ratio", ANALYZED + " SELECT f.lang, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level) / nullif(sum(tokens), 0), 9) AS lmcc_per_token FROM analyzed a JOIN files f USING (file_id) GROUP BY f.lang")
def per_token(spark, sf_dir):
    ratio = F.try_divide(F.sum("tree_score"), F.nullif(F.sum("token_count"), F.lit(0)))
    scored = texts_scored(spark, sf_dir, "lang").groupBy("lang").agg(F.sum("token_count").alias("tokens"), ratio.alias("ratio"))
    return scored.select("lang", "tokens", rounded("ratio", 9).alias("lmcc_per_token"))


DEEP = "deep AS (SELECT user_id AS file_id, CAST(floor(value) AS BIGINT) % 8 AS depth, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)"


def deep_units(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "ts", "event_id", (F.floor("value") % 8).cast("long").alias("depth"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("ts", "event_id")) - 1).withColumn("end_byte", (F.col("seq") * 7 + F.col("depth")).cast("long"))


@query("i04_tree_levels", f"WITH {DEEP}, lists AS (SELECT file_id, list(depth ORDER BY seq) AS d FROM deep GROUP BY file_id), lv AS (SELECT file_id, unnest(range(1, len(d) + 1)) AS i, d FROM lists) SELECT file_id, CAST(i - 1 AS BIGINT) AS seq, CAST(2 + len(list_filter(range(1, i), lambda j: d[j] < list_min(d[j + 1 : i]))) AS BIGINT) AS level FROM lv")
def tree_levels(spark, sf_dir):
    return un.unit_nodes(deep_units(spark, sf_dir)).select("file_id", "seq", "level")


@query("j17_parent_links", f"WITH {DEEP}, near AS (SELECT u.file_id, u.seq, max(p.seq) AS parent_seq FROM deep u JOIN deep p ON p.file_id = u.file_id AND p.seq < u.seq AND p.depth < u.depth GROUP BY u.file_id, u.seq) SELECT d.file_id, CAST(d.seq AS BIGINT) AS seq, CAST(parent_seq AS BIGINT) AS parent_seq FROM deep d LEFT JOIN near n ON n.file_id = d.file_id AND n.seq = d.seq")
def parent_links(spark, sf_dir):
    return un.unit_nodes(deep_units(spark, sf_dir)).select("file_id", "seq", "parent_seq")


@query("a27_node_ends", f"WITH RECURSIVE {DEEP}, near AS (SELECT u.file_id, u.seq, max(p.seq) AS parent FROM deep u JOIN deep p ON p.file_id = u.file_id AND p.seq < u.seq AND p.depth < u.depth GROUP BY u.file_id, u.seq), up AS (SELECT file_id, seq, seq AS node, seq * 7 + depth AS e FROM deep UNION ALL SELECT up.file_id, up.seq, n.parent, up.e FROM up JOIN near n ON n.file_id = up.file_id AND n.seq = up.node), kids AS (SELECT file_id, parent AS node, count(*) AS k FROM near GROUP BY file_id, parent) SELECT u.file_id, CAST(u.node AS BIGINT) AS seq, CAST(max(e) AS BIGINT) AS node_end, CAST(coalesce(max(k), 0) AS BIGINT) AS branching FROM up u LEFT JOIN kids USING (file_id, node) GROUP BY u.file_id, u.node")
def node_ends(spark, sf_dir):
    return un.unit_nodes(deep_units(spark, sf_dir)).select("file_id", "seq", "node_end", "branching")


@query("i03_single_unit_suppression", ANALYZED + " SELECT n_units = 0 AS collapsed, count(*) AS n_files, round(sum(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level), 4) AS tree_score FROM analyzed GROUP BY 1")
def suppression(spark, sf_dir):
    scored = un.analyze(*parts(spark, sf_dir), alpha=ALPHA)
    return scored.groupBy((F.col("n_units") == 0).alias("collapsed")).agg(F.count("*").alias("n_files"), F.round(F.sum("tree_score"), 4).alias("tree_score"))


@query("i02_reference_mode", f"WITH {TOKENS}, {LINES}, {LINED}, hot AS (SELECT DISTINCT l.file_id, greatest(line_first, ss) AS b, ss, se FROM lined l JOIN bounds USING (file_id) WHERE idx >= ss + 1 AND idx < se AND num >= 72), marked AS (SELECT DISTINCT file_id FROM hot WHERE b = ss), cuts AS (SELECT file_id, b FROM hot WHERE b > ss AND b < se UNION SELECT file_id, ss FROM bounds UNION SELECT file_id, se FROM bounds), gaps AS (SELECT file_id, b AS a, lead(b) OVER w AS z, row_number() OVER w AS k FROM cuts WINDOW w AS (PARTITION BY file_id ORDER BY b)), kept AS (SELECT g.*, c.size FROM gaps g JOIN counted c USING (file_id) WHERE z IS NOT NULL AND (k > 1 OR file_id IN (SELECT file_id FROM marked))), near AS (SELECT k.file_id, a * 3 AS ta, least(z * 3, size) AS tz, min(rs) AS rs FROM kept k JOIN ranges r ON r.file_id = k.file_id AND r.re > a * 3 GROUP BY ALL) SELECT file_id, CAST(greatest(ta, rs) AS BIGINT) AS start_byte, CAST(least(tz, me) AS BIGINT) AS end_byte FROM near JOIN bounds USING (file_id) WHERE rs < tz")
def reference_mode(spark, sf_dir):
    return un.detect_units(*parts(spark, sf_dir), mode="reference").select("file_id", "start_byte", "end_byte")


# -- functions: a document's lines stand for its functions


FUNCS = """
spans AS (SELECT file_id, line, line_start AS a, line_start + octet_length(encode(line_text)) AS b FROM lines WHERE octet_length(encode(line_text)) > 0),
ftok AS (SELECT s.file_id, s.line, t.idx, greatest(t.start_byte, a) AS start_byte, t.end_byte, t.num FROM spans s JOIN tok t ON t.file_id = s.file_id AND t.end_byte > a AND t.start_byte < b)"""


def spans_of(lines: DataFrame) -> DataFrame:
    size = F.octet_length("line_text")
    return lines.where(size > 0).select("file_id", F.col("line").alias("function"), F.col("line_start").alias("a"), (F.col("line_start") + size).cast("long").alias("b"))


@query("j06_function_tokens", f"WITH {TOKENS}, {LINES}, {FUNCS} SELECT file_id, line AS function, idx, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte FROM ftok")
def function_tokens(spark, sf_dir):
    tokens, lines, *_ = parts(spark, sf_dir)
    return analysis.function_tokens(spans_of(lines), tokens).select("file_id", "function", "idx", "start_byte", "end_byte")


@query("j07_function_scopes", f"WITH files AS (SELECT doc_id AS file_id, text FROM documents), {LINES}, {SCOPES} SELECT f.file_id, f.line AS function, CAST(c.a AS BIGINT) AS scope_start, CAST(c.b AS BIGINT) AS byte_offset, CAST(c.depth AS BIGINT) AS depth FROM lines f JOIN scopes c ON c.file_id = f.file_id AND f.line_start <= c.a AND c.a < f.line_start + octet_length(encode(f.line_text)) AND c.b <= f.line_start + octet_length(encode(f.line_text)) WHERE octet_length(encode(f.line_text)) > 0")
def function_scopes(spark, sf_dir):
    _, lines, scopes, *_ = parts(spark, sf_dir)
    return analysis.function_scopes(spans_of(lines), scopes)


@query("j08_function_ranges", f"WITH files AS (SELECT doc_id AS file_id, text FROM documents), {LINES}, spans AS (SELECT file_id, line, line_start + 5 AS a, line_start + octet_length(encode(line_text)) AS b FROM lines WHERE octet_length(encode(line_text)) > 5) SELECT s.file_id, s.line AS function, CAST(greatest(a, rs) AS BIGINT) AS start_byte, CAST(least(b, re) AS BIGINT) AS end_byte FROM spans s JOIN ranges r ON r.file_id = s.file_id AND greatest(a, rs) < least(b, re)")
def function_ranges(spark, sf_dir):
    _, lines, _, ranges, _ = parts(spark, sf_dir)
    spans = spans_of(lines).withColumn("a", F.col("a") + 5).where("a < b")
    return analysis.function_ranges(spans, ranges)


OWN = """
fi AS (SELECT file_id, line, row_number() OVER (PARTITION BY file_id, line ORDER BY idx) - 1 AS i, start_byte, end_byte, num FROM ftok),
fr AS (SELECT s.file_id, s.line, greatest(a, rs) AS rs, least(b, re) AS re FROM spans s JOIN ranges r ON r.file_id = s.file_id AND greatest(a, rs) < least(b, re)),
fe AS (SELECT t.file_id, t.line, min(t.start_byte) AS t0, max(t.end_byte) AS t1, min(rs) AS r0, max(re) AS r1 FROM fi t LEFT JOIN fr USING (file_id, line) GROUP BY t.file_id, t.line),
fb AS (SELECT t.file_id, t.line, any_value(coalesce(r0, t0)) AS ms, any_value(coalesce(r1, t1)) AS me, any_value(r0 IS NOT NULL) AS ranged, count(*) FILTER (t.end_byte <= coalesce(r0, t0)) AS ss, count(*) FILTER (t.start_byte < coalesce(r1, t1)) AS se FROM fi t JOIN fe USING (file_id, line) GROUP BY t.file_id, t.line),
fs AS (SELECT s.file_id, s.line, c.a, c.b, c.depth FROM spans s JOIN scopes c ON c.file_id = s.file_id AND s.a <= c.a AND c.a < s.b AND c.b <= s.b),
fc AS (SELECT file_id, line, ss AS k FROM fb WHERE ss < se UNION SELECT file_id, line, se FROM fb WHERE ss < se
  UNION SELECT e.file_id, e.line, e.k FROM (SELECT x.file_id, x.line, x.b, (SELECT count(*) FROM fi t WHERE t.file_id = x.file_id AND t.line = x.line AND t.start_byte < x.b) AS k FROM (SELECT DISTINCT file_id, line, b FROM fs) x) e JOIN fb USING (file_id, line) WHERE e.k > ss AND e.k < se),
fg AS (SELECT file_id, line, k AS a, lead(k) OVER (PARTITION BY file_id, line ORDER BY k) AS z FROM fc),
ft AS (SELECT g.file_id, g.line, x.start_byte AS ta, least(y.end_byte, me) AS tz, y.end_byte AS raw_tz, ranged FROM fg g JOIN fi x ON x.file_id = g.file_id AND x.line = g.line AND x.i = g.a JOIN fi y ON y.file_id = g.file_id AND y.line = g.line AND y.i = g.z - 1 JOIN fb ON fb.file_id = g.file_id AND fb.line = g.line WHERE z IS NOT NULL),
fu AS (SELECT t.file_id, t.line, CASE WHEN ranged THEN greatest(ta, min(rs)) ELSE ta END AS s, tz AS e FROM ft t LEFT JOIN fr r ON r.file_id = t.file_id AND r.line = t.line AND r.re > t.ta GROUP BY t.file_id, t.line, ta, tz, raw_tz, ranged HAVING NOT ranged OR min(rs) < raw_tz),
fd AS (SELECT u.file_id, u.line, u.s, u.e, coalesce(max(c.depth), 0) AS depth FROM fu u LEFT JOIN fs c ON c.file_id = u.file_id AND c.line = u.line AND c.a <= u.s AND u.s < c.b GROUP BY u.file_id, u.line, u.s, u.e QUALIFY count(*) OVER (PARTITION BY u.file_id, u.line) > 1),
fl AS (SELECT file_id, line, list(depth ORDER BY s, e) AS d FROM fd GROUP BY file_id, line),
fv AS (SELECT file_id, line, len(d) AS n, list_sum(list_transform(range(1, len(d) + 1), lambda i: 2 + len(list_filter(range(1, i), lambda j: d[j] < list_min(d[j + 1 : i]))))) AS lv FROM fl),
fm AS (SELECT file_id, line, count(num) AS token_count, count(*) FILTER (num >= 72) AS high, CAST(coalesce(sum(num), 0) AS DOUBLE) / 30 AS total FROM ftok GROUP BY file_id, line)"""


@query("a06_function_metrics", f"WITH {TOKENS}, {LINES}, {SCOPES}, {FUNCS}, {OWN} SELECT file_id, line AS function, token_count, high AS high_entropy_tokens, round(total, 6) AS entropy_sum, CAST(coalesce(n, 0) AS BIGINT) AS total_branch, CAST(coalesce(1 + lv, 1) AS BIGINT) AS total_comp_level, round(CAST(0.8 AS DOUBLE) * coalesce(n, 0) + CAST(0.2 AS DOUBLE) * coalesce(1 + lv, 1), 6) AS tree_score FROM fm LEFT JOIN fv USING (file_id, line)")
def function_metrics(spark, sf_dir):
    scored = texts_scored(spark, sf_dir, by_line=True)
    return scored.select("file_id", "function", "token_count", "high_entropy_tokens", rounded("entropy_sum", 6), "total_branch", "total_comp_level", rounded("tree_score", 6))


# -- totals


@query("a07_project_totals", ANALYZED + " SELECT count(*) AS analyzed, sum(tokens)::BIGINT AS token_count, sum(n_units)::BIGINT AS total_branch, round(avg(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level), 6) AS mean_tree_score FROM analyzed")
def project_totals(spark, sf_dir):
    t = analysis.project_totals(texts_scored(spark, sf_dir))
    return t.select("analyzed", "token_count", "total_branch", rounded("mean_tree_score", 6))


@query("a08_grouped_totals", f"WITH {TOKENS}, m AS (SELECT file_id, count(num) AS tokens, count(*) FILTER (num >= 72) AS high FROM tok GROUP BY file_id), f AS (SELECT file_id, lang, source, octet_length(encode(text)) > 10000 AS failed FROM files) SELECT lang, source, count(*) AS discovered, count(*) FILTER (NOT failed) AS analyzed, count(*) FILTER (failed) AS failed, coalesce(sum(tokens) FILTER (NOT failed), 0)::BIGINT AS token_count, coalesce(sum(high) FILTER (NOT failed), 0)::BIGINT AS high_entropy_tokens FROM f LEFT JOIN m USING (file_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def grouped_totals(spark, sf_dir):
    docs = files(spark, sf_dir)
    tokens = tk.deterministic_tokens(docs)
    scored = un.token_metrics(tokens, docs.select("file_id", F.lit(TAU).alias("tau")))
    rows = docs.select("file_id", "lang", "source", (F.octet_length("text") > 10000).alias("failed")).join(scored, "file_id", "left")
    return analysis.grouped_totals(rows, "lang", "source")


@query("p18_score_mode", ANALYZED + " SELECT file_id, round(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level, 6) AS raw, CASE WHEN tokens > 0 THEN round((CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level) / tokens, 9) END AS lmcc, CASE WHEN tokens > 0 THEN round(CAST(total AS DOUBLE) / 30 / tokens, 6) END AS mean FROM analyzed")
def score_modes(spark, sf_dir):
    scored = texts_scored(spark, sf_dir)
    modes = scored.select("file_id", *(analysis.score_mode(m).alias(m) for m in ("raw", "lmcc", "mean")))
    return modes.select("file_id", rounded("raw", 6), rounded("lmcc", 9), rounded("mean", 6))


@query("o07_top_documents", ANALYZED + " SELECT file_id, round(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level, 6) AS tree_score, tokens AS token_count FROM analyzed ORDER BY round(CAST(0.8 AS DOUBLE) * n_units + CAST(0.2 AS DOUBLE) * level, 6) DESC, file_id LIMIT 20")
def top_documents(spark, sf_dir):
    """The flagship: documents by score, the top twenty."""
    return analyzed(spark, sf_dir).select("file_id", "tree_score", "token_count").orderBy(F.col("tree_score").desc(), "file_id").limit(20)


# -- records: alignment and validation, over conversations as ordered records


TURNS = "t AS (SELECT conv_id AS file_id, turn AS position, text, octet_length(encode(text)) AS n, CASE WHEN turn > 0 THEN CAST(octet_length(encode(text)) % 97 AS DOUBLE) / 30 END AS entropy FROM conversations)"


def records(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("position"), F.col("text").cast("binary").alias("bytes"), F.when(F.col("turn") > 0, (size % 97).cast("double") / 30).alias("entropy"))


@query("w05_running_offsets", f"WITH {TURNS} SELECT file_id, position AS idx, CAST(coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, CAST(sum(n) OVER (PARTITION BY file_id ORDER BY position) AS BIGINT) AS end_byte FROM t")
def running_offsets(spark, sf_dir):
    return tk.align_records(records(spark, sf_dir)).drop("entropy")


@query("i06_token_alignment", f"WITH {TURNS} SELECT file_id, position AS idx, CAST(coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, CAST(sum(n) OVER (PARTITION BY file_id ORDER BY position) AS BIGINT) AS end_byte FROM t")
def alignment(spark, sf_dir):
    plain = records(spark, sf_dir)
    source = plain.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("bytes").cast("string").alias("s")))), lambda x: x["s"]), "").alias("text"))
    odd = plain.withColumn("bytes", F.when(F.col("position") == 0, F.concat(F.lit(" ").cast("binary"), F.col("bytes"))).otherwise(F.col("bytes")))
    return tk.align_records(odd, source).drop("entropy")


@query("v01_positions", f"WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY position) - 1 AS k FROM t) SELECT file_id, count(*) AS n_records, count(*) FILTER (k <> position) AS position_faults, count(*) FILTER (entropy IS NULL AND position <> 0 OR entropy < 0) AS entropy_faults FROM n GROUP BY file_id")
def positions(spark, sf_dir):
    return tk.record_faults(records(spark, sf_dir))


@query("v04_entropy_domain", "WITH e AS (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, CASE WHEN event_type = 'view' THEN NULL ELSE value - 20 END AS entropy FROM events) SELECT file_id, count(*) AS n_records, count(*) FILTER (entropy IS NULL AND position <> 0 OR entropy < 0) AS entropy_faults FROM e GROUP BY file_id")
def entropy_domain(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), (F.row_number().over(order) - 1).alias("position"), F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value") - 20).alias("entropy"))
    return tk.record_faults(rows).select("file_id", "n_records", "entropy_faults")


@query("v02_token_order", "WITH e AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS idx, CAST(l_partkey AS BIGINT) AS a, CAST(l_partkey + l_quantity - 5 AS BIGINT) AS b FROM lineitem), w AS (SELECT *, lag(b) OVER (PARTITION BY file_id ORDER BY idx) AS p FROM e) SELECT file_id, count(*) FILTER (b <= a OR a < p) AS token_faults FROM w GROUP BY file_id")
def token_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("idx"), F.col("l_partkey").alias("start_byte"), (F.col("l_partkey") + F.col("l_quantity") - 5).cast("long").alias("end_byte"))
    return tk.token_faults(rows)


_SPOILT = "SELECT file_id, position, CASE WHEN file_id % 5 = 1 AND position = 1 THEN 'zz' ELSE text END AS text FROM t WHERE file_id % 5 <> 2 OR position <> 1"


@query("v03_byte_cover", f"WITH {TURNS}, m AS ({_SPOILT}), a AS (SELECT file_id, string_agg(text, '' ORDER BY position) AS whole FROM t GROUP BY file_id), b AS (SELECT file_id, string_agg(text, '' ORDER BY position) AS made FROM m GROUP BY file_id) SELECT file_id, whole = made AS covered FROM a JOIN b USING (file_id)")
def byte_cover(spark, sf_dir):
    """Records of which some have a wrong piece and some lack one."""
    plain = records(spark, sf_dir)
    source = plain.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("bytes").cast("string").alias("s")))), lambda x: x["s"]), "").alias("text"))
    spoilt = plain.where("file_id % 5 <> 2 or position <> 1").withColumn("bytes", F.when(F.expr("file_id % 5 = 1 and position = 1"), F.lit("zz").cast("binary")).otherwise(F.col("bytes")))
    return tk.coverage_faults(spoilt, source)
