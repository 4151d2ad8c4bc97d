"""Blocks of a token stream, their nesting depth, and the score of the tree they form.

Works per `file_id`; a function span is scored by giving it a file_id of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .tokens import as_of

#: Scopes are cut into cells of 2**level bytes, so many levels: files up to 2**LEVELS bytes.
LEVELS = 31


def innermost_depth(points: DataFrame, at: Column, scopes: DataFrame) -> DataFrame:
    """Points (distinct rows) with depth = the greatest depth of scopes [scope_start, byte_offset) that contain `at`, 0 if none (j04).

    An interval is a disjoint union of at most two aligned cells per power of two; a point lies in
    one cell per power. So containment is an equi-join on (file, level, cell): a huge file's
    scopes and units are spread by cell, and no pair is made that does not match.
    """
    lo = "ceil(scope_start / shiftleft(1L, l))"
    hi = "floor(byte_offset / shiftleft(1L, l))"
    cells = F.expr(f"flatten(transform(sequence(0, {LEVELS - 1}), l -> filter(array(if({lo} < {hi} and {lo} % 2 = 1, struct(l, bigint({lo}) as c), null), if({lo} < {hi} and {hi} % 2 = 1, struct(l, bigint({hi}) - 1 as c), null)), x -> x is not null)))")
    cut = scopes.where("scope_start < byte_offset").select("file_id", "depth", F.explode(cells).alias("s")).groupBy("file_id", F.col("s.l").alias("_l"), F.col("s.c").alias("_c")).agg(F.max("depth").alias("_d"))
    # a point is looked up on the levels that its file has cells on, not on all
    levels = cut.groupBy("file_id").agg(F.collect_set("_l").alias("_ls"))
    names = [c for c in points.columns if c != "file_id"]
    keyed = points.withColumn("_at", at).join(levels, "file_id", "left")
    probe = keyed.select(*points.columns, F.explode_outer(F.transform("_ls", lambda x: F.struct(x.alias("l"), F.call_function("shiftright", F.col("_at"), x).alias("c")))).alias("_s")).select(*points.columns, F.col("_s.l").alias("_l"), F.col("_s.c").alias("_c"))
    hits = probe.join(cut, ["file_id", "_l", "_c"], "left").groupBy("file_id", *names).agg(F.coalesce(F.max("_d"), F.lit(0)).cast("long").alias("depth"))
    return hits.select(*points.columns, "depth")


def percentile_tau(tokens: DataFrame, percent: float) -> DataFrame:
    """file_id, tau: the exact percentile of all scored tokens, linearly interpolated; 0 where none are scored."""
    return tokens.groupBy("file_id").agg(F.coalesce(F.percentile("entropy", F.lit(percent / 100.0)), F.lit(0.0)).alias("tau"))


def boundaries(tokens: DataFrame, lines: DataFrame, scopes: DataFrame, ranges: DataFrame, tau: DataFrame, mode: str = "structural", starts: bool = True) -> DataFrame:
    """file_id, boundary (token index), ta (its start), tz_before (the end of the token before it), and per file me, mark (a hot line was
    dropped at the source's start) and has_ranges (i01).

    Tokens, line starts, scope ends and a row of each file's limits (first of all) are one stream of
    events per file: one shuffle, one sort, and all lookups are running windows in that order; no
    frame looks at a whole file. Events at one byte come in the order scope end, line start, token.
    A token is told by bytes: it lies before the source if it ends by ms, beyond it if it starts at me.
    """
    limit, end, start, token = range(4)
    none = lambda kind: F.lit(None).cast(kind)
    limits = "struct<tau:double,ms:bigint,me:bigint>"
    row = lambda df, kind, x, e=none("long"), i=none("long"), h=none("double"), f=none(limits): df.select("file_id", F.lit(kind).alias("k"), x.cast("long").alias("x"), e.cast("long").alias("e"), i.cast("long").alias("idx"), h.cast("double").alias("h"), f.cast(limits).alias("f"))
    known = tau.select("file_id", "tau").join(ranges.groupBy("file_id").agg(F.min("start_byte").alias("ms"), F.max("end_byte").alias("me")), "file_id", "left")
    events = row(tokens, token, F.col("start_byte"), F.col("end_byte"), F.col("idx"), F.col("entropy"))
    events = events.unionAll(row(lines, start, F.col("line_start"))).unionAll(row(known, limit, F.lit(-1), f=F.struct("tau", "ms", "me")))
    if mode == "structural":
        events = events.unionAll(row(scopes, end, F.col("byte_offset")))
    is_ = lambda kind: F.col("k") == kind
    order = Window.partitionBy("file_id").orderBy("x", "k")
    upto, past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda c, over: F.last(c, ignorenulls=True).over(over)
    events = events.withColumns({"f": latest(F.col("f"), upto), "n_past": F.count_if(is_(token)).over(past), "end_past": F.max(F.when(is_(token), F.col("e"))).over(past), "n_ends": F.count_if(is_(end)).over(upto)})
    events = events.withColumns({"line_n": latest(F.when(is_(start), F.col("n_past")), upto), "ends_past": latest(F.when(is_(token), F.col("n_ends")), past)})
    ms, me = F.col("f.ms"), F.col("f.me")
    within = ms.isNull() | (F.col("e") > ms)
    after = (F.col("n_past") > 0) & (ms.isNull() | (F.col("end_past") > ms))  # the token before it is within, too
    found = events.where(is_(token)).withColumn("own", F.struct(F.col("idx").alias("i"), F.col("x").alias("x"), F.col("end_past").alias("e")))
    found = found.withColumns({"line_token": latest(F.when(F.col("n_past") == F.col("line_n"), F.col("own")), upto), "first_token": latest(F.when(within & ~after, F.col("own")), upto), "next_x": F.lead("x").over(order)})
    inside = me.isNull() | (F.col("x") < me)
    hot = inside & (after if starts else within) & (F.col("h") >= F.col("f.tau"))
    at = F.when(F.col("line_token.i") >= F.col("first_token.i"), F.col("line_token")).otherwise(F.col("first_token"))
    cut = lambda i, is_hot, ta, before: F.struct(i.cast("long").alias("boundary"), F.lit(is_hot).alias("hot"), ta.cast("long").alias("ta"), before.cast("long").alias("tz_before"))
    made = F.array(
        F.when(hot, cut(at["i"], True, at["x"], at["e"])),
        F.when(inside & after & (F.col("n_ends") > F.col("ends_past")), cut(F.col("idx"), False, F.col("x"), F.col("end_past"))),
        F.when(inside & within & ~after, cut(F.col("idx"), False, F.col("x"), F.col("end_past"))),
        F.when(inside & (F.col("next_x").isNull() | F.coalesce(F.col("next_x") >= me, F.lit(False))), cut(F.col("idx") + 1, False, none("long"), F.greatest("end_past", "e"))),
    )
    rows = found.select("file_id", me.alias("me"), F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m"), F.col("first_token.i").alias("ss")).select("file_id", "me", "ss", "m.*")
    kept = rows.groupBy("file_id", "boundary").agg(*(F.max(c).alias(c) for c in ("me", "hot", "ta", "tz_before", "ss")))
    marked = F.max(F.when(F.col("boundary") == F.col("ss"), F.col("hot"))).over(Window.partitionBy("file_id"))
    return kept.withColumns({"mark": F.coalesce(marked, F.lit(False)), "has_ranges": F.col("me").isNotNull()}).drop("hot", "ss")


def detect_units(tokens: DataFrame, lines: DataFrame, scopes: DataFrame, ranges: DataFrame, tau: DataFrame, mode: str = "structural", starts: bool = True) -> DataFrame:
    """file_id, seq, start_byte, end_byte, depth of the blocks (i01-i03, w04, j04, j05)."""
    order = Window.partitionBy("file_id").orderBy("boundary")
    cuts = boundaries(tokens, lines, scopes, ranges, tau, mode, starts).withColumns({"z": F.lead("boundary").over(order), "tz": F.lead("tz_before").over(order), "_k": F.row_number().over(order)}).where("z is not null")
    if mode == "reference":
        cuts = cuts.where("_k > 1 or mark")
    placed = cuts.select("file_id", "ta", "tz", "me", "has_ranges")
    near = as_of(placed, F.col("ta"), ranges.select("file_id", F.col("start_byte").alias("rs"), F.col("end_byte").alias("re")), F.col("re"), ["rs"], forward=True, strict=True)
    units = near.where("not has_ranges or (rs is not null and rs < tz)").select("file_id", F.greatest("ta", "rs").alias("start_byte"), F.least("tz", "me").alias("end_byte"))
    units = innermost_depth(units, F.col("start_byte"), scopes)
    if mode == "structural":
        units = units.withColumn("_n", F.count("*").over(Window.partitionBy("file_id"))).where("_n > 1").drop("_n")
    return units.withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("start_byte", "end_byte")) - 1).select("file_id", "seq", "start_byte", "end_byte", "depth")


SUM_FOLD = """aggregate(d, named_struct('st', cast(array() as array<bigint>), 'lv', 0L, 'most', 0L),
  (a, x) -> named_struct('st', concat(filter(a.st, y -> y < x), array(x)), 'lv', a.lv + 2L + size(filter(a.st, y -> y < x)), 'most', greatest(a.most, 2L + size(filter(a.st, y -> y < x)))))"""


def depths_in_order(units: DataFrame, order: str = "seq") -> DataFrame:
    return units.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "depth"))), lambda x: x["depth"]).alias("d"))


def score_trees(units: DataFrame, alpha: float = 0.8, order: str = "seq") -> DataFrame:
    """file_id, n_units, total_level (units only), max_level, total_branch, total_comp_level, tree_score for files with units (a02, i04).

    Total branching is the number of units, each being one node's child; the levels come from one
    fold over the depths, whose stack is what would be the open nodes.
    """
    folded = depths_in_order(units, order).select("file_id", F.size("d").cast("long").alias("n_units"), F.expr(SUM_FOLD).alias("f"))
    branch, comp = F.col("n_units"), F.col("f.lv") + 1
    score = F.lit(alpha) * branch + F.lit(1 - alpha) * comp
    return folded.select("file_id", "n_units", F.col("f.lv").alias("total_level"), F.col("f.most").alias("max_level"), branch.alias("total_branch"), comp.alias("total_comp_level"), score.alias("tree_score"))


def unit_nodes(units: DataFrame, order: str = "seq") -> DataFrame:
    """Flat tree: file_id, seq, level, parent_seq (null: the root), branching, node_end (greatest end of itself and what is below) (i04, j17, a27).

    The parent of a unit is the nearest earlier one with a smaller depth. A file's units pass one
    task in order; a stack of open nodes is all that it holds, and a node is written when it closes.
    """
    rows = units.select("file_id", F.col(order).cast("long").alias("i"), F.col("depth").cast("long").alias("d"), F.col("end_byte").cast("long").alias("e"))
    schema = StructType([StructField("file_id", rows.schema["file_id"].dataType), *(StructField(c, LongType()) for c in ("seq", "parent_seq", "level", "branching", "node_end"))])
    key_type = to_arrow_type(rows.schema["file_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, out = None, [], []  # of an open node: seq, depth, children, greatest end

        def close(depth: int | None) -> None:
            while stack and (depth is None or stack[-1][1] >= depth):
                seq, _, children, end = stack.pop()
                out.append((at, seq, stack[-1][0] if stack else None, len(stack) + 2, children, end))
                if stack:
                    stack[-1][3] = max(stack[-1][3], end)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], key_type), *(pa.array([r[k] for r in out], pa.int64()) for k in range(1, 6))], names=schema.names)
            out.clear()
            return made

        for batch in batches:
            for file_id, i, d, e in zip(*(c.to_pylist() for c in batch.columns)):
                if file_id != at:
                    close(None)
                    at = file_id
                else:
                    close(d)
                if stack:
                    stack[-1][2] += 1
                stack.append([i, d, 0, e])
            yield flush()
        close(None)
        yield flush()

    return rows.repartition("file_id").sortWithinPartitions("file_id", "i").mapInArrow(run, schema)


def token_metrics(tokens: DataFrame, tau: DataFrame) -> DataFrame:
    """file_id, token_count, high_entropy_tokens, entropy_sum over all scored tokens (a01)."""
    return tokens.join(tau, "file_id").groupBy("file_id").agg(F.count("entropy").alias("token_count"), F.count_if(F.col("entropy") >= F.col("tau")).alias("high_entropy_tokens"), F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("entropy_sum"))


def analyze(tokens: DataFrame, lines: DataFrame, scopes: DataFrame, ranges: DataFrame, tau: DataFrame, alpha: float = 0.8, mode: str = "structural", starts: bool = True) -> DataFrame:
    """One row per file: units, branch and level totals, score and token metrics.

    A file with tokens or ranges but without units is its root alone: score 1 - alpha.
    """
    trees = score_trees(detect_units(tokens, lines, scopes, ranges, tau, mode, starts), alpha)
    out = token_metrics(tokens, tau).join(trees, "file_id", "left")
    n, level = F.coalesce("n_units", F.lit(0)), F.coalesce("total_comp_level", F.lit(1))
    score = F.coalesce("tree_score", F.lit(1 - alpha))
    return out.select("file_id", n.alias("n_units"), n.alias("total_branch"), level.alias("total_comp_level"), score.alias("tree_score"), "token_count", "high_entropy_tokens", "entropy_sum", F.try_divide(score, F.nullif("token_count", F.lit(0))).alias("lmcc_per_token"), F.try_divide(F.col("high_entropy_tokens").cast("double"), F.nullif("token_count", F.lit(0))).alias("density"), F.try_divide(F.col("entropy_sum"), F.nullif("token_count", F.lit(0))).alias("mean_entropy"))
