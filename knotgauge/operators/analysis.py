"""Rollups of scored tokens: lines, hotspots, functions, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import token_lines  # noqa: F401  (its result is what line_metrics takes)
from .units import analyze


def line_metrics(lined: DataFrame, tau: float) -> DataFrame:
    """Greatest, mean and summed entropy and high tokens of each line with a scored token (a05)."""
    scored = lined.where("entropy is not null")
    return scored.groupBy("file_id", "line").agg(F.max("entropy").alias("max_entropy"), F.avg("entropy").alias("mean_entropy"), F.sum("entropy").alias("entropy_sum"), F.count_if(F.col("entropy") >= tau).alias("high"))


def hotspots(metrics: DataFrame, k: int = 10) -> DataFrame:
    """The k lines of each file with the greatest maximum, then mean, then the first (o01). k = 0: none."""
    order = Window.partitionBy("file_id").orderBy(F.col("max_entropy").desc(), F.col("mean_entropy").desc(), "line")
    return metrics.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


CELL = 1 << 12


def _by_cell(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows once for each CELL bytes that [a, b) touches: the key of overlap joins."""
    return rows.withColumn("_cell", F.explode(F.sequence(F.expr(f"{a} div {CELL}"), F.expr(f"greatest({b} - 1, {a}) div {CELL}"))))


def function_tokens(functions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(file_id, function, a, b) -> the tokens that overlap each span, the first clipped to it (j06)."""
    spans = _by_cell(functions, "a", "b")
    keyed = _by_cell(tokens.withColumn("_s", F.col("start_byte")).withColumn("_e", F.col("end_byte")), "_s", "_e")
    both = spans.join(keyed, ["file_id", "_cell"]).where("_e > a and _s < b and _cell = greatest(a, _s) div " + str(CELL))
    return both.withColumn("start_byte", F.greatest("a", "_s")).drop("_cell", "_s", "_e", "a", "b")


def function_scopes(functions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes wholly inside each span (j07)."""
    keyed = scopes.withColumn("_cell", F.expr(f"scope_start div {CELL}"))
    both = _by_cell(functions, "a", "b").join(keyed, ["file_id", "_cell"]).where("a <= scope_start and scope_start < b and byte_offset <= b")
    return both.select("file_id", "function", "scope_start", "byte_offset", "depth")


def function_ranges(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges cut to each span; empty ones go (j08)."""
    keyed = _by_cell(ranges, "start_byte", "end_byte")
    both = _by_cell(functions, "a", "b").join(keyed, ["file_id", "_cell"]).where(f"greatest(a, start_byte) < least(b, end_byte) and _cell = greatest(a, start_byte) div {CELL}")
    return both.select("file_id", "function", F.greatest("a", "start_byte").alias("start_byte"), F.least("b", "end_byte").alias("end_byte"))


def score_functions(functions: DataFrame, tokens: DataFrame, lines: DataFrame, scopes: DataFrame, ranges: DataFrame, tau: float, alpha: float) -> DataFrame:
    """The whole analysis per span, at the file's threshold (a06). Spans become files of their own: one plan for all."""
    own = F.struct("file_id", "function")
    retag = lambda df: df.withColumn("file_id", own).drop("function")
    inner = retag(function_tokens(functions, tokens))
    inner = inner.withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("idx")) - 1)
    line_marks = lines.select("file_id", "line", "line_start", F.lead("line_start").over(Window.partitionBy("file_id").orderBy("line")).alias("_next"))
    own_lines = functions.join(line_marks, "file_id").where("line_start < b and (_next is null or _next > a)").select("file_id", "function", "line", F.greatest("line_start", "a").alias("line_start"))
    spans = retag(functions.select("file_id", "function")).withColumn("tau", F.lit(tau))
    scored = analyze(inner, retag(own_lines), retag(function_scopes(functions, scopes)), retag(function_ranges(functions, ranges)), spans, alpha, starts=False)
    return scored.select(F.col("file_id.file_id").alias("file_id"), F.col("file_id.function").alias("function"), *(c for c in scored.columns if c != "file_id"))


def project_totals(scored: DataFrame) -> DataFrame:
    """Sums over files; the mean score is over analyzed files (a07)."""
    return scored.agg(F.count("*").alias("analyzed"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("token_count"), F.coalesce(F.sum("high_entropy_tokens"), F.lit(0)).alias("high_entropy_tokens"), F.coalesce(F.sum("entropy_sum"), F.lit(0.0)).alias("entropy_sum"), F.coalesce(F.sum("total_branch"), F.lit(0)).alias("total_branch"), F.coalesce(F.sum("tree_score"), F.lit(0.0)).alias("tree_score"), F.avg("tree_score").alias("mean_tree_score"))


def grouped_totals(files: DataFrame, first: str, second: str) -> DataFrame:
    """Discovered, analyzed and failed files and token sums by each of two keys, and in all: one expansion, one shuffle (a08)."""
    good = ~F.col("failed")
    sets = files.groupingSets([[F.col(first)], [F.col(second)], []], first, second)
    return sets.agg(F.count("*").alias("discovered"), F.count_if(good).alias("analyzed"), F.count_if("failed").alias("failed"), F.coalesce(F.sum(F.when(good, F.col("token_count"))), F.lit(0)).alias("token_count"), F.coalesce(F.sum(F.when(good, F.col("high_entropy_tokens"))), F.lit(0)).alias("high_entropy_tokens"))


def score_mode(mode: str) -> Column:
    """raw, lmcc (per token), density or mean; all but raw null without tokens (p18)."""
    if mode == "raw":
        return F.col("tree_score")
    return F.when(F.col("token_count") > 0, F.col({"lmcc": "lmcc_per_token", "density": "density", "mean": "mean_entropy"}[mode]))
