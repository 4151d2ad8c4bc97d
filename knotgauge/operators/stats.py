"""Inference arithmetic and agreement between scoring runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def softmax_statistics(logits: str, target: str) -> list[Column]:
    """log_probability, probability and entropy of a row of logits, shifted by its maximum; -inf is masked; NaN or +inf gives null (a15)."""
    x = f"transform({logits}, v -> double(v))"
    bad = f"exists({logits}, v -> isnan(v) or double(v) = double('Infinity'))"
    z = f"aggregate({x}, 0D, (a, v) -> a + exp(v - double(array_max({logits}))))"
    w = f"aggregate({x}, 0D, (a, v) -> a + if(v = double('-Infinity'), 0D, exp(v - double(array_max({logits}))) * (v - double(array_max({logits})))))"
    lp = f"double({logits}[{target}]) - double(array_max({logits})) - ln({z})"
    return [F.expr(f"if({bad}, null, {e})").alias(n) for e, n in ((lp, "log_probability"), (f"exp({lp})", "probability"), (f"ln({z}) - {w} / {z}", "entropy"))]


def perplexity(log_probability: Column) -> Column:
    return F.exp(F.avg(-log_probability))


def inference_windows(counts: DataFrame, context: int) -> DataFrame:
    """(id, token_count) -> windows of at most `context` tokens, half overlapping, each target emitted once (w07)."""
    if context < 2:
        raise ValueError("a context holds two tokens at least")
    n, stride = F.col("token_count"), context // 2
    many = window_count(n, context)
    each = counts.where("token_count >= 2").withColumn("window", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))
    begin = F.col("window") * stride
    end = F.least("token_count", begin + context)
    first = F.when(F.col("window") == 0, F.lit(1)).otherwise(F.least(F.col("token_count"), begin - stride + context))
    return each.select("id", "window", begin.cast("long").alias("token_begin"), end.cast("long").alias("token_end"), first.cast("long").alias("scored_target_begin"))


def window_count(n: Column, context: int) -> Column:
    """w08."""
    stride = context // 2
    return F.when(n < 2, F.lit(0)).when(n <= context, F.lit(1)).otherwise(F.floor((n - context - 1) / stride) + 2).cast("long")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean (w09)."""
    ordered = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation per group; null where a side does not vary (a18)."""
    both = rows.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    varies = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    return both.groupBy(*by).agg(F.when(varies, F.corr("_x", "_y")).alias("rho"))


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, by: list[str]) -> DataFrame:
    """Rank correlation of x and y with z held; null where the denominator is at most 1e-12 (a19)."""
    r = rows.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by)).withColumn("_z", average_rank(z, by))
    flat = F.least(F.stddev_pop("_x"), F.stddev_pop("_y"), F.stddev_pop("_z")) > 0
    c = r.groupBy(*by).agg(*(F.when(flat, F.corr(a, b)).alias(n) for a, b, n in (("_x", "_y", "xy"), ("_x", "_z", "xz"), ("_y", "_z", "yz"))))
    under = F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)))
    return c.select(*by, F.when(under > 1e-12, F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), under)).alias("rho"))


def inverse_percentile(rows: DataFrame, value: str, target: float, by: list[str]) -> DataFrame:
    """The percentile at which the interpolated value is `target`; 0 or 100 beyond the ends, the lower side of ties (a04)."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    k = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", n).withColumn("_p", F.lag(value).over(w))
    v = F.col(value)
    place = F.when(v == target, F.col("_k").cast("double")).otherwise(F.col("_k") - 1 + (F.lit(target) - F.col("_p")) / (v - F.col("_p")))
    hit = k.where((v >= target) & (F.col("_p").isNull() | (F.col("_p") < target))).groupBy(*by).agg(F.min(F.when(F.col("_k") == 0, F.lit(0.0)).otherwise(place * 100.0 / (F.col("_n") - 1))).alias("percentile"))
    return rows.select(*by).distinct().join(hit, by, "left").select(*by, F.coalesce("percentile", F.lit(100.0)).alias("percentile"))


def bootstrap_interval(rows: DataFrame, x: str, y: str, by: list[str], resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Interval of the rank correlation of each group (a scoring run's files) under resampling, and how many resamples have one (a20).

    Draws are made on executors, seeded by the group's hash: the same whatever the partitions.
    """

    def interval(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values(["_x", "_y"])
        n, rng, rho = len(run), np.random.default_rng([seed, int(run["_key"].iloc[0]) % 2**64]), []
        step = max(1, 2_000_000 // n)
        for start in range(0, resamples, step):
            k = min(step, resamples - start)
            drawn = rng.integers(0, n, (k, n)) + np.arange(k)[:, None] * n
            times = np.bincount(drawn.ravel(), minlength=k * n).reshape(k, n)
            a, b = (_centred_ranks(run[c].to_numpy(), times) for c in ("_x", "_y"))
            xy, xx, yy = ((times * p * q).sum(1) for p, q in ((a, b), (a, a), (b, b)))
            varies = (xx > 0) & (yy > 0)
            rho.append(xy[varies] / np.sqrt(xx[varies] * yy[varies]))
        a = np.sort(np.concatenate(rho))
        at = lambda p: a[int((len(a) - 1) * p)] if len(a) else None
        return run[by].head(1).assign(low=at((1 - level) / 2), high=at((1 + level) / 2), n=len(a))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    keyed = rows.select(*by, F.xxhash64(*by).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return keyed.groupBy(*by).applyInPandas(interval, f"{types}, low double, high double, n long")


def _centred_ranks(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ranks less their mean, ties at their mean, where each row of times takes the values so often."""
    order = np.argsort(values, kind="stable")
    _, first, back = np.unique(values[order], return_index=True, return_inverse=True)
    many = np.add.reduceat(times[:, order], first, axis=1)
    ranks = (many.cumsum(1) - (many - 1) / 2.0)[:, back]
    out = np.empty_like(ranks)
    out[:, order] = ranks
    return out - (times.sum(1, keepdims=True) + 1) / 2.0


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared share of a (e04, e05)."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(F.size(a), F.lit(0)))


def memory_fits(model_bytes: Column, host: Column, gpu: Column, use_gpu: Column) -> Column:
    """v09: weights and a tenth; half a GiB for the context. On a GPU the weights count there, the context on the host."""
    weights, context = F.floor(model_bytes * 1.1).cast("long"), F.lit(512 << 20)
    return F.when(use_gpu, (context <= host) & F.coalesce(weights <= gpu, F.lit(False))).otherwise(weights + context <= host)


def repeat_difference(rows: DataFrame, value: str, by: list[str], run: str) -> DataFrame:
    """The greatest absolute difference of a value across repetitions (a21): (by, n_runs, most). One aggregation: the extremes are the greatest difference."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_distinct(run).alias("n_runs"), (F.max(value) - F.min(value)).alias("most"))


def pair_functions(a: DataFrame, b: DataFrame, least_tokens: int = 100) -> DataFrame:
    """Functions of two runs (path, name, start_line, end_line, token_count, tree_score) that are the same place, with `least_tokens` in both (j18)."""
    key = ["path", "name", "start_line", "end_line"]
    other = b.where(F.col("token_count") >= least_tokens).select(*key, F.col("token_count").alias("other_tokens"), F.col("tree_score").alias("other_score"))
    return a.where(F.col("token_count") >= least_tokens).join(other, key)


def top_set(rows: DataFrame, by: list[str], order: list[Column], value: str, k: int = 5) -> DataFrame:
    """(by, top): the set of the k first values of each group (o07, e04). The rank filter is applied in each task before the shuffle, and no group is collected whole."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k)
    return first.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("top"))


def promotion_gate(files: DataFrame, functions: DataFrame, changes: DataFrame, repeats: DataFrame, by: list[str], least_rho: float = 0.98, most_difference: float = 1e-6, k: int = 5) -> DataFrame:
    """Whether a scoring run may replace another, per group `by`, with what it rests on (a22).

    files and functions: (by, id, old, new) scores of both runs; changes: (by, id, old, new) before
    and after differences of both runs; repeats: (by, id, run, value). Promoted if both rank
    correlations are at least_rho or more, the k files with the greatest scores are the same, no
    change has opposite signs, and repetitions differ by most_difference at most. What cannot be
    measured does not pass; no change, and no repetition, passes.
    """
    rho = lambda df, name: spearman(df, "old", "new", by).withColumnRenamed("rho", name)
    top = lambda c: top_set(files, by, [F.col(c).desc(), F.col("id")], "id", k)
    tops = top("old").join(top("new").withColumnRenamed("top", "_new"), by).select(*by, (F.col("top") == F.col("_new")).alias("top_kept"))
    signs = changes.groupBy(*by).agg(F.count_if(F.signum("old") * F.signum("new") < 0).alias("reversals"))
    most = repeat_difference(repeats, "value", [*by, "id"], "run").groupBy(*by).agg(F.max("most").alias("difference"))
    out = rho(files, "file_rho").join(rho(functions, "function_rho"), by, "left").join(tops, by, "left").join(signs, by, "left").join(most, by, "left")
    out = out.withColumns({"reversals": F.coalesce("reversals", F.lit(0)), "difference": F.coalesce("difference", F.lit(0.0))})
    passes = (F.col("file_rho") >= least_rho) & (F.col("function_rho") >= least_rho) & F.col("top_kept") & (F.col("reversals") == 0) & (F.col("difference") <= most_difference)
    return out.withColumn("promoted", F.coalesce(passes, F.lit(False)))
