"""Places in a global order without a window over everything (w01, o03-o05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 256


def text_lead(text: Column) -> Column:
    """The first seven bytes as a number: rises with the text in byte order, ties allowed."""
    return F.conv(F.rpad(F.substring(F.hex(text.cast("binary")), 1, 14), 14, "0"), 16, 10).cast("long")


def global_place(rows: DataFrame, lead: Column, order: list[Column], name: str) -> DataFrame:
    """Rows with their place from 1 in `order`, which goes by `lead` (a number) downward before anything else.

    The driver asks for some quantiles of `lead` (BUCKETS numbers, whatever the rows); rows are
    ranked within the buckets between them, by as many tasks, and a bucket's places follow on those
    before it. Only rows of one same `lead` must share a bucket.
    """
    keyed = rows.withColumn("_lead", lead.cast("double"))
    cuts = keyed.agg(F.percentile_approx("_lead", [k / BUCKETS for k in range(1, BUCKETS)], 10_000).alias("c")).first()["c"] or []
    known = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    keyed = keyed.withColumn("_bucket", F.size(F.filter(known, lambda c: c >= F.col("_lead"))))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a bucket
    ranked = keyed.withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    placed = ranked.join(F.broadcast(before), "_bucket").withColumn(name, (F.col("_before") + F.col("_own")).cast("long"))
    return placed.drop("_lead", "_bucket", "_before", "_own")
