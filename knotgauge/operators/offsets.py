"""Offset maps between cleaned and original text (j16): spans (file_id, a, b, stride), a in the cleaned text, b in the original."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import as_of


def map_offsets(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (file_id, at) with `mapped` = b + (at - a) * stride of the last span at or before them."""
    found = as_of(points, F.col("at"), spans, F.col("a"), ["a", "b", "stride"])
    return found.withColumn("mapped", (F.col("b") + (F.col("at") - F.col("a")) * F.col("stride")).cast("long")).drop("a", "b", "stride")
