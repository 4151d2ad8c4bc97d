"""A stream of (file_id, text) scored once per content: the cache is the state, so a restart repeats nothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import joined_key
from ..operators.units import analyze
from ..sources.stores import CacheTable

RESULT = "token_count long, tree_score double"


def score_batch(files: DataFrame, cache: CacheTable, parts: Callable[[DataFrame], tuple], now: dt.datetime, alpha: float = 0.8) -> None:
    """Scores each new content of a batch once; `parts` gives tokens, lines, scopes, ranges and tau for (file_id, text)."""
    keyed = files.withColumn("key", joined_key(F.lit("kg-stream"), F.sha2("text", 256)))
    once = keyed.groupBy("key").agg(F.min_by("text", "file_id").alias("text"), F.min("file_id").alias("file_id"))
    _, fresh = cache.probe(once, now)
    scored = analyze(*parts(fresh.select("file_id", "text")), alpha)
    cache.put(fresh.select("key", "file_id").join(scored, "file_id").select("key", "token_count", "tree_score"), now)


def score_stream(stream: DataFrame, cache: CacheTable, parts: Callable[[DataFrame], tuple], checkpoint: str, clock: Callable[[], dt.datetime]) -> StreamingQuery:
    """One foreachBatch sink; available-now, so that it ends when the input is read."""
    return stream.writeStream.foreachBatch(lambda batch, _: score_batch(batch, cache, parts, clock())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
