"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source (with map-side sums, so a source with a third of all rows is one
partial row per task), targets are water-filled over the table of sources, and each document
is taken floor(rate) times plus once more by a coin that its own id seeds.

One seed's coins leave a source off its target by the size of its larger documents. So the words
that a source would take are summed under SEEDS seeds in one more aggregation, and each source
uses the seed that comes nearest to its target (the lowest of equals). That is a choice per
source, not per document: under any seed a document's coin is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, Scratch, text_or_empty, whole_rows

#: The table of sources is broadcast up to so many rows; beyond, it is joined by shuffle, hot sources split by AQE.
BROADCAST_SOURCES = 20_000
#: Seeds tried per source; a SHA-256 digest gives coins for eight of them, of 32 bits each.
SEEDS, PER_DIGEST = 64, 8


def digest(doc_id: Column, seed: str, j: Column) -> Column:
    """SHA-256(seed:j:doc_id) in hexadecimal: coin k is eight digits of digest k div PER_DIGEST, compared with threshold() as text."""
    return F.sha2(F.concat_ws(":", F.lit(seed), j.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)


def threshold(fraction: Column) -> Column:
    """The coins below this text come up with probability `fraction` (of 0 to under 1, to 32 bits)."""
    return F.lpad(F.lower(F.hex(F.least(F.ceil(fraction * F.lit(4294967296.0)), F.lit(4294967295)).cast("long"))), 8, "0")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Targets share the total by weight, none above `most` times its source's size, the excess
    reshared by weight. In order of cap / weight, let level(i) be what is left by the sources
    before i (all at their caps), per weight left. It rises as long as sources belong at their
    caps and falls afterwards, so the water level is its maximum.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    upward = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(upward.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") - F.lit(most) * before.cast("double")) / rest.cast("double")
    leveled = weighted.withColumn("_level", level)
    return leveled.select("source", "source_size", F.least(F.lit(most) * F.col("source_size").cast("double"), F.max("_level").over(everything) * F.col("_w").cast("double")).alias("target"))


def source_rates(sized: DataFrame, weights: tuple[int, ...], most: float, seed: str, scratch: Scratch) -> DataFrame:
    """source, source_size, target, whole (copies of every document), below (threshold of the coin), k (the seed) for each source of sized (doc_id, source, size)."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rated = targets.select("source", "source_size", "target", F.floor(rate).cast("long").alias("whole"), threshold(rate - F.floor(rate)).alias("below"))
    rated = scratch.keep(rated, "rated")
    # one row a digest, eight coins each: sums are made before anything is shuffled
    tossed = sized.select(F.col("source").alias("s"), "size", F.posexplode(F.array(*(digest(F.col("doc_id"), seed, F.lit(j)) for j in range(SEEDS // PER_DIGEST)))).alias("j", "hashed"))
    joined = tossed.join(_small(rated), F.col("s").eqNullSafe(F.col("source")))
    extra = [F.sum(F.when(F.substring("hashed", 8 * i + 1, 8) < F.col("below"), F.col("size")).otherwise(F.lit(0))).alias(f"e{i}") for i in range(PER_DIGEST)]
    sums = joined.groupBy("s", "j").agg(*extra).select("s", F.explode(F.array(*(F.struct((F.col("j") * PER_DIGEST + i).alias("k"), F.col(f"e{i}").alias("extra")) for i in range(PER_DIGEST)))).alias("tried"))
    off = F.abs((F.col("source_size") * F.col("whole") + F.col("tried.extra")).cast("double") - F.col("target"))
    best = rated.join(sums, F.col("s").eqNullSafe(F.col("source"))).groupBy("source", "source_size", "target", "whole", "below").agg(F.min(F.struct(off.alias("off"), F.col("tried.k").alias("k"))).alias("best"))
    return scratch.keep(best.select("source", "source_size", "target", "whole", "below", F.col("best.k").alias("k")), "rates")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _copies(doc_id: Column, seed: str) -> Column:
    k = F.col("k").cast("int")
    coin = F.substr(digest(doc_id, seed, F.floor(k / PER_DIGEST)), (8 * (k % PER_DIGEST) + 1), F.lit(8))
    return F.col("whole") + (coin < F.col("below")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each document (no document is left out).

    Null text has size 0; null sources are one source, weighed last; a source without words has
    target 0 and takes no copy. Repeated rows share their coin. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long").alias("size")), "sizes")
    rates = source_rates(sized, weights, most, seed, scratch)
    joined = sized.withColumnRenamed("source", "s").join(_small(rates), F.col("s").eqNullSafe(F.col("source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("doc_id"), seed).alias("copies"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as mix_sources() says, columns as in docs, whatever their names.

    Null, empty and long texts, null sources and repeated rows count as in mix_sources(); an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long").alias("size")), "sizes")
    rates = source_rates(sized, weights, most, seed, scratch)
    rows = docs.select(whole_rows(docs).alias("row"))
    joined = rows.join(_small(rates), F.col("row")["source"].eqNullSafe(F.col("source")))
    taken = joined.select("row", F.explode(F.array_repeat(F.lit(1), _copies(F.col("row")["doc_id"], seed).cast("int"))))
    return taken.select("row.*")
