"""SimHash near-duplicates by meet-in-the-middle ball hashing, with connected components.

Two 64-bit fingerprints that differ in at most 2r bits share a value within r bits of both. So
each distinct fingerprint emits its whole ball of radius r; a shuffle brings equal values
together, and all that meet in one value are linked (through the smallest of them: two
fingerprints within r bits of one value are within 2r of each other, which is checked again).

A ball of radius 2 has 2,081 values. To spare fingerprints without any near one that work, a
lossless filter goes first: bits are cut into three blocks; if two fingerprints differ in at
most 4 bits, they differ in at most 2 on some two of the blocks, and so meet, on those 43 or 42
bits, in a value within 1 bit of both. Only fingerprints that meet another there emit their
ball.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, sliced, whole_rows

#: Fixed value of the contract: the seed of XXH64.
SEED = 42
RADIUS = 2
BLOCKS = ((0, 21), (21, 42), (42, 64))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; a text of fewer words is one shingle, without words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The fingerprint: the bits set in over half the hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 8192):  # a very long text never has more than so many hashes as bits at once
        ones += np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 4) -> int:
    return majority(shingle_hashes(text, width))


def with_fingerprint(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash (of the null-as-empty text) and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            h = np.array([fingerprint(x, width) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h)], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def flips(low: int, high: int, radius: int) -> list[int]:
    """All values with at most `radius` of the bits low..high-1 set, as signed 64-bit numbers."""
    found = [sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(range(low, high), k)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(distinct: DataFrame) -> DataFrame:
    """The fingerprints that meet another one on two of the three blocks, within one bit each."""

    def keys(k: int, pair: tuple[tuple[int, int], ...]) -> Column:
        kept = F.col("fp").bitwiseAND(F.lit(_signed(sum((1 << b) - (1 << a) for a, b in pair))))
        near = sorted({x for a, b in pair for x in flips(a, b, 1)})
        return F.transform(_longs(near), lambda x: F.struct(F.lit(k).cast("byte").alias("blocks"), kept.bitwiseXOR(x).alias("value")))

    pairs = enumerate(combinations(BLOCKS, 2))
    spread = distinct.select("fp", F.explode(F.concat(*(keys(k, x) for k, x in pairs))).alias("key")).select("fp", "key.blocks", "key.value")
    same = Window.partitionBy("blocks", "value")
    return spread.withColumn("_least", F.min("fp").over(same)).withColumn("_most", F.max("fp").over(same)).where("_least <> _most").select("fp").distinct()


def ball_links(some: DataFrame, bits: int = 2 * RADIUS) -> DataFrame:
    """Links (fp, other), other the smallest in a shared value of their balls; a value holds 2,081 fingerprints at most."""
    ball = some.select("fp", F.explode(F.transform(_longs(flips(0, 64, RADIUS)), lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    return (
        ball.withColumn("other", F.min("fp").over(Window.partitionBy("value")))
        .where((F.col("other") != F.col("fp")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits))
        .select("fp", "other")
        .distinct()
    )


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of links (fp, other): alternating large-star and small-star steps until nothing changes."""
    tag = f"edges-{uuid.uuid4().hex}"
    edges, seen = scratch.keep(links.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")), f"{tag}-0"), None
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).select("col.u", "col.v").where("u <> v").distinct()
        edges = scratch.keep(small, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_hash, fp, root (of the fingerprint's component), component_id, for each document.

    Text: ASCII lower case, words, `width`-word shingles, XXH64; a text without words (null or
    empty ones too) has fingerprint zero and is linked like any other. Equal fingerprints are one
    node, so thousands of copies cost one ball. component_id is the smallest non-null doc_id
    reachable; null if all are null. Repeated rows stay repeated. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(with_fingerprint(docs, width), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = scratch.keep(ball_links(scratch.keep(candidates(distinct), "candidates")), "links")
    roots = components(links, scratch)
    nodes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    nodes = scratch.keep(nodes, "nodes")
    # kept by itself, so that the join meets two plain shuffles: Spark can then split a hot root (and below, a hot fingerprint)
    smallest = scratch.keep(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    nodes = scratch.keep(nodes.join(smallest, "root").select("fp", "root", "component_id"), "named")
    return prints.join(nodes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """The documents without near copies: of each component, the one with the smallest doc_id (null last; then the smallest text hash).

    Columns as in docs. Repeated rows (same doc_id and text) count as copies and leave one.
    """
    return leave_one(docs, group_near_duplicates(docs, width))


def leave_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each root of found (doc_id, text_hash, root), the document with the smallest doc_id; columns of docs as they are, whatever their names."""
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))).alias("k"))
    key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), h.cast("string"))
    keep = keep.select(key(F.col("k.b"), F.col("k.c")).alias("key"))
    keyed = docs.select(whole_rows(docs).alias("row")).withColumn("key", key(F.col("row")["doc_id"].cast("long"), F.xxhash64(F.coalesce(F.col("row")["text"], F.lit("")))))
    return keyed.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
