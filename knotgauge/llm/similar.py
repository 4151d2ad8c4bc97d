"""SimHash near-dedup with a check of the similarity: Jaccard of word shingles, connected components.

Texts with equal shingle sets are one node. Nodes become candidates by meet-in-the-middle ball
hashing of their fingerprints (simhash.py: a shared value in balls of radius 2). But fingerprints
of two texts of similarity 0.8 differ in some ten of 64 bits, and a ball of radius 5 has eight
million values. So nodes also become candidates by 32 bands of four min-hashes: two nodes of
similarity s share one with probability 1 - (1 - s^4)^32; a pair of 0.8 is missed once in 20
million. Candidates of either kind are compared exactly, on whole sets.

A group of candidates is compared by one worker: each node with all that are in other components
so far, so near copies that link up early cost little, and the links written grow with the nodes.
Groups with the same nodes are compared once. They go in two rounds: balls, equal fingerprints and
the first FIRST_BANDS bands, whose links connect most near copies; then, of the other bands, the
groups whose nodes are not all connected yet. So a set is sent to a few workers, not to one for
each band. Sets are made again for the nodes that need them, one text a node: they are larger than
the texts, and most nodes share no group.

A group of over GROUP nodes or GROUP_BYTES is dealt out: all its nodes are compared with one of
them, the pivot; those like it are one component, and only the others are then compared with all,
block by block. That is exact too; it costs one comparison a node where the group is one crowd of
near copies, and blocks times blocks where it is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced
from .simhash import SEED, ball_links, candidates, components, leave_one, majority, shingle_hashes

WIDTH, LEAST = 5, 0.8
BANDS, PER_BAND = 32, 4
#: Nodes, and bytes of their sets, that one worker compares.
GROUP, GROUP_BYTES = 1000, 32 << 20
FIRST_BANDS = 4
#: The list of nodes whose sets are needed is broadcast up to so many rows (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_NODES = 500_000
_random = np.random.default_rng(SEED)
TIMES, PLUS = (_random.integers(0, 1 << 64, (BANDS * PER_BAND, 1), np.uint64) | np.uint64(x) for x in (1, 0))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> list[int]:
    """Signed keys of the bands; none without shingles."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * PER_BAND, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024] * TIMES + PLUS).min(1), out=least)
    rows = least.reshape(BANDS, PER_BAND)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def with_bands(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash (of the null-as-empty text), node (a hash of the shingle set), its bands, the set's bytes and the fingerprint."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("bytes", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            every = [shingle_hashes(x, width) for x in batch.column(2).to_pylist()]
            fp = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([bands(s) for s in sets], schema.field(3).type), pa.array([8 * len(s) for s in sets], pa.int64()), pa.array(fp)], schema=schema)

    return _hashed(docs).mapInArrow(run, "doc_id long, text_hash long, node long, bands array<long>, bytes long, fp long")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, shingles) for nodes (node, doc_id, text_hash), each by the one text that it names; repeated rows give repeated sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, width).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    named = nodes.select("node", F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"))
    named = F.broadcast(named) if named.count() <= BROADCAST_NODES else named
    rows = _hashed(docs).join(named, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")))
    return rows.select("node", "text").mapInArrow(run, "node long, shingles binary")


def linked(nodes: list[int], raw: list[bytes], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that span each component of these nodes, two of which are linked by a similarity of `least`."""
    sets = [np.frombuffer(x, np.uint64) for x in raw]
    size = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(size)[:-1])
    group, mark, out = np.arange(len(nodes)), np.zeros(len(values), bool), []
    for i in range(len(nodes) - 1):
        others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        others = others[np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]) - 1e-9]
        if not len(others):
            continue
        mark[parts[i]] = True
        starts = np.concatenate(([0], np.cumsum(size[others])[:-1]))
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in others])], starts, dtype=np.int64)
        mark[parts[i]] = False
        for j in others[both >= least * (size[i] + size[others] - both) - 1e-9]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((nodes[i], nodes[j]))
    return out


def _grouped(rows: DataFrame, group: list[str], least: float) -> DataFrame:
    """Links (fp, other) within the groups of rows (group columns, node, shingles); a group's rows must fit a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = linked(nodes, raw, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["fp", "other"])

        at, nodes, raw = None, [], []
        for batch in sliced(batches, 2):
            for key, node, x in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at and nodes:
                    yield flush()
                    nodes, raw = [], []
                at = key
                if not nodes or nodes[-1] != node:  # a node may come twice, as one of all and as one of the others
                    nodes.append(node)
                    raw.append(x)
        if nodes:
            yield flush()

    rows = rows.repartition(*group).select(F.struct(*group).alias("key"), "node", "shingles").sortWithinPartitions("key", "node")
    return rows.mapInArrow(run, "fp long, other long")


def _like_pivot(rows: DataFrame, least: float) -> DataFrame:
    """rows (band, node, shingles, pivot, pivot_shingles) -> band, node, pivot, alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(alike, pa.bool_())], names=["band", "node", "pivot", "alike"])

    return rows.select("band", "node", "shingles", "pivot", "pivot_shingles").mapInArrow(run, "band long, node long, pivot long, alike boolean")


def _links_within(groups: DataFrame, sets: DataFrame, scratch: Scratch, tag: str, least: float) -> DataFrame:
    """Links (fp, other) between nodes of a similarity of `least` within groups (band, node, bytes)."""
    shared = groups.groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("a"), F.min("node").alias("pivot"), F.max("node").alias("c")).where("n > 1")
    once = scratch.keep(shared.groupBy("n", "total", "a", "pivot", "c").agg(F.min("band").alias("band")).select("band", "n", "total", "pivot"), f"once-{tag}")
    members = scratch.keep(groups.drop("bytes").join(once, "band"), f"members-{tag}")
    fits = (F.col("n") <= GROUP) & (F.col("total") <= GROUP_BYTES)
    links = _grouped(members.where(fits).select("band", "node").join(sets, "node"), ["band"], least)
    if once.where(~fits).isEmpty():
        return scratch.keep(links.distinct(), f"links-{tag}")

    large = members.where(~fits)
    pivots = sets.withColumnsRenamed({"node": "pivot", "shingles": "pivot_shingles"})
    compared = scratch.keep(_like_pivot(large.select("band", "node", "pivot").join(sets, "node").join(pivots, "pivot"), least), f"pivots-{tag}")
    links = links.unionByName(compared.where("alike and node <> pivot").select(F.col("node").alias("fp"), F.col("pivot").alias("other")))
    # the others with all, in blocks: (block of all, block of the others) is a group
    others = compared.where("not alike").select("band", "node")
    sizes = others.groupBy("band").agg(F.count("*").alias("odd")).join(once, "band")
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(GROUP)), F.ceil(F.col("total") * n / F.col("n") / F.lit(GROUP_BYTES))).cast("int")
    sizes = scratch.keep(sizes.select("band", blocks(F.col("n")).alias("ka"), blocks(F.col("odd")).alias("kb")), f"blocks-{tag}")
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = large.select("band", "node").join(sizes, "band").select("band", "node", place("ka").alias("i"), F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("j"))
    odd = others.join(sizes, "band").select("band", "node", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("i"), place("kb").alias("j"))
    return scratch.keep(links.unionByName(_grouped(every.unionByName(odd).join(sets, "node"), ["band", "i", "j"], least)).distinct(), f"links-{tag}")


def similar_roots(docs: DataFrame, prints: DataFrame, scratch: Scratch, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes that share a group with another one and have a link of `least`."""
    named = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("t")
    distinct = scratch.keep(prints.where("bytes > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.min("fp").alias("fp"), F.max("bytes").alias("bytes"), named), "distinct")
    met = scratch.keep(ball_links(scratch.keep(candidates(distinct.select("fp").distinct()), "candidates")), "balls")
    ball = met.select("fp", F.xxhash64(F.lit("ball"), "other").alias("band")).unionByName(met.select(F.col("other").alias("fp"), F.xxhash64(F.lit("ball"), "other").alias("band")).distinct())
    tagged = lambda some, first: distinct.select("node", "bytes", F.explode(some).alias("band"), F.lit(first).alias("first"))
    equal = F.array(F.xxhash64(F.lit("equal"), "fp"))
    spread = tagged(F.concat(F.slice("bands", 1, FIRST_BANDS), equal), True).unionByName(tagged(F.slice("bands", FIRST_BANDS + 1, BANDS), False))
    spread = spread.unionByName(distinct.join(ball, "fp").select("node", "bytes", "band", F.lit(True).alias("first")))
    # bands of one node only go at once
    met_bands = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    groups = scratch.keep(spread.join(met_bands, "band", "left_semi"), "groups")
    needed = groups.select("node").distinct()
    sets = scratch.keep(sets_of(docs, distinct.join(needed, "node", "left_semi").select("node", "t.doc_id", "t.text_hash"), width).dropDuplicates(["node"]), "sets")
    links = _links_within(groups.where("first").select("band", "node", "bytes"), sets, scratch, "first", least)
    roots = scratch.keep(components(links, scratch), "roots-first")

    rest = groups.where("not first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rest.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    more = _links_within(rest.join(apart, "band", "left_semi").select("band", "node", "bytes"), sets, scratch, "rest", least)
    if more.isEmpty():
        return roots
    return components(links.unionByName(more), scratch)


def drop_similar(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """SimHash near-dedup by similarity: of each component of pairs with a similarity of `least`, the one with the smallest doc_id stays (null last; then the smallest text hash).

    Text: ASCII lower case, words, `width`-word shingles; texts without words (null or empty ones
    too) are copies of each other. Columns as in docs; repeated rows leave one.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    prints = scratch.keep(with_bands(docs, width), "prints")
    roots = similar_roots(docs, prints, scratch, width, least)
    # kept by itself, so that the join meets two plain shuffles: Spark can then split a hot node
    roots = scratch.keep(roots, "roots")
    found = prints.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    return leave_one(docs, found)
