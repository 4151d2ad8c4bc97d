"""Substring dedup over a distributed enhanced suffix array: maximal repeats from its common-prefix interval tree.

Sorting every suffix of the corpus would move fifty times the corpus. A string of SPAN bytes
contains K-grams; the one with the least hash (the leftmost of equals) depends on the string
alone, so equal strings agree on it and on its place in them. Only these anchors, some 7 % of
positions, are suffixes of the array:

1. identical texts are collapsed to the smallest doc_id that owns them;
2. anchors are counted by hash (map-side minima first); those of one owner only are dropped;
3. the others' contexts - as far as a SPAN-byte string around the anchor reaches - are reduced
   to distinct ones with their smallest owner, dealt out by anchor and sorted by the suffix that
   starts there: the suffix array, cut at anchors;
4. a stack-scan of its common-prefix lengths gives the interval tree. The members of each
   interval are scanned again by what stands to their left: where it differs ends the left
   extension. An interval and a left extension of SPAN bytes or more together are a maximal
   repeat with all its occurrences;
5. of each repeat the smallest owner stays, in other owners its bytes go.

A task scans an interval of at most GROUP contexts. A larger one (an anchor at the edge of a very
common passage) is replaced by its subintervals: strings that start within 13 bytes of the anchor
need a longer common prefix to its right, the others one to its left, so the contexts are dealt out
again by these longer prefixes, and so on while a subinterval is too large. When one start is left,
the subinterval is one string with all its occurrences, and its smallest owner is all there is to
find: a minimum, summed up before it is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced

SPAN, K = 50, 24
LEFT = SPAN - K
GROUP = 5000
BLOCK = 1 << 19
#: Bytes of texts that a bucket should have.
BUCKET = 64 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(x: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-grams of bytes x, by joining those of power-of-two lengths."""
    h, size, base = x.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B185EBCA87
    out, done = None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            n = len(x) - done - size + 1
            out, done = (h.copy() if out is None else out[:n] * np.uint64(pow(base, size, 1 << 64)) + h[done : done + n]), done + size
        if 2 * size <= k:
            n = len(h) - size
            h, size = h[:n] * np.uint64(pow(base, size, 1 << 64)) + h[size : size + n], 2 * size
    return _mixed(out)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the anchors of all SPAN-byte strings of a text."""
    x = np.frombuffer(raw, np.uint8)
    keys, places = [], []
    for at in range(0, len(x) - SPAN + 1, BLOCK):
        h = gram_hashes(x[at : at + BLOCK + SPAN - 1])
        ranked = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        size, window = 1, SPAN - K + 1
        while 2 * size <= window:
            ranked = np.minimum(ranked[:-size], ranked[size:])
            size *= 2
        if size < window:
            ranked = np.minimum(ranked[: size - window], ranked[window - size :])
        p = (ranked & np.uint64((1 << 20) - 1)).astype(np.int64)
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        keys.append(h[p].view(np.int64))
        places.append(p + at)
    return (np.concatenate(keys), np.concatenate(places)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found = [anchors(x) for x in batch.column(2).to_pylist()]
            n = [len(k) for k, _ in found]
            if sum(n):
                owner, v = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found])), pa.array(owner), pa.array(v), pa.array(np.concatenate([p for _, p in found]))], names=["key", "owner", "v", "at"])

    return texts.select("owner", "v", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "key long, owner long, v int, at long")


def _context_rows(joined: DataFrame) -> DataFrame:
    """Each shared anchor's context: up to LEFT bytes before it, K of it, up to LEFT after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            lists = batch.column(3)
            flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            at, end = flat.field("at").to_numpy(zero_copy_only=False), np.cumsum(n).tolist()
            every, before, after = at.tolist(), [], []
            for raw, a, b in zip(batch.column(2).to_pylist(), [0, *end], end):
                back, size = raw[::-1], len(raw)
                before += [back[size - p : size - p + LEFT] for p in every[a:b]]
                after += [raw[p : p + SPAN] for p in every[a:b]]
            owner, v = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(v), pa.array(at), flat.field("key"), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["owner", "v", "at", "key", "before", "after"])

    return joined.mapInArrow(run, "owner long, v int, at long, key long, before binary, after binary")


def common_prefixes(rows: list[bytes], width: int) -> np.ndarray:
    """Lengths of the common prefixes of neighbours; the first is 0."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    same = x[1:] == x[:-1]
    first = np.where(same.all(1), width, same.argmin(1))
    return np.concatenate(([0], np.minimum(first, np.minimum(n[1:], n[:-1]))))


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of all common-prefix intervals of `least` or longer, by a stack-scan."""
    out, stack = [], []
    for i, x in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, first))
    return out


def repeat_masks(before: list[bytes], after: list[bytes], owner: list[int], lcp: list[int]) -> list[int]:
    """For the distinct contexts of one anchor, sorted by `after` (and their common prefixes): which SPAN-byte strings
    around it have a smaller owner elsewhere; bit s is the string that starts LEFT - s bytes before the anchor."""
    masks = [0] * len(after)
    seen = set()
    for right, i, j in intervals(lcp, K):
        members = sorted(range(i, j + 1), key=before.__getitem__)
        if len(members) == 2:
            a, b = before[members[0]], before[members[1]]
            most = min(len(a), len(b))
            left = next((d for d in range(most) if a[d] != b[d]), most)
            groups = [(left, 0, 1)] if left >= SPAN - right else []
        elif right == SPAN:  # needs nothing from the left: the whole interval, and every longer left extension
            left_lcp = common_prefixes([before[m] for m in members], LEFT).tolist()
            groups = [(0, 0, len(members) - 1), *intervals(left_lcp, 1)]
        else:
            groups = intervals(common_prefixes([before[m] for m in members], LEFT).tolist(), SPAN - right)
        for left, a, b in groups:
            here = members[a : b + 1]
            least = min(owner[m] for m in here)
            bits = (1 << right - K + 1) - (1 << LEFT - left)
            if (group := (bits, tuple(here) if len(here) < 9 else (a, b, i, j))) in seen:
                continue
            seen.add(group)
            for m in here:
                if owner[m] > least:
                    masks[m] |= bits
    return masks


def _mask_rows(contexts: DataFrame, group: str = "key") -> DataFrame:
    """Contexts dealt by group and sorted by suffix -> (key, seg, least, mask). A batch may end within a group's rows: they wait for the next."""
    ids = list(dict.fromkeys([group, "key", "seg", "least"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in (*ids, "before", "after")]

        def masks(group: list, *rest: list) -> pa.RecordBatch:
            key, seg, least, before, after = rest if len(rest) == 5 else (group, *rest)
            lcp, out = common_prefixes(after, SPAN), np.zeros(len(key), np.int64)
            k = np.array(group, np.int64)
            edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            lcp[edges[:-1]] = 0
            lengths, cut = lcp.tolist(), edges.tolist()
            for a, b in zip(cut, cut[1:]):
                if b - a > 1 and max(lengths[a + 1 : b]) >= K:
                    out[a:b] = repeat_masks(before[a:b], after[a:b], least[a:b], lengths[a:b])
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(seg, pa.int64()), pa.array(least, pa.int64()), pa.array(out)], names=["key", "seg", "least", "mask"])

        for batch in batches:
            for h, c in zip(held, batch.columns):
                h += c.to_pylist()
            if held[0]:
                n = len(held[0])
                while n and held[0][n - 1] == held[0][-1]:
                    n -= 1
                if n:
                    yield masks(*(h[:n] for h in held))
                    held = [h[n:] for h in held]
        if held[0]:
            yield masks(*held)

    ordered = contexts.select(*ids, "before", "after").repartition(group).sortWithinPartitions(group, "after", "before")
    return ordered.mapInArrow(run, "key long, seg long, least long, mask long")


def _subintervals(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, seg, least, mask) of the contexts of anchors that have too many for one scan: by ever longer common prefixes.

    A row of one round stands for a context and the strings around it that start at `lo` to `hi`; rows of one `g` agree in all
    bytes that every one of these strings has.
    """
    columns, parts, k = ("key", "seg", "least", "before", "after"), [], 0
    rows = contexts.select(*columns, F.lit(0).alias("lo"), F.lit(LEFT).alias("hi"))
    while True:
        k += 1
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))).alias("half")
        rows = rows.select(*columns, halves).select(*columns, "half.lo", "half.hi").where(f"octet_length(before) >= {LEFT} - hi and octet_length(after) >= {K} + lo")
        rows = scratch.keep(rows.withColumn("g", F.expr(f"xxhash64(key, lo, hi, substring(before, 1, {LEFT} - hi), substring(after, 1, {K} + lo))")), f"split-{k}")
        # groups of one owner have nothing to remove
        groups = scratch.keep(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("g", "n", "first"), f"groups-{k}")
        parts.append(rows.where("lo = hi").join(groups, "g").where("first < least").select("key", "seg", "least", F.expr("shiftleft(1L, lo)").alias("mask")))
        rows = rows.where("lo < hi")
        parts.append(_mask_rows(rows.join(groups.where(F.col("n") <= GROUP), "g", "left_semi"), "g"))
        large = groups.where(F.col("n") > GROUP)
        rows = rows.join(large, "g", "left_semi")
        if 2**k > LEFT or rows.isEmpty():  # all starts are single ones, or no group is too large
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    none = contexts.select("key", "seg", "least", F.lit(0).cast("long").alias("mask"))
    return found.unionByName(none).groupBy("key", "seg").agg(F.min("least").alias("least"), F.bit_or("mask").alias("mask"))


def removed_runs(first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal runs of bytes covered by the strings that the bits of mask stand for, bit s at first + s."""
    opens, closes, begins, ends = mask & ~(mask << 1), mask & ~(mask >> 1), [], []
    for s in range(LEFT + 1):
        begins.append(first[(opens >> s) & 1 == 1] + s)
        ends.append(first[(closes >> s) & 1 == 1] + (s + SPAN))
    b, e = np.sort(np.concatenate(begins)), np.sort(np.concatenate(ends))
    # the i-th begin lies beyond the end of all stretches before it if it lies beyond the i-th end
    apart = np.flatnonzero(b[1:] > e[:-1])
    return b[np.concatenate((np.zeros(min(1, len(b)), int), apart + 1))], e[np.concatenate((apart, np.full(min(1, len(b)), len(b) - 1)))]


def _cut_rows(joined: DataFrame) -> DataFrame:
    """Texts with (anchor, mask) lists -> what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            # places of all texts of the batch on one line, a byte apart: runs of two texts never touch
            lists, raws = batch.column(3), batch.column(2).to_pylist()
            flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            base = np.cumsum([0, *(len(x) + 1 for x in raws)])
            first = flat.field("at").to_numpy(zero_copy_only=False) - LEFT + np.repeat(base[:-1], n)
            begins, ends = removed_runs(first, flat.field("mask").to_numpy(zero_copy_only=False))
            cut, rows = np.searchsorted(begins, base), []
            for i, (owner, v, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws)):
                b, e = ((x[cut[i] : cut[i + 1]] - base[i]).tolist() for x in (begins, ends))
                kept = hashlib.sha256()
                for x, y in zip([0, *e], [*b, len(raw)]):
                    kept.update(raw[x:y])
                rows.append((owner, v, sum(e) - sum(b), len(b), kept.hexdigest()))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["owner", "v", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "owner long, v int, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document.

    A byte goes if a SPAN-byte string over it also starts in a document with a smaller doc_id;
    matches never cross documents. Null text counts as empty; texts under SPAN bytes lose nothing.
    A null doc_id is neither smaller nor larger than any: such rows lose nothing and take nothing
    from others. Rows of one doc_id (repeated, or with other texts) take nothing from each other.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    slim = scratch.keep(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "slim")
    owners = slim.where(f"doc_id is not null and n_bytes >= {SPAN}").groupBy("sha").agg(F.min("doc_id").alias("owner")).withColumn("v", F.hash("sha"))
    owners = scratch.keep(owners, "owners")

    # Texts, once each, bucketed by owner: later joins with lists of places move the lists only. A bucket's lists are about as
    # large as its texts; beyond what a task should hold in a hash table, both are sorted instead, which can spill.
    size = slim.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))))
    join = "shuffle_hash" if size <= 2 * BUCKET * parts else "merge"
    table = f"knotgauge_texts_{uuid.uuid4().hex}"
    first = rows.join(owners.withColumnRenamed("sha", "_sha"), (F.col("doc_id") == F.col("owner")) & (F.col("sha") == F.col("_sha"))).select("owner", "v", "text")
    with scratch.cleaning():
        first.dropDuplicates(["owner", "v"]).write.option("path", f"{scratch.root}/texts").option("compression", "zstd").bucketBy(parts, "owner", "v").saveAsTable(table)
    texts = spark.table(table)

    keys = _anchor_rows(texts).groupBy("key").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("key")
    keys = scratch.keep(keys, "keys")
    hits = scratch.keep(_anchor_rows(texts).join(keys, "key", "left_semi"), "hits")
    scratch.drop("keys")

    def with_texts(places: DataFrame) -> DataFrame:
        lists = places.groupBy("owner", "v").agg(F.collect_list(F.struct(*[c for c in places.columns if c not in ("owner", "v")])).alias("hits")).hint(join)
        return texts.join(lists, ["owner", "v"]).select("owner", "v", F.col("text").cast("binary").alias("raw"), "hits")

    def contexts() -> DataFrame:
        """Made twice, from texts and places: keeping them would take twice the corpus."""
        return _context_rows(with_texts(hits)).withColumn("seg", F.xxhash64("before", "after"))

    distinct = scratch.keep(contexts().groupBy("key", "seg", "before", "after").agg(F.min("owner").alias("least")), "distinct")
    large = scratch.keep(distinct.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "large")
    masks = _mask_rows(distinct.join(large, "key", "left_anti")).unionByName(_subintervals(distinct.join(large, "key", "left_semi"), scratch))
    masks = scratch.keep(masks, "masks")
    scratch.drop("distinct")

    places = contexts().select("owner", "v", "at", "key", "seg", F.octet_length("before").alias("nb"), F.octet_length("after").alias("na"))
    every = F.when(F.col("nb") + F.col("na") >= SPAN, F.expr(f"shiftleft(1L, na - {K} + 1) - shiftleft(1L, {LEFT} - nb)")).otherwise(F.lit(0))
    cuts = places.join(masks, ["key", "seg"]).select("owner", "v", "at", F.when(F.col("owner") > F.col("least"), every).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    cuts = scratch.keep(cuts, "cuts")
    scratch.drop("hits")
    scratch.drop("masks")
    cut = scratch.keep(_cut_rows(with_texts(cuts)).join(owners, ["owner", "v"]).select("sha", "owner", "n_removed", "n_spans", "kept_sha256"), "cut")
    spark.sql(f"DROP TABLE {table}")
    scratch.drop("texts")

    known = scratch.keep(owners.select("sha", "owner").join(cut.drop("owner"), "sha", "left").withColumnRenamed("sha", "_sha"), "known")
    copy = F.col("doc_id") > F.col("owner")
    untouched = F.col("doc_id").isNull() | F.col("n_removed").isNull()
    empty = hashlib.sha256(b"").hexdigest()
    return slim.join(known, F.col("sha") == F.col("_sha"), "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(untouched, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(untouched, F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).when(untouched, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
