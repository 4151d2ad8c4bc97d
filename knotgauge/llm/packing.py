"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are at most `capacity`, so the corpus is planned as a histogram of at most `capacity`
lengths: its size does not grow with the data. The driver turns the histogram into patterns
(tuples of lengths with a multiplicity); executors give each piece its rank among the pieces
of its length and look the rank up in the pattern table. Pieces as long as a sequence need no
plan and are not ranked.

A plan has two phases, always both: combinations that fill gaps exactly, then best fit for the
residuals. Short pieces are what best fit closes small gaps with, so the exact phase leaves
those under a reserve length alone. The reserve is chosen on the histogram: of RESERVES, the one
whose plan has the fewest sequences, the smallest of equals.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, sliced

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Pieces of one length are ranked in groups: of RANK_LEAST pieces while there are few, RANK_GROUPS groups then, and as many as
#: it takes for RANK_ROWS pieces a group where a length is very common. So neither a group nor their number a length is large.
RANK_LEAST, RANK_GROUPS, RANK_ROWS = 256, 64, 250_000
#: Lengths under which pieces are kept out of the exact phase, in 64ths of the capacity.
RESERVES = (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24)


#: Fixed value: the vocabulary's one special token; it takes the id after the last rank.
SPECIAL = "<|endoftext|>"


def id_encoder(tokenizer_path: str, ranks_path: str | None = None) -> Callable[[str], bytes]:
    """Text to little-endian ids. With the same vocabulary given as ranks, a library that takes a third of the time makes the same ids."""
    if not ranks_path:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer_path)
        return lambda x: np.asarray(slow.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return lambda x: np.asarray(fast.encode(x, allowed_special="all"), "<u4").tobytes()


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of each document's ids (its text's, then id 0). Only longer documents are cut; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_path, ranks_path)
        end = b"\0\0\0\0"
        for batch in sliced(batches, 1):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(ids) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


Plan = list[tuple[tuple[int, ...], int]]


def plan_patterns(histogram: dict[int, int], capacity: int = 2048) -> Plan:
    """Patterns (lengths, how many sequences) that use up the histogram: exact complements under the best reserve, then best fit."""
    return min((plan_with_reserve(histogram, capacity, capacity * r // 64) for r in RESERVES), key=lambda x: sum(k for _, k in x[0] + x[1]), default=([], [], []))[2]


def plan_with_reserve(histogram: dict[int, int], capacity: int, reserve: int) -> tuple[Plan, Plan, Plan]:
    """The exact phase over lengths of `reserve` or more, best fit for all that is left, and both."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] += count
    exact = exact_complements(left, capacity, reserve)
    residual = best_fit(left, capacity)
    return exact, residual, exact + residual


def pair_sums(lengths: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """The hash of pair sums: sum -> its larger parts, the largest first."""
    at = np.arange(len(lengths))
    i, j = (x.ravel() for x in np.meshgrid(at, at, indexing="ij"))
    i, j = (x[(lengths[i] >= lengths[j]) & (lengths[i] + lengths[j] < capacity)] for x in (i, j))
    sums, larger = lengths[i] + lengths[j], lengths[i]
    order = np.lexsort((-larger, sums))
    sums, larger = sums[order], larger[order]
    keys, first = np.unique(sums, return_index=True)
    return dict(zip(keys.tolist(), np.split(larger, first[1:])))


def exact_complements(left: np.ndarray, capacity: int, reserve: int = 0) -> Plan:
    """From the longest length down: its gap filled exactly by one, two or three lengths found by hashed sums, each
    combination consumed as often as the counts `left` allow. What it uses is taken from `left`; lengths under `reserve` are not used."""
    plan: Plan = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    there = np.flatnonzero(left)
    there = there[there >= max(reserve, 1)]
    sums = pair_sums(there, capacity)
    usable = np.zeros(capacity + 1, bool)
    usable[there] = True
    paired = np.zeros(capacity + 1, bool)  # sums that still have a pair; counts only fall, so one that has lost its pairs stays lost
    paired[list(sums)] = True

    def take(pattern: tuple[int, ...]) -> None:
        if k := min(int(left[x]) // pattern.count(x) for x in set(pattern)):
            for x in pattern:
                left[x] -= k
            plan.append((pattern, k))

    def take_pairs(before: tuple[int, ...], rest: int) -> None:
        """Fills `rest` with pairs of that sum for as long as there are sequences that begin with `before`."""
        larger = sums.get(rest, there[:0])
        larger = larger[(left[larger] > 0) & (left[rest - larger] > 0)]
        sums[rest], paired[rest] = larger, len(larger) > 0
        for b in larger.tolist():
            take((*before, b, rest - b))
            if not all(left[x] for x in before):
                return

    for longest in there[::-1].tolist():
        gap = capacity - longest
        if left[longest] and usable[gap] and left[gap]:
            take((longest, gap))
        if left[longest] and paired[gap]:
            take_pairs((longest,), gap)
        if left[longest] and gap > 2:
            thirds = np.arange(min(gap - 2, longest), 0, -1)
            for a in thirds[usable[thirds] & (left[thirds] > 0) & paired[gap - thirds]].tolist():
                if left[a] and paired[gap - a]:
                    take_pairs((longest, a), gap - a)
                if not left[longest]:
                    break
    return plan


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """From the longest length down, each into the open sequence with the least gap that holds it; equal sequences are one group."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], k: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_by_gap or not open_by_gap[gap]:
            if (i := bisect_left(gaps, gap)) == len(gaps) or gaps[i] != gap:
                gaps.insert(i, gap)
        open_by_gap[gap].append((pattern, k))

    for length in np.flatnonzero(left)[::-1]:
        length, count = int(length), int(left[length])
        while count:
            if (i := bisect_left(gaps, length)) < len(gaps):
                gap = gaps[i]
                pattern, k = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps.pop(i)
            else:
                gap, pattern, k = capacity, (), count
            each = min(gap // length, count)
            n = min(k, count // each)
            put(pattern + (length,) * each, n)
            if k > n and pattern:
                put(pattern, k - n)
            count -= n * each
    return [x for gap in gaps for x in open_by_gap[gap]]


def slot_tables(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which its slots begin, their first sequence and their offset."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, k in plan:
        offset = 0
        for length in pattern:
            slots[length].append((used[length], first, offset))
            used[length] += k
            offset += length
        first += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in slots.items()}


def rank_groups(n: int) -> int:
    return max(min(RANK_GROUPS, -(-n // RANK_LEAST)), -(-n // RANK_ROWS))


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, ranks_path: str | None = None) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens; one row per piece.

    Null text counts as empty (one id 0); null ids and repeated rows are packed like any other;
    no documents, no rows. Sequences are gapless from offset 0; those of one piece of full length
    have negative ids. Collected to the driver: counts by length, and by length and rank group,
    which are at most RANK_GROUPS for each length and one more for RANK_ROWS pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    # the salt deals equal pieces out over groups; it is written, so ranks are the same however often a task is repeated
    pieces = scratch.keep(cut_pieces(docs, tokenizer_path, capacity, ranks_path).withColumn("_salt", F.rand(7)), "pieces")
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    total = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    tables = slot_tables(plan_patterns(total, capacity), capacity)
    share = F.element_at(F.map_from_arrays(*(F.array(*map(F.lit, x)) for x in ([0, *total], [1, *map(rank_groups, total.values())]))), F.col("length").cast("int"))
    short = short.withColumn("_group", F.floor(F.col("_salt") * share).cast("int"))
    before: dict[int, np.ndarray] = {}
    for length, g, n in sorted(tuple(r) for r in short.groupBy("length", "_group").count().collect()):
        starts = before.setdefault(length, np.zeros(rank_groups(total[length]) + 1, np.int64))
        starts[g + 1] = n
    before = {length: np.cumsum(starts) for length, starts in before.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, g, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_group", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                lo, first, off = tables[int(n)]
                ranks = rank[at] - 1 + before[int(n)][g[at]]
                slot = np.searchsorted(lo, ranks, "right") - 1
                sequence[at], offset[at] = first[slot] + ranks - lo[slot], off[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = short.drop("_salt").withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")))
    alone = full.drop("_salt").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return ranked.mapInArrow(place, PACKED).unionByName(alone)
