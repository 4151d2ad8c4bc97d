"""Token streams of files: the deterministic provider, alignment, lines, validation.

A token row is (file_id, idx, start_byte, end_byte, entropy); offsets are bytes. All windows
are per file, so files spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deterministic_tokens(files: DataFrame) -> DataFrame:
    """(file_id, text) -> tokens of three bytes with num = (sum of bytes + 7 * position) % 97 and entropy num / 30, null for the first.

    One pass over the text as hex, cut by a regular expression: linear in the text.
    """
    cut = F.posexplode(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit(".{1,6}"), 0)).alias("idx", "h")
    value = F.conv("h", 16, 10).cast("long")
    raw = files.select("file_id", cut).select("file_id", F.col("idx").cast("long").alias("idx"), "h", value.alias("v"))
    total = F.col("v") % 256 + F.shiftright("v", 8) % 256 + F.shiftright("v", 16)
    num = F.when(F.col("idx") > 0, (total + 7 * F.col("idx")) % 97)
    size = (F.length("h") / 2).cast("long")
    return raw.select("file_id", "idx", (F.col("idx") * 3).alias("start_byte"), (F.col("idx") * 3 + size).alias("end_byte"), num.alias("num"), (num.cast("double") / F.lit(30.0)).alias("entropy"))


def align_records(records: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(file_id, position, bytes, entropy) -> tokens, by running length (w05).

    With sources (file_id, text): if the pieces together start with one space that the source
    lacks (a dummy prefix of the tokenizer), the first piece loses it (i06).
    """
    if sources is not None:
        by_file = Window.partitionBy("file_id")
        shorter = sources.select("file_id", F.octet_length("text").alias("_size"), F.substring("text", 1, 1).alias("_first"))
        records = records.join(shorter, "file_id", "left").withColumn("_total", F.sum(F.octet_length("bytes")).over(by_file))
        prefixed = (F.col("position") == 0) & (F.col("_total") == F.col("_size") + 1) & (F.hex(F.substring("bytes", 1, 1)) == "20") & ((F.col("_first") != " ") | (F.col("_size") == 0))
        records = records.withColumn("bytes", F.when(prefixed, F.expr("substring(bytes, 2)")).otherwise(F.col("bytes"))).drop("_size", "_first", "_total")
    size = F.octet_length("bytes").cast("long")
    before = Window.partitionBy("file_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    return records.select("file_id", F.col("position").cast("long").alias("idx"), start.cast("long").alias("start_byte"), (start + size).cast("long").alias("end_byte"), "entropy")


def line_starts(files: DataFrame) -> DataFrame:
    """(file_id, text) -> (file_id, line from 1, line_start, line_text)."""
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("k", "line_text"))
    before = Window.partitionBy("file_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line_text") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("file_id", (F.col("k") + 1).cast("long").alias("line"), start.alias("line_start"), "line_text")


def meaningful_ranges(lines: DataFrame) -> DataFrame:
    """Each non-blank line without the white space around it: (file_id, start_byte, end_byte)."""
    lead = F.octet_length(F.regexp_extract("line_text", r"^([ \t\r\x0B\f]*)", 1))
    body = F.octet_length(F.regexp_replace("line_text", r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+$", ""))
    return lines.where(body > 0).select("file_id", (F.col("line_start") + lead).cast("long").alias("start_byte"), (F.col("line_start") + lead + body).cast("long").alias("end_byte"))


def as_of(points: DataFrame, at: Column, marks: DataFrame, mark_at: Column, values: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """Points (file_id, ...) with the values of the mark that is the last at or before `at` (before, if strict), or forward: the first at or after (after).

    One sort per file instead of a range join: marks and points are united, and each point takes
    the last mark seen in its direction.
    """
    kept = [c for c in points.columns if c != "file_id"]
    left = points.select("file_id", at.alias("_x"), F.lit(0 if strict else 1).alias("_k"), F.struct(*kept).alias("_p"), F.lit(None).cast(marks.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_m"))
    right = marks.select("file_id", mark_at.alias("_x"), F.lit(1 if strict else 0).alias("_k"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.struct(*values).alias("_m"))
    x = F.col("_x").desc() if forward else F.col("_x").asc()
    seen = Window.partitionBy("file_id").orderBy(x, "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_last", F.last("_m", ignorenulls=True).over(seen)).where("_p is not null")
    return both.select("file_id", *(F.col("_p")[c].alias(c) for c in kept), *(F.col("_last")[v].alias(v) for v in values))


def count_before(points: DataFrame, at: Column, tokens: DataFrame, edge: str, inclusive: bool, name: str) -> DataFrame:
    """Points with how many tokens have edge < at (or <=, if inclusive): the index of a byte among tokens (j02, j03)."""
    kept = [c for c in points.columns if c != "file_id"]
    left = points.select("file_id", at.alias("_x"), F.lit(1 if inclusive else 0).alias("_k"), F.lit(0).alias("_n"), F.struct(*kept).alias("_p"))
    right = tokens.select("file_id", F.col(edge).alias("_x"), F.lit(0 if inclusive else 1).alias("_k"), F.lit(1).alias("_n"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"))
    seen = Window.partitionBy("file_id").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_c", F.sum("_n").over(seen)).where("_p is not null")
    return both.select("file_id", *(F.col("_p")[c].alias(c) for c in kept), F.col("_c").cast("long").alias(name))


def token_lines(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens with their line, its start (j01) and the index of the first token on it (w03)."""
    found = as_of(tokens, F.col("start_byte"), lines, F.col("line_start"), ["line", "line_start"])
    return found.withColumn("line_first", F.min("idx").over(Window.partitionBy("file_id", "line")))


def record_faults(records: DataFrame) -> DataFrame:
    """(file_id, position, entropy) -> position faults and entropy faults per file (v01, v04)."""
    order = Window.partitionBy("file_id").orderBy("position")
    numbered = records.withColumn("_n", F.row_number().over(order) - 1)
    bad = F.col("entropy").isNull() & (F.col("position") != 0) | F.isnan("entropy") | (F.col("entropy") < 0) | (F.abs("entropy") == float("inf"))
    return numbered.groupBy("file_id").agg(F.count("*").alias("n_records"), F.count_if(F.col("_n") != F.col("position")).alias("position_faults"), F.count_if(bad).alias("entropy_faults"))


def token_faults(tokens: DataFrame) -> DataFrame:
    """Empty, unordered or overlapping tokens per file (v02)."""
    order = Window.partitionBy("file_id").orderBy("idx")
    wrong = (F.col("end_byte") <= F.col("start_byte")) | (F.col("start_byte") < F.lag("end_byte").over(order))
    return tokens.withColumn("_w", wrong).groupBy("file_id").agg(F.count_if("_w").alias("token_faults"))


def coverage_faults(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose pieces are not their source, byte by byte (v03): (file_id, covered)."""
    size = F.octet_length("bytes")
    start = F.coalesce(F.sum(size).over(Window.partitionBy("file_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = records.withColumn("_start", start.cast("int")).join(sources.select("file_id", F.col("text").cast("binary").alias("_src")), "file_id")
    same = F.expr("substring(_src, _start + 1, octet_length(bytes)) = bytes")
    return placed.groupBy("file_id").agg((F.bool_and(same) & (F.sum(size) == F.max(F.octet_length("_src")))).alias("covered"))
