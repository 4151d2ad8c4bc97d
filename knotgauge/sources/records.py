"""Readers of token records: JSON lines, cache entries, run records (s10, s11, s18). Whatever is wrong is a fault in a column, and
no file, entry or run fails another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import decode_hex
from ..operators.tokens import coverage_faults

ENTRY_VERSION = 2


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, line) of text files under a path; each file is read whole by one task, so its lines keep their order."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    files = files.select(files.metadataColumn("_metadata")["file_path"].alias("file_id"), F.posexplode(F.split("value", "\n")).alias("k", "line"))
    return files.select("file_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


def _kind(value: Column, path: str) -> Column:
    """The type of a field of a parsed line; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def parse_records(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, line) -> (file_id, line_no, position, bytes, entropy, fault) of the lines that are not blank (s10).

    A line's fault is the first that holds: json (no object), position (no whole number from 0),
    order (not its place among the file's records), bytes (no hexadecimal string), entropy (absent),
    number (not a number), range (negative or not finite), null (but for the first record).
    """
    parsed = lines.where(F.regexp_replace("line", r"[ \t\r]", "") != "").withColumn("v", F.try_parse_json("line"))
    parsed = parsed.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no")) - 1)
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    position, kind = F.try_variant_get("v", "$.position", "bigint"), _kind(F.col("v"), "$.entropy")
    entropy = F.when(kind != "VOID", F.try_variant_get("v", "$.entropy", "double"))
    raw = decode_hex(F.when(_kind(F.col("v"), "$.bytes_hex") == "STRING", F.try_variant_get("v", "$.bytes_hex", "string")))
    number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$")
    fault = (
        F.when(~is_object, "json")
        .when(F.coalesce(_kind(F.col("v"), "$.position") != "BIGINT", F.lit(True)) | (position < 0), "position")
        .when(position != F.col("place"), "order")
        .when(raw.isNull(), "bytes")
        .when(kind.isNull(), "entropy")
        .when((kind != "VOID") & ~number, "number")
        .when((kind != "VOID") & ((entropy < 0) | F.isnan(entropy) | (entropy == float("inf"))), "range")
        .when((kind == "VOID") & (F.col("place") > 0), "null")
    )
    return parsed.select("file_id", "line_no", position.alias("position"), raw.alias("bytes"), entropy.alias("entropy"), fault.alias("fault"))


def read_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the files without a fault, the first fault of each other file with its line)."""
    parsed = parse_records(lines)
    faults = parsed.where("fault is not null").groupBy("file_id").agg(F.min_by(F.struct("line_no", "fault"), "line_no").alias("f")).select("file_id", "f.line_no", "f.fault")
    return parsed.join(faults, "file_id", "left_anti").drop("fault", "line_no"), faults


def entry_states(entries: DataFrame, sources: DataFrame, provenance: Column) -> DataFrame:
    """Cache entries (key, version, source_size, provenance, records of {bytes, entropy}) against their sources (key, text) (s11).

    key, state: the first that holds of malformed (no records, or one without bytes), version,
    size (not the source's), provenance (not the one asked for), incomplete (the records' bytes are
    not the source, or an entropy but the first is null), ok. Only ok entries are hits.
    """
    joined = entries.join(sources.select("key", "text"), "key", "left")
    records = joined.select(F.col("key").alias("file_id"), F.posexplode("records").alias("position", "r")).select("file_id", "position", "r.bytes", "r.entropy")
    held = records.groupBy("file_id").agg(F.bool_or(F.col("entropy").isNull() & (F.col("position") > 0)).alias("gap"))
    covered = coverage_faults(records, joined.select(F.col("key").alias("file_id"), "text"))
    judged = joined.join(held.join(covered, "file_id").withColumnRenamed("file_id", "key"), "key", "left")
    whole = F.when(F.size("records") == 0, F.octet_length("text") == 0).otherwise(F.col("covered") & ~F.col("gap"))
    state = (
        F.when(F.col("records").isNull() | F.exists("records", lambda r: r["bytes"].isNull()), "malformed")
        .when(F.coalesce(F.col("version") != ENTRY_VERSION, F.lit(True)), "version")
        .when(F.coalesce(F.col("source_size") != F.octet_length("text"), F.lit(True)), "size")
        .when(F.coalesce(F.col("provenance") != provenance, F.lit(True)), "provenance")
        .when(~F.coalesce(whole, F.lit(False)), "incomplete")
        .otherwise("ok")
    )
    return judged.select("key", state.alias("state"))


def entries_by_abi(entries: DataFrame) -> DataFrame:
    """How many entries (key, abi, state) each ABI has, malformed ones apart (a23)."""
    abi = F.when(F.col("state") == "malformed", F.lit("malformed")).otherwise(F.coalesce("abi", F.lit("malformed")))
    return entries.groupBy(abi.alias("abi")).agg(F.count("*").alias("n"))


RUN = "run string, model string, file string, tree_score double, token_count bigint"


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Run records (a JSON object a line, gzip or plain) with the line where it cannot be read (s18)."""
    return spark.read.schema(f"{RUN}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(glob)


def parse_runs(lines: DataFrame) -> DataFrame:
    """The same from a column `line`."""
    return lines.select(F.from_json("line", f"{RUN}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")


def admitted_runs(records: DataFrame) -> DataFrame:
    """run, model, n_records, n_unreadable, admitted: a run counts if all its records can be read and name one model."""
    runs = records.groupBy("run").agg(F.count("*").alias("n_records"), F.count_if(F.col("_bad").isNotNull() | F.col("tree_score").isNull()).alias("n_unreadable"), F.min("model").alias("model"), F.max("model").alias("_most"), F.count("model").alias("_named"))
    return runs.select("run", "model", "n_records", "n_unreadable", ((F.col("n_unreadable") == 0) & (F.col("model") == F.col("_most")) & (F.col("_named") == F.col("n_records"))).alias("admitted"))
