"""Shared plumbing: table reads, rows whole, scratch tables, word splitting.

Arrow batches of whole texts are bounded in bytes by Spark itself (arrow.maxBytesPerBatch, 64 MB
unless the session says otherwise), so no operator changes the session's batch size.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `most` bytes of the text or binary column (or one row): what Python holds several times over stays small."""
    for batch in batches:
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct: names of an operator's own beside it cannot clash with the caller's, dots in names do no harm."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores added until no column has it."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a local one, but for a local master only."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not (own := sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="knotgauge-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation.

    keep() cuts lineage by a Parquet write and lets Spark drop the shuffle files behind it.
    The tables go when the driver ends, with drop(), or at the end of a released() block.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, tag: str):
        Scratch.made.append(self)
        self.spark, self.root = spark, f"{shared_dir(spark)}/knotgauge-{tag}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self.cleaning():
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def cleaning(self) -> Iterator[None]:
        """What is written in this block leaves no shuffle files behind once it is written."""
        conf, name = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name, "false")
        conf.set(name, "true")
        try:
            yield
        finally:
            conf.set(name, before)

    @staticmethod
    @contextlib.contextmanager
    def released() -> Iterator[None]:
        """What operators called in this block have kept goes at its end: for callers that write an operator's result before they go on."""
        before = len(Scratch.made)
        try:
            yield
        finally:
            for scratch in Scratch.made[before:]:
                scratch.drop()
            del Scratch.made[before:]

    def drop(self, name: str = "") -> None:
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the context may have gone already when the driver ends
            pass
