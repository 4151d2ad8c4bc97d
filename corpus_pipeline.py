"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotgauge.llm.common import Scratch, read_table
from knotgauge.llm.line_crf import fit_line_crf, keep_good
from knotgauge.llm.mixing import emit_mix
from knotgauge.llm.packing import best_fit_pack
from knotgauge.llm.pii import redact_personal_data
from knotgauge.llm.queries import CAPACITY, vocabulary
from knotgauge.llm.similar import drop_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line labelling rejects go.

    Null and empty texts fail the base rule (fewer than ten words); null ids and repeated rows are
    judged like any other; an empty table stays empty; other columns stay as they are.
    """
    return keep_good(docs, fit_line_crf(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more), the document with the smallest doc_id stays.

    SimHash near-dedup with a check of the similarity. Texts without words, null or empty, are copies
    of each other; a null doc_id comes last; repeated rows leave one; an empty table stays empty.
    """
    return drop_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows. Null texts stay null; no row goes."""
    return redact_personal_data(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all up to three times.

    Null sources are one source, weighed last; documents without words go with the coin like any
    other of their source; repeated rows share their coin; an empty table stays empty.
    """
    return emit_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a document taken twice has its pieces twice. Null text is one end token; no documents, no rows."""
    return best_fit_pack(docs, vocabulary("byte_bpe_50k.json"), CAPACITY, vocabulary("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Language models of lines, a tokenizer and a skip-chain field are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table goes once the next one's is written, and so does what operators have kept on the way."""
    scratch, docs, before = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch.released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
