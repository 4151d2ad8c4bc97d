"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

CAPACITY = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .knn_quality import fit_voters, held_out, quality_scores

    docs = read_table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit_voters(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import fit_line_crf, quality_rules

    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_line_crf(docs, read_table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    return best_fit_pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), CAPACITY, vocabulary("byte_bpe_50k.tiktoken"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import repair_roles

    return repair_roles(read_table(spark, sf_dir, "conversations")).drop("at")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
        - CAST(3 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW u AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST)),
t AS (SELECT source, source_size, least(CAST(3 AS DOUBLE) * CAST(source_size AS DOUBLE), max(level) OVER () * CAST(weight AS DOUBLE)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rate FROM t),
f AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, least(CAST(ceil((rate - floor(rate)) * CAST(4294967296 AS DOUBLE)) AS BIGINT), 4294967295) AS below FROM r),
c AS (SELECT d.doc_id, d.source, d.size, k.k,
        CAST('0x' || substr(sha256('mix:' || CAST(k.k // 8 AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), CAST(8 * (k.k % 8) + 1 AS INTEGER), 8) AS BIGINT) AS coin
      FROM d CROSS JOIN (SELECT unnest(range(64)) AS k) k),
g AS (SELECT f.source, c.k, abs(CAST(f.source_size * f.whole + sum(CASE WHEN c.coin < f.below THEN c.size ELSE 0 END) AS DOUBLE) - f.target) AS off
      FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source GROUP BY f.source, c.k, f.source_size, f.whole, f.target),
b AS (SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY off, k) AS nth FROM g) WHERE nth = 1)
SELECT c.doc_id, c.size, f.source_size, f.target, CAST(c.size * (f.whole + CASE WHEN c.coin < f.below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k JOIN f ON c.source IS NOT DISTINCT FROM f.source
"""


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(read_table(spark, sf_dir, "documents"), keep_media=False)


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import compact_documents

    stored = compact_documents(read_table(spark, sf_dir, "documents"), Scratch(spark, "shards").root)
    return stored.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.col("_shard_bytes") <= 64 << 20).alias("within_target"))


OP8_SQL = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS text_md5, TRUE AS within_target FROM documents"


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import group_near_duplicates

    found = group_near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_knn, op2_line_crf, op3_best_fit_packing, op4_chat_repair, op5_source_mix, op6_media, op7_suffix_repeats, op8_tiered_shards, op9_simhash, op10_skip_chain_pii, pipeline)}


def llm_oracle_sql() -> dict[str, str]:
    return {"op5_source_mix": OP5_SQL, "op8_tiered_shards": OP8_SQL}
