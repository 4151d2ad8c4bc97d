"""The model registry as a small dimension table, and how a threshold is resolved (s17, p21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The threshold where no model has one of its own.
PAPER_TAU = 0.67
SCHEMA = "name string, file string, sha256 string, approx_bytes long, note string, default_tau double"
# Names, files, digests, sizes and calibrated thresholds of the known models.
MODELS = (
    ("deepseek-coder-v2-lite-base-q6_k", "DeepSeek-Coder-V2-Lite-Base-Q6_K.gguf", "5a2e25280075d769abdb111de8211d9d3367f2ae0d0e6166a288ee6e8ed0345d", 14_000_000_000, "default", 0.586),
    ("deepseek-coder-6.7b-base-q6_k", "deepseek-coder-6.7b-base.Q6_K.gguf", "e3bab613303f5f356b219900384693a3860f283fa95e03ebbc0209970d705643", 5_500_000_000, "", 0.7968),
    ("qwen2.5-coder-1.5b-q6_k", "Qwen2.5-Coder-1.5B.Q6_K.gguf", "05de834c633e92becf8acb12d94f61e3fbb70d3bb7f10d98340eac3c774ca688", 1_300_000_000, "smaller alternative: low memory", 0.7885),
    ("qwen2.5-coder-3b-q6_k", "Qwen2.5-Coder-3B-Q6_K.gguf", "37e2e03ee32f3429ea22c38472888e5631ca81350f546d7a918850c3a442329e", 2_500_000_000, "smaller alternative: closer rankings", 0.7783),
    ("qwen2.5-coder-0.5b-q4_k_m", "Qwen2.5-Coder-0.5B-Q4_K_M.gguf", "fefe9d34df79d3ad3db33519d81112be76096626a5fdb87a98092035dc79ad68", 400_000_000, "smoke/testing", 0.9939),
    ("codellama-7b-q8_0", "CodeLlama-7b-hf.Q8_0.gguf", "c74a4a47189f90e0e4b563777f914e172f34e7e1e1cc784f4b1cf8b4ae486ffa", 7_200_000_000, "paper reference model; not default", 0.676),
)


def model_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), SCHEMA)


def resolve_tau(requests: DataFrame) -> DataFrame:
    """(tau_percentile, tau, model, digest) -> tau and tau_source: the caller's percentile, then value, then the model's own
    (declined if the digest is another's), then PAPER_TAU. The registry is a fixed handful of rows and is broadcast."""
    known = F.broadcast(model_registry(requests.sparkSession).select(F.col("name").alias("model"), F.col("sha256").alias("_sha"), F.col("default_tau").alias("_own")))
    other = F.col("_own").isNotNull() & F.coalesce((F.col("digest") != "") & (F.col("digest") != F.col("_sha")), F.lit(False))
    cli = F.col("tau_percentile").isNotNull() | F.col("tau").isNotNull()
    source = F.when(cli, "cli").when(other, "model-digest-mismatch").when(F.col("_own").isNotNull(), "model-default").otherwise("paper-default")
    value = F.when(F.col("tau_percentile").isNotNull(), F.lit(None)).when(F.col("tau").isNotNull(), F.col("tau")).when(other | F.col("_own").isNull(), F.lit(PAPER_TAU)).otherwise(F.col("_own"))
    return requests.join(known, "model", "left").withColumn("resolved_tau", value).withColumn("tau_source", source).drop("_sha", "_own")
