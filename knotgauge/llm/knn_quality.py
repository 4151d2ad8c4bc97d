"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are trigrams of byte classes, hashed, and buckets of its repetition rates. A
bounded sample of labelled rows gives document frequencies and, by a truncated singular value
decomposition, the latent space; its labelled vectors (at most FIT_ROWS x DIMENSIONS numbers)
go to all executors. Every document's vector is multiplied with all of them in blocks; its
nearest NEIGHBOURS vote, weighted by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced


#: Bounds of the fit, whatever the corpus: labelled rows (the least by hash of their id), terms, latent dimensions.
FIT_ROWS, TERMS, DIMENSIONS = 3000, 512, 48
NEIGHBOURS, THRESHOLD = 15, 0.3
BUCKETS, RATES = 16, 7

_CLASS = np.arange(256, dtype=np.int64)  # of a byte: itself, but one for each of capitals, digits, high bytes, white space
_CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[[9, 11, 12, 13]] = 65, 48, 128, 32

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def term_weights(text: str) -> np.ndarray:
    """Term frequencies (dampened): TERMS hashed trigrams, then one-hot buckets of repetition rates, length, capitals, symbols and bars."""
    raw = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    out = np.zeros(TERMS + RATES * BUCKETS, np.float32)
    if len(c) > 2:
        code = ((c[:-2] << 16) + (c[1:-1] << 8) + c[2:]) * 0x9E3779B1 & 0xFFFFFFFF
        out[:TERMS] = np.sqrt(np.bincount(code * TERMS >> 32, minlength=TERMS) / len(code))
    words = raw.split()
    n = len(words)
    pairs = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    lower = raw.lower().split()
    rates = (1 - len(set(words)) / n if n else 0, pairs / (n - 1) if n > 1 else 0, 1 - len(set(zip(lower, lower[1:], lower[2:]))) / (n - 2) if n > 2 else 0, np.log2(n + 1) / 16, (c == 65).sum() / max(1, len(c)), 2 * np.sqrt(_SYMBOL[c].mean()) if len(c) else 0, 2 * np.sqrt(raw.count(b" | ") / n) if n else 0)
    for k, r in enumerate(rates):
        out[TERMS + BUCKETS * k + min(BUCKETS - 1, int(r * BUCKETS))] = 0.5 if k > 4 else 0.35
    return out


@dataclass
class LatentVoters:
    """idf over terms, basis (terms, dimensions), unit vectors of labelled rows, their labels, and the prior for texts without a vector."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @classmethod
    def fit(cls, terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> LatentVoters:
        if not len(terms):
            return cls(np.zeros(TERMS + RATES * BUCKETS, np.float32), np.zeros((TERMS + RATES * BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
        idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))).astype(np.float32) + np.float32(1)
        x = terms * idf
        values, basis = np.linalg.eigh(x.T @ x)  # the right singular vectors, from the terms' products
        basis = np.ascontiguousarray(basis[:, ::-1][:, :dimensions], float)
        vectors = cls._unit(x @ basis)
        return cls(idf, basis, vectors, labels.astype(np.float32), float(labels.mean()))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        """Shares of the votes for label 1; equally near neighbours count by their order in the sample."""
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        out, k = [], min(neighbours, len(self.vectors))
        for i in range(0, len(terms), block):
            near = self._unit((terms[i : i + block] * self.idf).astype(float) @ self.basis) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            least = np.take_along_axis(near, top[:, k - 1 :], 1)
            for row in np.flatnonzero((near >= least).sum(1) > k):  # ties at the edge: the first in the sample
                top[row] = np.argsort(-near[row], kind="stable")[:k]
            weight = np.maximum(np.take_along_axis(near, top, 1).astype(float), 0) ** 8 + 1e-9
            out.append((weight * self.labels[top]).sum(1) / weight.sum(1))
        return np.clip(np.concatenate(out), 0, 1).round(9) if out else np.zeros(0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([term_weights(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "terms"])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit_voters(docs: DataFrame, labels: DataFrame) -> LatentVoters:
    """Fits on at most FIT_ROWS labelled rows that are not held out."""
    sample = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    chosen = {int(r[0]): int(r[1]) for r in sample.collect()}
    if not chosen:
        return LatentVoters.fit(np.zeros((0, 0)), np.zeros(0))
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "_id long"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows: one text of each id (the least terms), so that FIT_ROWS bounds what is collected and no id counts twice
    rows = slim.join(few, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(_terms, "doc_id long, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return LatentVoters.fit(np.array([np.frombuffer(bytes(r.terms), np.float32) for r in rows]).reshape(len(rows), -1), np.array([chosen[r.doc_id] for r in rows]))


def quality_scores(docs: DataFrame, voters: LatentVoters) -> DataFrame:
    """doc_id, score and predicted for every document.

    Null text counts as empty; an empty text is scored by the neighbours of its length bucket like
    any other. Null ids and repeated rows are scored. Without labelled rows every score is 0.5.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(voters)  # bounded: FIT_ROWS x DIMENSIONS and TERMS x DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            terms = np.array([term_weights(x) for x in batch.column(1).to_pylist()], np.float32).reshape(batch.num_rows, -1)
            score = shared.value.score(terms) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
