"""Quality classifier: nearest-neighbour voting among latent-semantic vectors (operator 10).

Document frequencies of hashed n-grams are counted over all documents. A bounded hash sample of labelled
documents, none of them held out, is weighted by them and factored (truncated SVD); every document is projected, compared
with every labelled vector in blocks, and takes the labels of its nearest neighbours weighted by similarity.

Cases: a null or empty text, and any text whose vector is zero, scores the share of label 1 in the sample (0.5 without
labels); neighbours that tie with the last one vote too; equal texts score alike; repeated rows stay repeated; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._features import HashedGrams, Rows, labelled_sample
from clausewright.llm._shared import blocks, held_out

#: Labelled vectors at most, each of RANK numbers: a proven bound of what is broadcast.
TRAIN_ROWS = 3000
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 4.0
THRESHOLD = 0.7
GRAMS = HashedGrams(words=(1,), chars=(4,), bits=12)


def document_frequencies(docs: DataFrame, grams: HashedGrams = GRAMS) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all documents; one vector leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(grams.size, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0), rows=128):
                seen += (grams.counts(block) > 0).sum(axis=0)
                n += len(block)
        at = np.flatnonzero(seen)
        ids, df = np.concatenate([[-1], at]), np.concatenate([[n], seen[at]])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(df)], names=["bucket", "df"])

    counted = docs.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    out, total = np.zeros(grams.size), 0
    for r in counted.collect():  # at most grams.size + 1 rows
        if r.bucket < 0:
            total = r.df
        else:
            out[r.bucket] = r.df
    return out, total


class VotingModel:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, y: np.ndarray):
        self.table = (idf[:, None] * basis).astype(np.float32)
        self.vectors, self.y = vectors.astype(np.float32), y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5

    def project(self, counts: np.ndarray, grams: HashedGrams) -> np.ndarray:
        parts = counts.reshape(len(counts), -1, 1 << grams.bits)
        parts = parts / np.maximum(parts.sum(axis=2, keepdims=True), 1)
        return _unit(parts.reshape(len(counts), -1) @ self.table)

    def scores(self, vectors: np.ndarray, k: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
        if not len(self.y):
            return np.full(len(vectors), 0.5)
        near = vectors @ self.vectors.T
        k = min(k, len(self.y))
        last = np.partition(near, len(self.y) - k, axis=1)[:, len(self.y) - k]
        weight = np.where(near >= last[:, None] - 1e-5, np.maximum(near, 0), 0).astype(np.float64) ** sharpness
        total = weight.sum(axis=1)
        return np.clip(np.where(total > 1e-12, weight @ self.y / np.maximum(total, 1e-12), self.prior), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-12, x / np.maximum(norm, 1e-12), 0)


def _basis(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, rank: int = RANK) -> VotingModel:
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    sample = GRAMS.sparse(labelled_sample(docs, labels, label, rows, learn=~held_out()), ["doc_id", "y"]).collect()
    sample.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in sample], np.float32)
    if not sample:
        return VotingModel(idf, np.zeros((GRAMS.size, 1)), np.zeros((0, 1)), y)
    x = Rows([(r.idx, r.val) for r in sample], GRAMS.size).dense() * idf.astype(np.float32)
    basis = _basis(_unit(x), rank)
    return VotingModel(idf, basis, _unit(x @ basis), y)


def score(docs: DataFrame, model: VotingModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), rows=128):
                found = model.scores(model.project(GRAMS.counts(block), GRAMS))
                ids = batch.column(0).slice(block.lo, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
