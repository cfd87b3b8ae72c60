"""Hashed word and character n-gram counts of text blocks, and linear models over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import IS_SPACE, Block, blocks, mix, spans, word_hashes

#: N-grams of a family that are hashed at once.
STRETCH = 1 << 20


def _joined_words(hashes: np.ndarray, n: int) -> np.ndarray:
    joined, count = hashes, len(hashes) - n + 1
    for k in range(1, n):
        joined = mix(joined[: len(hashes) - k] * np.uint64(31) + hashes[k:])
    return joined[:count]


def _joined_characters(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n code points: three of 21 bits fit a number, then it is mixed and goes on."""
    packed = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        if k % 3 == 0:
            packed = mix(packed)
        packed = packed ^ (codes[k : k + len(packed)].astype(np.uint64) << np.uint64(21 * (k % 3)))
    return mix(packed)


@dataclass(frozen=True)
class HashedGrams:
    """Families of n-grams, each hashed to 2**bits buckets of its own; ``lower`` folds A-Z."""

    words: tuple[int, ...] = (1, 2)
    chars: tuple[int, ...] = (3, 4)
    bits: int = 12

    @property
    def size(self) -> int:
        return (len(self.words) + len(self.chars)) << self.bits

    def groups(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Family, buckets of a stretch of its n-grams, and where in it each text's n-grams begin and end.

        A family is cut into stretches of STRETCH n-grams, so that memory hardly follows the length of a text.
        """
        if self.words:
            starts, ends = spans(~IS_SPACE[block.buf])
            bounds, hashes = block.word_bounds(starts), word_hashes(block.buf, starts, ends)
            for g, n in enumerate(self.words):
                yield from self._stretches(g, n, hashes, _joined_words, bounds[:-1], np.maximum(bounds[1:] - n + 1, bounds[:-1]))
        if self.chars:
            codes, bounds = block.characters()
            for g, n in enumerate(self.chars, len(self.words)):
                # The line feed behind a text is no part of it.
                yield from self._stretches(g, n, codes, _joined_characters, bounds[:-1], np.maximum(bounds[1:] - n, bounds[:-1]))

    def _stretches(self, g: int, n: int, units: np.ndarray, join, lo: np.ndarray, hi: np.ndarray):
        for first in range(0, len(units) - n + 1, STRETCH):
            ids = (join(units[first : first + STRETCH + n - 1], n) >> np.uint64(64 - self.bits)).astype(np.int64) + (g << self.bits)
            yield g, ids, np.clip(lo - first, 0, len(ids)), np.clip(hi - first, 0, len(ids))

    def means(self, block: Block, tables: np.ndarray) -> np.ndarray:
        """For each text and each row of tables: the sum over families of the mean weight of its n-grams."""
        families = len(self.words) + len(self.chars)
        total, n = np.zeros((families, len(block), len(tables))), np.zeros((families, len(block), 1))
        for g, ids, lo, hi in self.groups(block):
            n[g, :, 0] += hi - lo
            for k, table in enumerate(tables):
                sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
                total[g, :, k] += sums[hi] - sums[lo]
        return (total / np.maximum(n, 1)).sum(axis=0)

    def counts(self, block: Block) -> np.ndarray:
        """Dense counts, one row per text."""
        out = np.zeros(len(block) * self.size, np.float32)
        for _, ids, lo, hi in self.groups(block):
            n = hi - lo
            owner = np.repeat(np.arange(len(block)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner]
            out += np.bincount(owner * self.size + ids[at], minlength=len(out)).astype(np.float32)
        return out.reshape(len(block), self.size)

    def sparse(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` of docs (doc text in ``text``) with packed ``idx`` and ``val``: family-wise frequencies."""
        kept = docs.select(*keep, "text")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                idx, val = [], []
                for block in blocks(batch.column(len(keep)), rows=64):
                    for row in self.counts(block):
                        parts = row.reshape(-1, 1 << self.bits)
                        row = (parts / np.maximum(parts.sum(axis=1, keepdims=True), 1)).ravel()
                        at = np.flatnonzero(row)
                        idx.append(at.astype(np.int32).tobytes())
                        val.append(row[at].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                    names=[*keep, "idx", "val"],
                )

        return kept.mapInArrow(run, f"{fields}, idx binary, val binary")


class Rows:
    """Collected sparse rows of a bounded training sample, one behind the other; products take ``CHUNK`` rows at a time."""

    CHUNK = 256

    def __init__(self, packed: list[tuple[bytes, bytes]], size: int):
        self.size, self.n = size, len(packed)
        self.idx = np.frombuffer(b"".join(i for i, _ in packed), np.int32)
        self.val = np.frombuffer(b"".join(v for _, v in packed), np.float32)
        self.first = np.concatenate([[0], np.cumsum([len(i) // 4 for i, _ in packed], dtype=np.int64)])

    def take(self, rows: np.ndarray) -> Rows:
        if len(rows) == self.n:
            return self
        spans = [(self.first[r], self.first[r + 1]) for r in rows]
        return Rows([(self.idx[a:b].tobytes(), self.val[a:b].tobytes()) for a, b in spans], self.size)

    def _chunks(self):
        for lo in range(0, self.n, self.CHUNK):
            hi = min(lo + self.CHUNK, self.n)
            a, b = self.first[lo], self.first[hi]
            yield lo, hi, np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), self.idx[a:b], self.val[a:b]

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for lo, hi, row, idx, val in self._chunks():
            out[lo:hi] = np.bincount(row, val * w[idx], hi - lo)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        for lo, hi, row, idx, val in self._chunks():
            out += np.bincount(idx, val * g[lo:hi][row], self.size)
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.size), np.float32)
        for lo, _, row, idx, val in self._chunks():
            out[lo + row, idx] = val
        return out


def fit_linear(rows: Rows, y: np.ndarray, loss: str, weight: np.ndarray | None = None, steps: int = 80, l2: float = 1e-6):
    """(weights, bias) of a linear model by full-batch Adam; y is +1 or -1; loss is "logistic" or "hinge" (squared)."""
    weight = np.ones(rows.n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    w, b = np.zeros(rows.size), 0.0
    m, v, mb, vb = np.zeros(rows.size), np.zeros(rows.size), 0.0, 0.0
    for t in range(1, steps + 1):
        f = rows.dot(w) + b
        g = -y / (1 + np.exp(np.clip(y * f, -50, 50))) if loss == "logistic" else -2 * y * np.maximum(0, 1 - y * f)
        g = g * weight
        gw, gb = rows.back(g) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, c = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.5 * (m / a) / (np.sqrt(v / c) + 1e-9)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    return w, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn=None) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` labelled documents, chosen by a hash of doc_id.

    Several labels of one document count by their mean (1 from one half on). Only ids travel before the choice is made.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(label) >= 0.5).cast("int").alias("y")
    )
    y = y if learn is None else y.filter(learn)
    known = y.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
