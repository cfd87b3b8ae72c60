"""Quality rules: counting rules, then a calibrated hashed n-gram logistic regression (operator 2).

The model is trained on at most ``TRAIN_ROWS`` labelled rows chosen by a hash of doc_id; four fifths fit the
weights and one fifth fits the probability calibration. Scoring reads every text in Arrow batches.

Words are numbered exactly within a block of texts, so windows count as repeated only if their bytes agree. A very long text is a block of its own,
whose n-grams are hashed a stretch at a time.

Cases: a null, empty or word-less text has zero counts, fails the base rules and is not kept; without
usable labels, or with one class only, the probability is the share of label 1 (1 without any labels); repeated rows
give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._features import HashedGrams, Rows, fit_linear, labelled_sample, sigmoid
from clausewright.llm._shared import IS_SPACE, SPACES, Block, Numbers, blocks, byte_set, segment_sum, spans

TRAIN_ROWS = 4000
THRESHOLD = 0.5
MIN_WORDS = 50
GRAMS = HashedGrams(words=(1, 2), chars=(3, 4), bits=12)
#: Words that are split off and numbered at once.
WORDS = 1 << 17
_SYMBOL = byte_set(b"#*$%&|<>")


def _repeated_windows(owner: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """Which windows of three words occur twice in their text; words are numbered from 0 to size - 1, so nothing is hashed."""
    at = np.flatnonzero(owner[2:] == owner[:-2])
    bits = max(size - 1, 1).bit_length()
    if int(owner[-1]).bit_length() + 3 * bits < 64:
        key = owner[at]
        for k in range(3):
            key = (key << bits) | word[at + k]
    else:
        key = np.unique(owner[at] * size + word[at], return_inverse=True)[1]
        key = np.unique(key * size + word[at + 1], return_inverse=True)[1] * size + word[at + 2]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return at[twice]


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    buf, inside = block.buf, ~IS_SPACE[block.buf]
    starts, ends = spans(inside)
    bounds, numbers = block.word_bounds(starts), Numbers()
    word, owner = np.zeros(len(starts), np.int64), np.repeat(np.arange(len(block)), np.diff(bounds))
    for lo in range(0, len(starts), WORDS):
        hi = min(lo + WORDS, len(starts))
        word[lo:hi] = np.fromiter(map(numbers.__getitem__, buf[starts[lo] : ends[hi - 1]].tobytes().split()), np.int64, hi - lo)
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        at = _repeated_windows(owner, word, len(numbers))
        for k in range(3):
            repeated[at + k] = True
    dup_lines = []
    for text in block.texts:
        lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(bounds),
        "word_chars": block.sums(inside & ((buf & 0xC0) != 0x80)),
        "n_symbols": block.sums(_SYMBOL[buf]),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": segment_sum(repeated, bounds),
    }


class QualityModel:
    """Weights with calibration: probability = sigmoid(slope * (mean weights + bias) + shift)."""

    def __init__(self, weights, bias=0.0, slope=1.0, shift=0.0):
        self.weights, self.bias, self.slope, self.shift = np.asarray(weights, np.float32), bias, slope, shift

    def probability(self, block: Block) -> np.ndarray:
        return sigmoid(self.slope * (GRAMS.means(block, self.weights[None])[:, 0] + self.bias) + self.shift)


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-back scores, by damped Newton steps."""
    ab, x = np.array([1.0, 0.0]), np.stack([f, np.ones(len(f))])
    target = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(50):
        p = sigmoid(ab @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * (ab - [1, 0]))
        ab -= np.clip(step, -2, 2)
    return float(max(ab[0], 1e-3)), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on a bounded hash sample of the labelled documents."""
    sample = GRAMS.sparse(labelled_sample(docs, labels, label, rows), ["doc_id", "y"]).collect()
    sample.sort(key=lambda r: r.doc_id)
    y = np.array([2 * r.y - 1 for r in sample])
    if len(set(y)) < 2:
        share = np.mean(y > 0) if len(y) else 1.0
        return QualityModel(np.zeros(GRAMS.size), shift=60.0 * (2 * share - 1))
    fold = np.arange(len(y)) % 5 == 4
    fit, held = (Rows([(r.idx, r.val) for r, f in zip(sample, fold, strict=True) if f == part], GRAMS.size) for part in (False, True))
    del sample
    weights, bias = fit_linear(fit, y[~fold], "logistic")
    return QualityModel(weights, bias, *_calibrate(held.dot(weights) + bias, y[fold]))


def apply_rules(
    docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = batch.column(0).slice(block.lo, len(block))
                counts = base_counts(block)
                arrays = [ids, *(pa.array(counts[n].astype(np.int64)) for n in names), pa.array(model.probability(block))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "probability"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", probability double"
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("probability") >= threshold)).alias("kept"), "probability"
    )
