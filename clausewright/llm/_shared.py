"""Shared storage, lineage cuts and text blocks for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; one longer text is a block by itself.
BLOCK_BYTES = 1 << 20


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id="doc_id"):
    """True for documents whose crc32(doc_id as text) mod 4 is 2: never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


class Block:
    """Consecutive rows of an Arrow batch: ``texts`` as bytes, and ``buf`` where each ends with a line feed."""

    def __init__(self, lo: int, hi: int, texts: list[bytes]):
        self.lo, self.hi, self.texts = lo, hi, texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.bounds = np.concatenate([[0], ends])

    def __len__(self) -> int:
        return self.hi - self.lo

    def word_bounds(self, starts: np.ndarray) -> np.ndarray:
        """Where each text's words begin in an ascending array of word starts."""
        return np.searchsorted(starts, self.bounds)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's bytes and the line feed behind, without a running sum of all."""
        return np.add.reduceat(values, self.bounds[:-1], dtype=np.int64)

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the texts, a line feed behind each, and where each text begins."""
        texts = [t.decode("utf-8", "replace") for t in self.texts]
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


def blocks(column: pa.Array, prepare=None, limit: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[Block]:
    """Cut a string column into blocks of about ``limit`` bytes and at most ``rows`` texts; null counts as empty."""
    texts, size, lo = [], 0, 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        if texts and (size + len(text) > limit or len(texts) == rows):
            yield Block(lo, i, texts)
            texts, size, lo = [], 0, i
        texts.append(prepare(text) if prepare else text)
        size += len(text)
    if texts:
        yield Block(lo, lo + len(texts), texts)


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: What separates words in the contracts: space and the controls 09 to 0D.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = byte_set(SPACES)
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last value must be False."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    return edges[::2], edges[1::2]


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], also for empty segments."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Numbers(dict):
    """Numbers what is looked up, in order of first appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], from prefix sums."""
    power, inverse = _power_tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 1 << 17) -> np.ndarray:
    """Hashes of words in order, a stretch at a time, so that memory doesn't follow the length of a text."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), words):
        a, b = starts[lo : lo + words], ends[lo : lo + words]
        out[lo : lo + words] = span_hashes(buf[a[0] : b[-1] + 1], a - a[0], b - a[0])
    return out
