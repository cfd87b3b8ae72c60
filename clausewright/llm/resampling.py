"""Importance resampling towards a target distribution by hashed n-grams (operator 11).

Documents are weighted by how much likelier their words are in a target table than in the documents, by counts of hashed runs of one to
``longest`` words over all rows of both; a share of them is drawn with these weights without replacement (the largest of weight plus Gumbel noise).

A batch's texts are joined with a sentinel that no text holds, and one pass of one regular expression finds all words and sentinels. The text of a word is
found by ``searchsorted`` in the sentinels' places; n-grams that cross one are masked before their buckets are counted by ``bincount``. An n-gram's
CRC-32 is combined from those of its words, so that no n-gram is ever built.

Cases: a null, empty or word-less text has no features, weight 0 and is never drawn; repeated rows are rows of their own, and draw their own ranks
(ties go to the smaller doc_id, a null doc_id is the largest, and draws as if its text were empty); texts of any length are read a stretch of words at a time;
empty tables give empty results, and an empty target counts as no features; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import LOWER_AZ, Block, blocks
from clausewright.operators.numbering import number_rows

#: What stands behind each text: a byte that UTF-8 never holds.
END = b"\xff"
#: Words, in lower-cased text, are runs of ASCII letters and digits and of the bytes of other characters; an end is a token of its own.
TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
OUTSIDE = re.compile(rb"[^0-9a-z\x80-\xfe]")
_PREPARED = LOWER_AZ[:255] + b" "
#: Bytes of joined texts whose words are in memory at once.
STRETCH = 1 << 20
#: Bytes after a word whose CRC shifts are looked up in one step; longer words take more steps.
STEPS = 256


@dataclass(frozen=True)
class Grams:
    """Runs of 1 to ``longest`` words, hashed into ``buckets``."""

    longest: int = 3
    buckets: int = 10_000


def _shifts() -> np.ndarray:
    """[n, k, byte]: what a CRC-32 whose byte k is ``byte`` becomes when n bytes follow that are zero."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.empty((STEPS, 4, 256), np.uint32)
    tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(1, STEPS):
        before = tables[n - 1]
        tables[n] = one[before & 255] ^ (before >> np.uint32(8))
    return tables


_SHIFTS = _shifts().ravel()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    while True:
        now = np.minimum(n, STEPS - 1)
        at = now << 10
        out = _SHIFTS.take(at + (crc & 255))
        for k in (1, 2, 3):
            out ^= _SHIFTS.take(at + (k << 8) + ((crc >> (8 * k)) & 255))
        crc, n = out.astype(np.int64), n - now
        if not n.any():
            return crc


def _crcs(packed: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int = 0) -> np.ndarray:
    """CRC-32 of packed[start:start + length], of all words a byte at a time, behind what has the CRC-32 ``first``."""
    crc, rows, k = np.full(len(starts), first ^ 0xFFFFFFFF, np.int64), np.arange(len(starts)), 0
    table = _SHIFTS[1 << 10 : (1 << 10) + 256].astype(np.int64)
    while len(rows):
        if len(rows) < 64 < lengths[rows].max() - k:  # a few very long words
            for r in rows:
                a = int(starts[r])
                crc[r] = zlib.crc32(packed[a + k : a + int(lengths[r])], int(crc[r]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        now = crc[rows]
        crc[rows] = table[(now ^ packed[starts[rows] + k]) & 255] ^ (now >> 8)
        k += 1
        rows = rows[lengths[rows] > k]
    return crc ^ 0xFFFFFFFF


class Buckets:
    """The buckets of n-grams in batches of texts."""

    def __init__(self, grams: Grams):
        self.grams = grams

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, number of the text, bucket) of the n-grams in a stretch of the joined texts, for each n.

        A stretch ends between words and takes over the last tokens of the one before.
        """
        joined = END.join([*texts, b""])
        carried, done, ended, lo = np.empty((0, 3), np.int64), np.empty(0, np.int64), 0, 0
        while lo < len(joined):
            cut = OUTSIDE.search(joined, lo + STRETCH)
            hi = cut.start() if cut else len(joined)
            found = TOKEN.findall(joined, lo, hi)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            packed = np.frombuffer(b"".join(found), np.uint8)
            starts = np.cumsum(lengths) - lengths
            words = packed[starts] != END[0]
            ends = np.flatnonzero(~words)
            doc = ended + np.searchsorted(ends, np.flatnonzero(words))  # the text whose end comes next
            starts, lengths = starts[words], lengths[words]
            crc = _crcs(packed, starts, lengths)
            spaced = _shifted(np.full(len(crc), zlib.crc32(b" ")), lengths) ^ crc
            rows = np.concatenate([carried, np.column_stack([crc, spaced, lengths + 1])])
            doc, old = np.concatenate([done, doc]), len(done)
            yield from self._stretch(old, doc, *rows.T)
            keep = max(0, len(doc) - self.grams.longest + 1)
            carried, done, ended, lo = rows[keep:], doc[keep:], ended + len(ends), hi

    def _stretch(self, old: int, doc: np.ndarray, crc: np.ndarray, spaced: np.ndarray, length: np.ndarray):
        """The n-grams that end behind the first ``old`` words."""
        for n in range(1, self.grams.longest + 1):
            if n > 1:
                crc = _shifted(crc[:-1], length[n - 1 :]) ^ spaced[n - 1 :]
            if not len(crc):
                return
            lo = max(0, old - n + 1)
            first = doc[lo : len(crc)]
            inside = first == doc[lo + n - 1 :]  # no n-gram crosses the end of a text
            yield n, first[inside], crc[lo:][inside] % self.grams.buckets


def _batches(column: pa.Array) -> Iterator[Block]:
    return blocks(column, lambda t: t.translate(_PREPARED))


def bucket_counts(texts: DataFrame, grams: Grams) -> np.ndarray:
    """Features in each bucket over all rows of a table with ``text``: sums of one row of counts for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = np.zeros(grams.buckets, np.int64), Buckets(grams)
        for batch in batches:
            for block in _batches(batch.column(0)):
                for _, _, bucket in of.of(block.texts):
                    counts += np.bincount(bucket, minlength=grams.buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(grams.buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target against that in the source, both smoothed by one."""
    n = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, grams: Grams) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(grams)
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for block in _batches(batch.column(1)):
                at = slice(block.lo, block.hi)
                for n, doc, bucket in of.of(block.texts):
                    count = np.bincount(doc, minlength=len(block))
                    features[at] += count
                    words[at] += count * (n == 1)
                    # Sums of whole numbers far below 2**53 are exact in doubles.
                    weight[at] += np.bincount(doc, gain[bucket], len(block)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """A thousandth's floor of Gumbel noise from the seed and doc_id."""
    hexed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(hexed, 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, grams: Grams | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank (null if it is not drawn).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down. The tables of counts have one number a
    bucket; ranks are places in ranges of the scores.
    """
    grams = grams or Grams()
    gain = gains(bucket_counts(docs, grams), bucket_counts(target, grams))
    scored = weigh(docs, gain, grams).withColumn("score", F.col("weight") + noise(seed)).withColumn("open", F.col("n_words") >= least_words)
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = number_rows(scored, order, "place")
    drawn = placed.filter("open").agg(F.floor(F.count("*") * percent / 100).alias("drawn"))
    rank = F.when(F.col("open") & (F.col("place") <= F.col("drawn")), F.col("place"))
    return placed.crossJoin(F.broadcast(drawn)).select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))  # one row of drawn
