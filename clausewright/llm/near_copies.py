"""Classes of near copies at an exact Jaccard similarity, for the pipeline's near-duplicate stage (on operator 3's fingerprints).

Two texts are linked where their sets of ``width``-word shingles (words split and lower-cased as in operator 3; fewer words are one shingle) have a Jaccard
similarity of ``least`` or more. Candidates come from operator 3's index: texts whose fingerprints differ in ``NEAR`` bits at most meet under a deletion variant
of a segment. At 0.8 about ten of the 64 bits differ, up to eighteen by chance, which deletion variants can't index. So more candidates
come from ``BANDS`` bands of ``ROWS`` minima each: two texts at 0.8 share one with a probability of 0.99. Within a bucket of either a SimHash distance of
``FAR`` bits at most and the share of equal minima rule out most pairs, and the sets of shingle hashes (32 bits each) decide every link. A
bucket reports a spanning forest of its links, so copies never become all their pairs.

Cases: null, empty and word-less texts are one class; equal word sequences are one class, whatever their doc_ids; a doc_id on rows with different texts names
different documents, told apart by a hash of the text; repeated rows are one document; a null doc_id is the largest, and rows without one count as
copies of each other where their texts are equal; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import IS_SPACE, LOWER_AZ, Block, blocks, materialise, mix, spans, word_hashes
from clausewright.llm.components import connected_components
from clausewright.llm.simhash import block_fingerprints, near_keys

BANDS, ROWS = 12, 5
#: Bits of a fingerprint in which texts differ at most that the index of deletion variants brings together.
NEAR = 7
#: Bits of a fingerprint in which texts at the similarity may differ, and the share of equal minima that they have at least; both three deviations off the mean.
FAR, ALIKE = 19, 0.63
#: Texts of a bucket that meet in one task, twice this number at most; a larger bucket is dealt as pairs of blocks.
BUCKET = 2048
#: Shingles whose minima are taken at once.
STRETCH = 1 << 16

_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block's texts, and where each text's begin; a text of fewer words is one shingle, one without words none."""
    starts, ends = spans(~IS_SPACE[block.buf])
    bounds, words = block.word_bounds(starts), word_hashes(block.buf, starts, ends)
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(block)), n)
    at = bounds[owner] + np.arange(first[-1]) - first[owner]
    size = np.minimum(counts[owner], width)
    joined = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = k < size
        joined[inside] = mix(joined[inside] * np.uint64(31) + words[at[inside] + k])
    return joined, first


def minima(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BANDS * ROWS) least values of the shingles under as many orders; a text without shingles has the largest."""
    out = np.full((len(first) - 1, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), STRETCH):
        part = shingles[lo : lo + STRETCH]
        heads = np.unique(np.clip(first[:-1][np.diff(first) > 0], lo, None) - lo)
        heads = heads[heads < len(part)]
        text = np.searchsorted(first, heads + lo, side="right") - 1
        for k, salt in enumerate(_SALTS):
            least = np.minimum.reduceat((part ^ (part >> np.uint64(29))) * salt, heads)
            out[text, k] = np.minimum(out[text, k], least)
    return out


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, mark (a hash of the text), node (16 bytes of SHA-256 of the words), n (shingles), fp, minima (a byte each) and bands (a key each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), lambda t: t.translate(LOWER_AZ)):
                shingles, first = shingle_hashes(block, width)
                least = minima(shingles, first)
                band = np.zeros((len(block), BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band * np.uint64(31) + least[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                nodes = [hashlib.sha256(b" ".join(t.split())).digest()[:16] for t in block.texts]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(block.lo, len(block)) for c in batch.columns[:2]), pa.array(nodes, pa.binary()), pa.array(n), pa.array(block_fingerprints(block, width).view(np.int64)),
                    pa.array([(row >> np.uint64(56)).astype(np.uint8).tobytes() for row in least], pa.binary()), pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                ], names=["doc_id", "mark", "node", "n", "fp", "minima", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark long, node binary, n long, fp long, minima binary, bands array<long>")


def _gram_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, grams): sorted 32-bit hashes of the different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), lambda t: t.translate(LOWER_AZ)):
                shingles, first = shingle_hashes(block, width)
                sets = [np.unique((shingles[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, len(block)), pa.array(sets, pa.binary())], names=["node", "grams"])

    return docs.select("node", "text").mapInArrow(run, "node binary, grams binary")


class _Bucket:
    """The texts of a bucket, or of two of its blocks: links that connect what is similar enough, by their classes."""

    def __init__(self, rows: list[dict], least: float):
        self.least = least
        self.own = np.array([r["own"] for r in rows])
        self.fp = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
        self.minima = np.frombuffer(b"".join(r["minima"] for r in rows), np.uint8).reshape(len(rows), -1)
        self.grams = [np.frombuffer(r["grams"], np.uint32) for r in rows]
        self.size = np.array([len(g) for g in self.grams])

    def _similar(self, i: int, j: int) -> bool:
        a, b = self.grams[i], self.grams[j]
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
        return both >= self.least * (len(a) + len(b) - both) - 1e-9

    def links(self) -> list[tuple[int, int]]:
        label = np.arange(len(self.fp))  # the class of each text
        out, apart = [], len(np.unique(self.own)) > 1  # two blocks are compared with each other only
        for i in range(len(label) - 1):
            j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            ok = np.bitwise_count(self.fp[j] ^ self.fp[i]) <= FAR
            ok &= np.minimum(self.size[j], self.size[i]) >= self.least * np.maximum(self.size[j], self.size[i])
            if apart:
                ok &= self.own[j] != self.own[i]
            j = j[ok]
            alike = (self.minima[j] == self.minima[i]).mean(axis=1)
            j = j[alike >= ALIKE]
            for k in j[np.argsort(-alike[alike >= ALIKE], kind="stable")].tolist():
                if label[i] != label[k] and self._similar(i, k):
                    label[label == label[k]] = label[i]
                    out.append((i, k))
        return out


def index_keys(texts: DataFrame) -> DataFrame:
    """(node, key): the keys of SimHash's index under which a text meets another one at NEAR bits or fewer, or with the same fingerprint."""
    long = texts.filter("n > 1").select("node", "fp")  # one shingle is similar to itself alone
    distinct = materialise(long.groupBy("fp").agg(F.count("*").alias("m")), "near-fingerprints")
    near = materialise(near_keys(distinct, NEAR), "near-simhash")
    equal = distinct.filter("m > 1").select(F.xxhash64("fp").alias("key"), "fp")
    return materialise(near.unionByName(equal).join(long, "fp").select("node", "key"), "near-keys")


def similar_links(docs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) nodes that connect what the links at ``least`` connect. ``texts`` are the different word sequences: node, rep, fp, minima, bands."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.filter("n > 1").select("node", F.explode("bands").alias("key")).unionByName(index_keys(texts))
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "near-buckets")
    live = materialise(keyed.join(shared, "key"), "near-live")
    chosen = live.select("node").distinct().join(texts, "node").select("node", "fp", "minima", F.col("rep.doc_id").alias("d"), F.col("rep.mark").alias("k"))
    first = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").join(chosen, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("mark")))
    grams = _gram_sets(first, width).dropDuplicates(["node"])
    known = materialise(chosen.join(grams, "node").select("node", "fp", "minima", "grams"), "near-grams")
    blocks_of = F.ceil(F.col("m") / F.lit(BUCKET)).cast("int")
    dealt = live.join(known, "node").withColumn("k", blocks_of).withColumn("own", F.expr("cast(pmod(xxhash64(node), k) as int)"))
    dealt = dealt.select("key", "node", "fp", "minima", "grams", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def links():
            found = _Bucket(rows, least).links() if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[x[k]]["node"] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if rows and any(rows[0][c] != r[c] for c in ("key", "lo", "hi")):
                    yield links()
                    rows.clear()
                rows.append(r)
        if rows:
            yield links()

    parts = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return parts.mapInArrow(run, "a binary, b binary").distinct()


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, mark, node, rep): each different row of docs with the document that stands for its class, the one with the smallest doc_id.

    ``rep`` is struct<unnamed, doc_id, mark>; mark is xxhash64 of the text.
    """
    rows = materialise(sketches(docs, width), "near-rows")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    texts = materialise(rows.groupBy("node").agg(F.min(own).alias("rep"), *(F.first(c).alias(c) for c in ("n", "fp", "minima", "bands"))), "near-texts")
    roots = connected_components(similar_links(docs, texts, width, least))
    linked = roots.join(texts.select("node", "rep"), "node")
    best = materialise(linked.groupBy("root").agg(F.min("rep").alias("best")), "near-classes")
    named = materialise(linked.join(best, "root").select("node", "best"), "near-names")
    classes = texts.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("best", "rep").alias("rep"))
    return rows.select("doc_id", "mark", "node").join(classes, "node")


def keep_representatives(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each class, with all columns of docs: that with the smallest doc_id, and of rows without doc_id any one, if none has a doc_id.

    Repeated rows of a document with a doc_id stay repeated.
    """
    apart = ~(F.col("rep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("rep.mark") == F.col("mark")))
    gone = near_copies(docs, width, least).filter(apart).select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m")).distinct()
    gone = materialise(gone, "near-gone")
    named = docs.filter("doc_id is not null")
    kept = named.join(gone.filter("__d is not null"), (named["doc_id"] == F.col("__d")) & (F.xxhash64(named["text"]) == F.col("__m")), "left_anti")
    unnamed = docs.filter("doc_id is null")
    others = unnamed.join(gone.filter("__d is null"), F.xxhash64(unnamed["text"]) == F.col("__m"), "left_anti")
    return kept.unionByName(others.withColumn("__m", F.xxhash64("text")).dropDuplicates(["__m"]).drop("__m"))
