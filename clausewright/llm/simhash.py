"""SimHash near-duplicate classes by deletion-variant signatures (operator 3).

A 64-bit fingerprint is cut into three segments for a distance of four bits, into four for the seven of the pipeline's stage:
few enough that two fingerprints within the distance have a segment that differs in at most one bit, so they share an index
key made of one segment with one bit left out. Keys are joined by equality and every candidate is verified by its Hamming
distance.

Cases: null, empty and word-less texts have fingerprint zero and link like any other; texts shorter than a shingle
are one shingle; equal texts share a fingerprint, which enters the index once; repeated rows stay repeated rows; an
empty table gives an empty result; extra columns are ignored. A null doc_id keeps its row, and its class is named by
the smallest doc_id that is not null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import IS_SPACE, LOWER_AZ, Block, blocks, materialise, spans
from clausewright.llm.components import connected_components

SEED = 42
#: An index bucket with more fingerprints is dealt out as pairs of blocks of about this size.
BUCKET = 1024
#: A bucket of more than DEEP blocks is keyed again by pieces of the bits outside its segment.
DEEP = 64
#: Shingles that are hashed at once.
SHINGLES = 1 << 18

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[start:end] for many spans: spans of equal length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    half = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts) if len(order) else []:
            n, at = int(lengths[rows[0]]), starts[rows]
            if n > 64 * len(rows):
                out[rows] = [xxhash.xxh64_intdigest(buf[s : s + n].tobytes(), seed) for s in at]
                continue
            done = 0
            if n >= 32:
                first = np.array([seed], np.uint64)
                v = [first + _P1 + _P2, first + _P2, first, first - _P1]
                while done + 32 <= n:
                    v = [_round(x, wide[at + (done + 8 * i)]) for i, x in enumerate(v)]
                    done += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed, np.uint64) + _P5
            h = h + np.uint64(n)
            while done + 8 <= n:
                h = _rotl(h ^ _round(np.uint64(0), wide[at + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= n:
                h = _rotl(h ^ (half[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _rotl(h ^ (buf[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """First bit and width of the fewest equal segments of which one differs in at most one bit at ``distance`` or fewer."""
    n = distance // 2 + 1
    cuts = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_fingerprints(block: Block, width: int, least: int = 1) -> np.ndarray:
    """The fingerprints of a block's texts, as unsigned 64-bit integers; fewer than ``least`` shingles are one of all words."""
    word = ~IS_SPACE[block.buf]
    keep = word.copy()
    keep[1:] |= word[:-1]  # each word and the one separator behind it
    text = block.buf[keep]
    inside = word[keep]
    text = np.where(inside, text, np.uint8(32))
    result = np.zeros(len(block), np.uint64)
    if not len(text):
        return result
    starts, ends = spans(inside)
    first = block.word_bounds(spans(word)[0])
    counts = np.diff(first)
    whole = counts - width + 1 < least
    shingles = np.where(whole, np.minimum(counts, 1), counts - width + 1)
    size = np.where(whole, counts, width)
    has = np.flatnonzero(shingles)
    offset = np.concatenate([[0], np.cumsum(shingles[has])])
    ones = np.zeros((len(has), 64), np.int64)
    for lo in range(0, int(offset[-1]), SHINGLES):  # a very long text is hashed a stretch at a time
        number = np.arange(lo, min(lo + SHINGLES, int(offset[-1])))
        owner = np.searchsorted(offset, number, side="right") - 1
        at = number - offset[owner] + first[has][owner]
        last = at + size[has][owner] - 1
        a, b = starts[at[0]], ends[last[-1]]
        hashes = xxh64_spans(text[a:b], starts[at] - a, ends[last] - a)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        ones[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    result[has] = np.packbits(2 * ones > shingles[has][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def fingerprints(docs: DataFrame, width: int = 4, least: int = 1) -> DataFrame:
    """doc_id and fp (a signed long) of each document's shingles of ``width`` words; fewer than ``least`` are one of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_fingerprints(b, width, least) for b in blocks(batch.column(1), lambda t: t.translate(LOWER_AZ))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variant_keys(bits, pieces):
    """The keys of a fingerprint, one for each bit: which bit is left out, then the rest of its piece."""
    keys = []
    for shift, width in pieces:
        part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << p))).bitwiseOR(F.lit((shift + p) << 32)) for p in range(width)]
    return F.array(*keys)


def inner_keys(fp, key, distance: int = 4):
    """Keys of the bits outside the segment that ``key`` is made of; two fingerprints within the distance there share one."""
    pieces, bit, outside = segments(distance), F.shiftrightunsigned(key, 32), None
    for shift, width in pieces:
        low = fp.bitwiseAND(F.lit((1 << shift) - 1))
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, shift + width), shift)) if shift + width < 64 else low
        outside = (F if outside is None else outside).when(bit < shift + width, rest)
    return variant_keys(outside, segments(distance, 64 - min(width for _, width in pieces)))


def _canonical(x: np.ndarray, distance: int) -> np.ndarray:
    """The one key number under which a pair is reported, from the differing bits x."""
    out = np.full(len(x), -1, np.int64)
    for shift, width in reversed(segments(distance)):
        part = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        near = np.bitwise_count(part) <= 1
        bit = np.where(part > 0, np.bitwise_count(np.maximum(part, 1) - np.uint64(1)), 0)
        out[near] = shift + bit[near]
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace links between row numbers by (row, smallest row of its class), fewer in large classes."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ab[: len(a)], ab[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def _bucket_pairs(group: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int):
    """Linked rows of the same group, each pair under one key only; rows are sorted by group."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(group)) - 1  # rows behind this one in its group
    rows, gap, found = np.flatnonzero(left > 0), 1, []
    while len(rows):
        x = fp[rows] ^ fp[rows + gap]
        ok = (np.bitwise_count(x) <= distance) & (x != 0)
        ok[ok] = _canonical(x[ok], distance) == key[rows[ok]] >> 32
        found.append((rows[ok], rows[ok] + gap))
        gap += 1
        rows = rows[left[rows] >= gap]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def fingerprint_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) of fingerprints that connect exactly what links at ``distance`` or fewer bits connect; a group reports a spanning forest of its links."""

    def forest(key: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray):
        a, b = _forest(a, b) if len(a) else (a, b)
        return fp[a], fp[b]

    return _in_buckets(distinct, distance, forest, "a", "b")


def near_keys(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(key, fp): under which index keys a fingerprint meets another one at ``distance`` or fewer bits; any two such fingerprints share one of these keys."""

    def meeting(key: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray):
        rows = np.unique(np.concatenate([a, b]))
        return key[rows], fp[rows]

    return _in_buckets(distinct, distance, meeting, "key", "fp")


def _in_buckets(distinct: DataFrame, distance: int, report, *names: str) -> DataFrame:
    """What ``report`` makes of each group's keys, fingerprints and linked rows, once.

    Rows of an index bucket meet in one task only up to 2 * BUCKET of them; a larger bucket is cut into
    blocks, and each pair of blocks is a group by itself. A bucket of more than DEEP blocks is first keyed
    again by the bits outside its segment, so that a fingerprint isn't sent once for each of very many blocks.
    """
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(n, F.xxhash64("fp"))  # each row becomes 64; by fp the rows would stay in the few tasks that grouped them
    keyed = spread.select("fp", F.explode(variant_keys(F.col("fp"), segments(distance))).alias("key"))
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), "simhash-hot")
    large = F.col("n") > BUCKET * DEEP
    live = keyed.join(hot, "key", "left").withColumn("sub", F.lit(-1).cast("long"))
    if not hot.filter(large).isEmpty():
        inner = inner_keys(F.col("fp"), F.col("key"), distance)
        counted = keyed.join(hot.filter(large), "key").select("key", F.explode(inner).alias("sub")).groupBy("key", "sub").agg(F.count("*").alias("m"))
        subs = F.when(large, inner).otherwise(F.array(F.lit(-1).cast("long")))
        live = live.select("key", "fp", "n", F.explode(subs).alias("sub")).join(counted.filter(F.col("m") > BUCKET), ["key", "sub"], "left")
        live = live.withColumn("n", F.when(large, F.col("m")).otherwise(F.col("n")))
    own = F.expr("cast(pmod(xxhash64(fp, 7L), k) as int)")
    dealt = (
        live.withColumn("k", F.coalesce(F.ceil(F.col("n") / F.lit(BUCKET)), F.lit(1)).cast("int"))
        .withColumn("own", own)
        .select("key", "sub", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .select("key", "sub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def links(rows):
            *group, fp = rows
            change = np.any([np.diff(c) != 0 for c in group], axis=0)
            key, fp = group[0], fp.view(np.uint64)
            found = report(key, fp, *_bucket_pairs(np.concatenate([[0], np.cumsum(change)]), key, fp, distance))
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=list(names))

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            same = np.all([c == c[-1] for c in rows[:-1]], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield links([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        if rest is not None and len(rest[0]):
            yield links(rest)

    parts = dealt.repartition("key", "sub", "lo", "hi").sortWithinPartitions("key", "sub", "lo", "hi")
    return parts.mapInArrow(run, ", ".join(f"{x} long" for x in names)).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, least: int = 1) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id).

    Fingerprints, classes and names are tables before they are joined by fingerprint or root: then a join reads plain
    shuffles (or a small table), which adaptive execution splits where a third of the rows share a key.
    """
    marked = materialise(fingerprints(docs, width, least), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, distance)).withColumnRenamed("node", "fp")
    classes = materialise(distinct.join(roots, "fp").groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-classes")
    linked = roots.join(classes, "root").select("fp", "component_id")
    named = materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "simhash-names")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
