"""Removal of repeated byte strings by logarithmic families of suffix arrays (operator 6).

A byte goes if a ``length``-byte string that covers it also starts earlier (smaller doc_id, or earlier in the document; texts with
one doc_id, or with none, are in order of their hashes). Consecutive strings with the same least k-gram hash travel as one run.

Only runs whose hash occurs twice can repeat. So each task first asks, once for each hash that it has, whether other tasks have it too, and
hears so by document. Then the bytes of such runs leave the texts: of runs with equal bytes in a task only the first. They are dealt by their hash, so
equal strings meet, and taken in order of place, a batch at a time: the batch gets a suffix array (its suffixes in order, as far as ``length`` bytes),
which is merge-scanned against the levels of an index, then joins them; levels of about equal size merge, so their number is
logarithmic. The levels last over all batches of a range of hashes. Every removal rests on a comparison of bytes; hashes only say where strings meet.

A frequent hash (a passage with other neighbours in very many documents) would be one large group. Its strings are dealt one by one, each by
a hash of its own, and of equal ones in a task only the first travels. The list of such hashes comes from exact counts and is bounded by SHARE.

The text is shuffled once, by doc_id and text hash; what cuts out the runs and what removes the spans reuse that exchange.

Cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; matches never cross documents; equal
texts keep the one with the smallest doc_id whole; rows that repeat a doc_id with its text are treated alike and none makes the
other go; a null doc_id counts as the largest, and different texts with one doc_id or without are documents of their own; a very long text
is taken in pieces that overlap by ``length`` - 1 bytes, so its strings are the same; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import Block, materialise, span_hashes

LENGTH = 100
GRAM = 32
#: Strings in one batch of the index.
BATCH = 1 << 16
#: Ranges of hashes in a partition; each has an index of its own, and one is in memory at a time.
RANGES = 8
#: Runs, and bytes of runs, that a task packs at once.
PACKED_RUNS, PACKED_BYTES = 1 << 19, 1 << 23
#: Bytes of text whose grams a task hashes at once; a longer text comes in pieces.
PIECE_BYTES = 1 << 19
#: A hash is frequent with at least HOT different runs, if they are also one in SHARE of all. So at most SHARE hashes (half a megabyte) are sent to the
#: tasks, and the runs of any other hash are fewer than one in SHARE of all: less than the share of an ordinary task.
HOT, SHARE = 1024, 1 << 16
_LAST = (1 << 63) - 1
ASKED = "p int, h binary, key binary, n binary, told binary, told_key binary"
SHIPPED = "p int, h binary, doc_id binary, mark binary, start binary, n binary, content binary"
SPAN = "doc_id long, mark long, start long, n long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of chunks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    chunks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(chunks, axis=1).ravel()
    behind = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(column: pa.Array, length: int, limit: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks of texts with the row and the offset of each; each string of a text lies in exactly one piece of it."""
    texts, rows, offsets, size = [], [], [], 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        for at in range(0, max(len(text) - length + 1, 1), limit):
            part = text[at : at + limit + length - 1]
            if texts and (size + len(part) > limit or len(texts) == 4096):
                yield Block(0, len(texts), texts), np.array(rows), np.array(offsets)
                texts, rows, offsets, size = [], [], [], 0
            texts.append(part)
            rows.append(i)
            offsets.append(at)
            size += len(part)
    if texts:
        yield Block(0, len(texts), texts), np.array(rows), np.array(offsets)


def block_runs(block: Block, length: int, gram: int):
    """Runs of strings with equal least k-gram hash: (hash, hash of all bytes, text number, start in the block, number of strings)."""
    buf, none = block.buf, np.zeros(0, np.int64)
    if len(buf) <= length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    at = np.arange(len(buf) - gram + 1)
    grams = span_hashes(buf, at, at + gram)
    least = sliding_least(grams, length - gram + 1)
    owner = np.repeat(np.arange(len(block)), np.diff(block.bounds))[: len(least)]
    whole = np.arange(len(least)) + length < block.bounds[1:][owner]  # the line feed behind a text is no part of it
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    new[1:] |= grams[: len(least) - 1] == least[:-1]  # the gram left; so strings of a run have it at different offsets and differ
    starts = np.flatnonzero(new & whole)
    edges = np.append(np.flatnonzero(new | ~whole), len(least))
    ends = edges[np.searchsorted(edges, starts, side="right")]
    return least[starts], span_hashes(buf, starts, ends + length - 1), owner[starts], starts, ends - starts


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _joined(rows: list[bytes | None], kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in rows if x), kind)


def _dealt(part: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by part; parts are numbers below n."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[p] : edges[p + 1]]
        yield p, [c[at] for c in columns]


def _ask(batches: Iterator[pa.RecordBatch], length: int, gram: int, n: int, piece: int) -> Iterator[pa.RecordBatch]:
    """ASKED rows of (text, key): by partition the hashes of a task's runs, each with one document that has it and how many different runs; and
    which other documents have it, if several do."""

    def packed(held) -> pa.RecordBatch:
        h, s, key = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key, s, h))
        h, s, key = (x[order] for x in (h, s, key))
        first = np.flatnonzero(_changes(h))
        runs = np.add.reduceat(_changes(h, s).astype(np.uint32), first)
        several = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
        told = several & _changes(h, key)
        part = (h % np.uint64(n)).astype(np.int64)
        rows = {p: [*(x.tobytes() for x in c), None, None] for p, c in _dealt(part[first], [h[first], key[first], runs], n)}
        for p, (a, b) in _dealt(part[told], [h[told], key[told]], n):
            rows[p][3:] = a.tobytes(), b.tobytes()
        columns = list(zip(*rows.values(), strict=True)) or [()] * 5
        return _batch(_names(ASKED), [np.array(list(rows), np.int32), *(pa.array(c, pa.binary()) for c in columns)])

    held, size = [], 0
    for batch in batches:
        keys = batch.column(1).to_numpy()
        for block, rows, _ in pieces(batch.column(0), length, piece):
            h, s, text, _, _ = block_runs(block, length, gram)
            held.append((h, s, keys[rows[text]]))
            size += len(h)
            if size >= PACKED_RUNS:
                yield packed(held)
                held, size = [], 0
    if size:
        yield packed(held)


def _answer(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, hashes) of documents with hashes that occur twice; (null, null, h, n) of hashes with many runs; and (null, null, null, n) of all runs."""
    found = [[] for _ in range(5)]
    for batch in batches:
        for held, column in zip(found, batch.columns[1:], strict=True):
            held += column.to_pylist()
    h, key, n, told, told_key = (_joined(x, k) for x, k in zip(found, (np.uint64, np.int64, np.uint32, np.uint64, np.int64), strict=True))
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, key, n = h[order], key[order], n[order].astype(np.int64)
    first = np.flatnonzero(_changes(h))
    times, runs = np.diff(np.append(first, len(h))), np.add.reduceat(n, first)
    again = np.repeat(times > 1, times)
    hs, keys = np.concatenate([h[again], told]), np.concatenate([key[again], told_key])
    order = np.argsort(keys, kind="stable")
    hs, keys = hs[order], keys[order]
    edges = np.append(np.flatnonzero(_changes(keys)), len(keys))
    packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((8 * edges).astype(np.int32)), pa.py_buffer(hs)])
    many = np.flatnonzero(runs >= least)
    names, none = ["key", "hashes", "h", "n"], pa.nulls
    yield _batch(names, [keys[edges[:-1]], packed, none(len(packed), pa.int64()), none(len(packed), pa.int64())])
    counts = pa.array([*h[first[many]].view(np.int64).tolist(), None], pa.int64())
    yield _batch(names, [none(len(counts), pa.int64()), none(len(counts), pa.binary()), counts, np.append(runs[many], runs.sum())])


def repeated_hashes(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, least: int | None = None) -> DataFrame:
    """What ``_answer`` says about (text, key): the hashes of each document's runs that occur more than once in all texts."""
    least, n, piece = least or HOT, _partitions(keyed), PIECE_BYTES
    asked = keyed.select("text", "key").mapInArrow(lambda b: _ask(b, length, gram, n, piece), ASKED)
    return asked.repartitionById(n, "p").mapInArrow(lambda b: _answer(b, least), "key long, hashes binary, h long, n long")


def frequent_hashes(answers: DataFrame, least: int | None = None, share: int | None = None) -> np.ndarray:
    """The sorted hashes of very many different runs: at most ``share`` of them."""
    counts = answers.filter("key is null")
    total = counts.filter("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.filter(F.col("h").isNotNull() & (F.col("n") >= max(least or HOT, total / (share or SHARE)))).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64)).view(np.uint64)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length``-byte strings that start at some places, as fixed-width values (which compare byte by byte)."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the things counted: its owner and its number within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _ship(batches: Iterator[pa.RecordBatch], length: int, gram: int, n: int, piece: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """SHIPPED rows of (doc_id, mark, text, hashes): the bytes of runs that may repeat, by partition; rows without bytes are spans known to go."""

    def packed(held) -> pa.RecordBatch:
        h, s, doc, mark, start, count = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
        content = [c for x in held for c in x[6]]
        order = np.lexsort((start, mark, doc, s, h))
        h, s, doc, mark, start, count = (x[order] for x in (h, s, doc, mark, start, count))
        content = [content[i] for i in order.tolist()]
        head = np.maximum.accumulate(np.where(_changes(h, s), np.arange(len(h)), 0))
        equal = np.fromiter((content[a] == content[b] for a, b in enumerate(head.tolist())), bool, len(h))
        elsewhere = np.any([x != x[head] for x in (doc, mark, start)], axis=0)
        gone = [x[equal & elsewhere] for x in (doc, mark, start, count)]
        stays = ~equal | (head == np.arange(len(h)))
        hot = stays & np.isin(h, frequent)
        open_ = np.flatnonzero(stays & ~hot)
        rows = []
        for p, (at,) in _dealt((h[open_] % np.uint64(n)).astype(np.int64), [open_], n):
            rows.append((p, *(x[at].tobytes() for x in (h, doc, mark, start, count)), b"".join([content[i] for i in at.tolist()])))
        at = np.flatnonzero(hot)
        if len(at):
            data = np.frombuffer(b"".join([content[i] for i in at.tolist()]) + b"\n", np.uint8)
            sizes = count[at] + length - 1
            owner, offset = _spread(count[at])
            place = (np.cumsum(sizes) - sizes)[owner] + offset
            doc, mark, start = doc[at][owner], mark[at][owner], start[at][owner] + offset
            strings = _strings(data, place, length)
            order = np.lexsort((start, mark, doc))
            order = order[np.argsort(strings[order], kind="stable")]
            new = _changes(strings[order])
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = order[np.any([x[order] != x[head] for x in (doc, mark, start)], axis=0)]
            for k, x in enumerate((doc, mark, start, np.ones(len(doc), np.int64))):
                gone[k] = np.concatenate([gone[k], x[again]])
            first = order[new]
            own = span_hashes(data, place[first], place[first] + length)
            for p, (at, key) in _dealt((own % np.uint64(n)).astype(np.int64), [first, own], n):
                rows.append((p, key.tobytes(), *(x[at].tobytes() for x in (doc, mark, start)), np.ones(len(at), np.int64).tobytes(), b"".join(strings[at].astype(f"V{length}").tolist())))
        if len(gone[0]):
            rows.append((int(gone[1][0] % n), None, *(x.tobytes() for x in _stretches(*gone)), None))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return _batch(_names(SHIPPED), [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])])

    held, size = [], 0
    for batch in batches:
        doc, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        wanted = np.unique(_joined([x for row in batch.column(3).to_pylist() for x in row], np.uint64))
        for block, rows, offsets in pieces(batch.column(2), length, piece):
            h, s, text, start, count = (x for x in block_runs(block, length, gram))
            keep = np.isin(h, wanted)
            h, s, text, start, count = (x[keep] for x in (h, s, text, start, count))
            data = block.buf.tobytes()
            content = [data[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)]
            held.append((h, s, doc[rows[text]], mark[rows[text]], start - block.bounds[text] + offsets[text], count, content))
            size += int(count.sum()) + length * len(count) + length * int(count[np.isin(h, frequent)].sum())  # frequent ones go string by string
            if size >= PACKED_BYTES:
                yield packed(held)
                held, size = [], 0
    if size:
        yield packed(held)


def _stretches(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Join spans of strings that follow each other without a gap."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, n = (x[order] for x in (doc, mark, start, n))
    new = _changes(doc, mark)
    new[1:] |= start[1:] != (start + n)[:-1]
    at = np.flatnonzero(new)
    return [doc[at], mark[at], start[at], np.add.reduceat(n, at)] if len(at) else [doc, mark, start, n]


class SuffixIndex:
    """Sorted arrays of distinct strings, each level more than twice as long as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def seen(self, strings: np.ndarray) -> np.ndarray:
        """Which of some sorted strings a level has: both are in order, so each level is scanned once."""
        out = np.zeros(len(strings), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, strings), len(level) - 1)
            out |= level[at] == strings
        return out

    def add(self, strings: np.ndarray) -> None:
        self.levels.append(strings)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(np.sort(np.concatenate([large, small]), kind="stable"))


def scan_batch(index: SuffixIndex, strings: np.ndarray) -> np.ndarray:
    """Which strings, in order of place, have been seen before: in the batch's own suffix array or in a level. The new ones join the index."""
    suffixes = np.argsort(strings, kind="stable")  # equal ones stay in order of place
    ordered = strings[suffixes]
    found = ~_changes(ordered) | index.seen(ordered)
    hit = np.zeros(len(strings), bool)
    hit[suffixes[found]] = True
    if not found.all():
        index.add(ordered[~found])
    return hit


def _scan(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """Spans of strings that an earlier place of the partition has. A partition's runs are taken range by range, in order of place."""
    rows = [[] for _ in range(6)]
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if row[5] is None:
                yield _batch(_names(SPAN), [np.frombuffer(x, np.int64) for x in row[1:5]])
            else:
                for held, x in zip(rows, row, strict=True):
                    held.append(x)
    if not rows[0]:
        return
    h, doc, mark, start, count = (_joined(x, k) for x, k in zip(rows[:5], (np.uint64, *[np.int64] * 4), strict=True))
    data = np.frombuffer(b"".join(rows[5]), np.uint8)
    del rows
    sizes = count + length - 1
    begin = np.cumsum(sizes) - sizes
    part = (h >> np.uint64(32)) % np.uint64(RANGES)
    order = np.lexsort((start, mark, doc, part))
    order = order[_changes(*(x[order] for x in (part, doc, mark, start)))]  # a repeated row isn't an earlier place
    part, doc, mark, start, count, begin = (x[order] for x in (part, doc, mark, start, count, begin))
    for r in range(RANGES):
        own, index = np.flatnonzero(part == r), SuffixIndex()
        behind = np.cumsum(count[own])
        for at in np.split(own, np.searchsorted(behind, np.arange(size, behind[-1], size))) if len(own) else ():
            if len(at):
                owner, offset = _spread(count[at])
                hit = scan_batch(index, _strings(data, begin[at][owner] + offset, length))
                place = start[at][owner] + offset
                yield _batch(_names(SPAN), _stretches(doc[at][owner][hit], mark[at][owner][hit], place[hit], np.ones(int(hit.sum()), np.int64)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, doc_id, mark, text, spans) of each document: row is all its columns; spans are (doc_id, mark, start, n) of strings that go."""
    n, piece, size = _partitions(docs), PIECE_BYTES, BATCH
    identity = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("mark"))
    keyed = identity.select("*", F.xxhash64("doc_id", "mark").alias("key"))
    answers = materialise(repeated_hashes(keyed.select(F.col("row.text").alias("text"), "key"), length, gram), "repeated")
    frequent = frequent_hashes(answers)
    dealt = keyed.repartition(n, "key")
    told = answers.filter("key is not null").groupBy("key").agg(F.collect_list("hashes").alias("hashes"))
    shipped = dealt.join(told, "key").select("doc_id", "mark", "row.text", "hashes").mapInArrow(lambda b: _ship(b, length, gram, n, piece, frequent), SHIPPED)
    spans = shipped.repartitionById(n, "p").mapInArrow(lambda b: _scan(b, length, size), SPAN)
    spans = spans.groupBy(F.xxhash64("doc_id", "mark").alias("key")).agg(F.collect_list(F.struct("doc_id", "mark", "start", "n")).alias("spans"))
    return dealt.join(spans, "key", "left").select("row", "doc_id", "mark", F.col("row.text").alias("text"), "spans")


def _merged(spans: list[dict] | None, doc: int, mark: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] + length - 1) for s in spans or () if s["doc_id"] == doc and s["mark"] == mark):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and mark (a hash of the text)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, mark long"
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.int64()]

    def result(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return _batch(_names(schema), [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc, mark, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.cast(pa.large_binary()).as_py() or b""
                cuts = _merged(spans.as_py(), doc, mark, length)
                kept = _without(data, cuts)
                rows.append((None if doc == _LAST else doc, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, mark))
                size += len(kept)
                if size > 1 << 23:
                    yield result(rows)
                    rows, size = [], 0
            yield result(rows)

    return repeated_spans(docs, length, gram).select("doc_id", "mark", "text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All columns of docs, with what repeats cut out of ``text`` and ``n_chars``, where there is one, brought up to date.

    A character that loses a byte goes too. Texts that lose everything go; texts that lose nothing stay as they are, null and empty ones too.
    """
    names = docs.columns
    where, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def clean(text, cuts: list[tuple[int, int]]) -> str:
        data, whole = text.cast(pa.large_binary()).as_py(), []
        for a, b in cuts:
            while a > 0 and data[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            whole.append((max(a, whole[-1][1]) if whole else a, b))
        return _without(data, whole).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, stays = batch.column(0), batch.column(3).to_pylist(), np.ones(len(batch), bool)
            columns = [row.field(i) for i in range(len(names))]
            lengths = columns[size].to_pylist() if size >= 0 else []
            for i, (doc, mark, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True)):
                cuts = _merged(spans.as_py(), doc, mark, length)
                if cuts:
                    texts[i] = clean(batch.column(3)[i], cuts)
                    stays[i] = texts[i] != ""
                    if size >= 0:
                        lengths[i] = len(texts[i])
            columns[where] = pa.array(texts, columns[where].type)
            if size >= 0:
                columns[size] = pa.array(lengths, columns[size].type)
            keep = pa.array(stays)
            yield _batch(names, [c.filter(keep) for c in columns])

    return repeated_spans(docs, length, gram).mapInArrow(run, docs.schema)
