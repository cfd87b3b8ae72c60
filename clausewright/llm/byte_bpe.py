"""Byte-level BPE encoding and decoding with a two-tier lookup (operator 5).

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a token itself. Tier two: the others are
merged by a heap over linked bytes, lowest rank first and leftmost among equals, as the rank file prescribes. Each distinct
pre-token of a task is resolved once; the memory of resolved ones is bounded by ``REMEMBERED``.

Cases: a null text is empty and has no ids; very long pre-tokens take n log n steps; equal texts and repeated rows give
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import Numbers, blocks, mix, span_hashes

#: Distinct pre-tokens that a task remembers before it forgets all of them.
REMEMBERED = 400_000
_WARM: dict[bytes, dict] = {}
_STEP = np.uint64(0xD1B54A32D192ED03)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as lines:
        ranks = {int(n): base64.b64decode(token) for token, n in (line.split() for line in lines if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def _hashes(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    starts = np.concatenate([[0], ends[:-1]]) if len(tokens) else ends
    return span_hashes(np.frombuffer(b"".join(tokens) + b"\n", np.uint8), starts, ends)


class MinimalPerfectHash:
    """Maps n keys one to one onto 0..n-1: a displacement for each bucket of keys, found largest bucket first."""

    def __init__(self, tokens: list[bytes]):
        self.n, hashes = len(tokens), _hashes(tokens)
        self.buckets = max(self.n // 4, 1)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free, self.key_at = np.ones(self.n, bool), np.zeros(self.n, np.int32)
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[edges[b] : edges[b + 1]]
            if len(keys) < 2:
                break
            tried = 0
            while True:
                trial = np.arange(tried, tried + 64, dtype=np.uint64)[:, None]
                slots = (mix(hashes[keys] + trial * _STEP) % np.uint64(self.n)).astype(np.int64)
                ok = free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) != 0).all(axis=1)
                if ok.any():
                    at = int(ok.argmax())
                    free[slots[at]] = False
                    self.key_at[slots[at]], self.shift[b] = keys, tried + at
                    break
                tried += 64
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):  # a bucket of one key names its slot
            slot = next(left)
            self.key_at[slot], self.shift[b] = order[edges[b]], -int(slot) - 1

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The key that each token could be; the caller compares it."""
        hashes = _hashes(tokens)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = (mix(hashes + np.maximum(shift, 0).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)
        return self.key_at[np.where(shift < 0, -shift - 1, slots)]


class ByteBpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.hash = tokens, pattern, MinimalPerfectHash(tokens)
        self._start()

    def _start(self):
        rank = {t: i for i, t in enumerate(self.tokens)}
        halves = ((t, i, rank.get(t[:k]), rank.get(t[k:])) for i, t in enumerate(self.tokens) for k in range(1, len(t)))
        none: dict[int, int] = {}
        #: By its first token, the rank of each pair of tokens that make a token together.
        self.joins = [none] * len(self.tokens)
        for _, i, a, b in halves:
            if a is not None and b is not None:
                if self.joins[a] is none:
                    self.joins[a] = {}
                self.joins[a][b] = i
        self.byte = [rank[bytes([c])] for c in range(256)]
        self.split = regex.compile(self.pattern).findall
        self._forget()

    def _forget(self):
        self.numbers, self.count, self.flat = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash}

    def __setstate__(self, state):
        name = hashlib.sha256(b"\0".join([state["pattern"].encode(), *state["tokens"]])).digest()
        if name not in _WARM:  # a worker that runs many tasks resolves a pre-token once
            self.__dict__ |= state
            self._start()
            _WARM.clear()
            _WARM[name] = self.__dict__
        self.__dict__ = _WARM[name]

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: ids of a pre-token that isn't in the vocabulary."""
        n, joins = len(piece), self.joins
        bits = n.bit_length()
        place = (1 << bits) - 1
        ids = [self.byte[c] for c in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [joins[a].get(b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]  # rank first, then place
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> bits, top & place
            if pair[i] != r:
                continue
            gone = after[i]
            nxt, back = after[gone], before[i]
            ids[i], ids[gone], pair[gone], after[i] = r, -1, -1, nxt
            if nxt < n:
                before[nxt] = i
                pair[i] = new = joins[r].get(ids[nxt], -1)
                if new >= 0:
                    heappush(heap, new << bits | i)
            else:
                pair[i] = -1
            if back >= 0:
                pair[back] = new = joins[ids[back]].get(r, -1)
                if new >= 0:
                    heappush(heap, new << bits | back)
        return [i for i in ids if i >= 0]

    def _learn(self, new: list[bytes]) -> None:
        likely, tokens = self.hash.find(new).tolist(), self.tokens
        ids = [[k] if tokens[k] == t else self.merge(t) for k, t in zip(likely, new, strict=True)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))])
        self.first = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        at = [np.fromiter(map(number, self.split(t)), np.int64) for t in texts]
        if len(self.numbers) > known:
            self._learn([t.encode() for t in list(self.numbers)[known:]])
        out = []
        for pieces in at:
            n = self.count[pieces]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.first[pieces] - ends + n, n)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def load(path: str, pattern: str) -> ByteBpe:
    """A tokenizer from a rank file and the pattern that splits text before the merges."""
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, bpe: ByteBpe, digests: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every text; with ``digests`` n_tokens and SHA-256 sums of ids and of decoded bytes instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = bpe.encode([t.decode() for t in block.texts])
                first = batch.column(0).slice(block.lo, len(block))
                if not digests:
                    yield pa.RecordBatch.from_arrays([first, pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    continue
                sums = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
                back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                sizes = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [first, sizes, pa.array(sums, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def decode(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """doc_id and the decoded bytes (``content``) of (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")
