"""The trie of shared conversation beginnings (operator 13).

Every turn becomes 16 bytes of SHA-256 and the length of its text before anything is shuffled. Equal conversations are collapsed, the different ones
are dealt into ranges of their byte strings and sorted. Each range is read in blocks: neighbours' common beginnings are edges, union-find takes
these in descending depth, and each merge of two components makes a branching node or adds a child to one. Nodes that neither the first nor the last
conversation of a block runs through are whole there. The others are contracted to two paths a block, which are merged across all blocks in order;
this merge sees one row for each block of up to ``BLOCK`` different conversations, never the conversations themselves.

A conversation's turns stand in one row, 24 bytes each. A hash over the members that end in a node is sequential by nature: their numbers are
joined to pieces of about a MB where they lie, and only the pieces meet in one task.

Cases: null roles and texts are empty; rows without conv_id belong to no conversation; null turns come first, and equal turns are ordered by their hash;
repeated rows are turns of their own; an empty table has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import materialise

#: Different conversations, and bytes of their turns, that a task holds at once.
BLOCK, BLOCK_BYTES = 1 << 16, 1 << 26
#: Characters of joined numbers of equal conversations that a row holds.
PIECE = 1 << 20
#: Bytes of a turn's hash.
WIDE = 16
NOBODY = hashlib.sha256(b"").hexdigest()

_PLACE = "struct<n:bigint,conv:bigint,children:bigint,leaves:bigint,saved:bigint,bytes:bigint,ends:string>"
_SPINE = f"first binary, last binary, common int, places array<{_PLACE}>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): array<struct<h, n>> in order, the hex hash of each turn's role and text and the text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    h = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDE)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), h.alias("h"), F.octet_length(text).alias("n")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns"))


def borrow_beginnings(sequences: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Each conversation c with the first crc32(c) % (most + 1) turns of c - c % every in place of its own."""
    heads = sequences.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most).alias("head"))
    near = F.sequence(F.try_add("donor", F.lit(1 - every)), F.try_add("donor", F.lit(every - 1)))
    taken = heads.select("donor", "head", F.explode(near).alias("taker")).filter(F.col("taker") % every == F.col("taker") - F.col("donor"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = sequences.join(taken, F.col("conv_id") == F.col("taker"), "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.when(F.col("conv_id") % every == 0, F.col("turns")).otherwise(F.concat(head, rest)).alias("turns"))


def _packed(sequences: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the hashes and the sizes of all turns behind each other."""
    joined: dict[str, Column] = {
        "key": F.array_join(F.transform("turns", lambda t: t["h"]), ""),
        "sizes": F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(t["n"]), 16, "0")), ""),
    }
    return sequences.select("conv_id", *(F.unhex(v).alias(k) for k, v in joined.items()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal conversations in a row become few: key, sizes, their first number, how many, and their numbers joined."""
    schema = pa.schema([("key", pa.binary()), ("sizes", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    key, sizes, ids, length = None, b"", [], 0

    def piece():
        return {"key": key, "sizes": sizes, "conv": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}

    for batch in batches:
        out = []
        for conv, k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if ids and (k != key or length > PIECE):
                out.append(piece())
                ids, length = [], 0
            key, sizes = k, s
            ids.append(conv)
            length += len(str(conv)) + 1
        yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([piece()], schema)


def common_turns(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b)) // WIDE
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: WIDE * mid] == b[: WIDE * mid] else (lo, mid - 1)
    return lo


def merged_components(depths: list[int], shared: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, parent (or -1), first and last leaf of the nodes of the forest over sorted sequences.

    Node i below len(depths) is where sequence i ends. ``shared[i]`` is how much i and i + 1 have in common. The deepest edges come first; of
    equally deep ones the left, so that what an edge adds on its right lies deeper than the edge and becomes a child.
    """
    m = len(depths)
    depth, parent, first, last = list(depths), [-1] * m, list(range(m)), list(range(m))
    up, top = list(range(m)), list(range(m))  # union-find over the sequences, and each component's top node

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in sorted(range(m - 1), key=lambda i: -shared[i]):
        a, b, d = find(i), find(i + 1), shared[i]
        x, y = top[a], top[b]
        if depth[x] > d:
            depth.append(d)
            parent.append(-1)
            first.append(first[x])
            last.append(last[x])
            parent[x] = x = len(depth) - 1
        parent[y] = x
        last[x] = last[y]
        up[b], top[a] = a, x
    return tuple(np.array(c, np.int64) for c in (depth, parent, first, last))


def _block_rows(block: int, keys: list[bytes], sizes: list[bytes], convs: list[int], ns: list[int], ends: list[str]) -> Iterator[pa.RecordBatch]:
    """The whole nodes of a block of sorted sequences, and its two contracted paths."""
    m = len(keys)
    lengths = [len(k) // WIDE for k in keys]
    depth, parent, first, last = merged_components(lengths, [common_turns(a, b) for a, b in zip(keys, keys[1:])])
    nodes = len(depth)
    total = np.concatenate([[0], np.cumsum(ns)])
    n = total[last + 1] - total[first]
    bounds = np.column_stack([first, last + 1]).ravel()
    conv = np.minimum.reduceat(np.array([*convs, np.iinfo(np.int64).max]), bounds)[::2]
    above = np.where(parent >= 0, depth[parent], -1)  # a chain of nodes runs from there, exclusive, to the node's own depth
    children = np.bincount(parent[parent >= 0], minlength=nodes)
    childless = children[:m] == 0
    under = np.concatenate([[0], np.cumsum(childless)])
    leaves = under[last + 1] - under[first]
    # Bytes of a sequence's first d turns, from one running sum over all of the block.
    offset = np.concatenate([[0], np.cumsum(lengths)])
    running = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(sizes), ">i8").astype(np.int64))])
    upto = lambda v, d: running[offset[first[v]] + np.maximum(d, 0)] - running[offset[first[v]]]
    v = np.arange(nodes)
    chain = (n - 1) * (upto(v, depth) - upto(v, above))
    is_open = (first == 0) | (last == m - 1)
    below, open_children, open_leaves = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    for x in np.argsort(-depth, kind="stable"):
        if parent[x] >= 0 and not is_open[x]:
            below[parent[x]] += below[x] + chain[x]
            open_children[parent[x]] += 1
            open_leaves[parent[x]] += leaves[x]
    end_of = lambda x: ends[x] if x < m else NOBODY

    # The two paths: all places of the first sequence, then those of the last one behind what it has in common with the first.
    common = common_turns(keys[0], keys[-1])
    paths, place_of = [], {}
    for at_end, start in ((0, 0), (1, common + 1)):
        x = (m - 1 if at_end else 0) if not (at_end and m == 1) else -1
        path = []
        while x >= 0:
            d = int(depth[x])
            for e in range(d, int(above[x]), -1):
                if e < start:
                    break
                path.append((x, e))
            x = int(parent[x])
        paths += path[::-1]
    places = []
    for at, (x, e) in enumerate(paths):
        whole = e == depth[x]
        size = int(upto(x, e) - upto(x, e - 1)) if e else 0
        if whole:
            place_of[x] = at
        places.append({
            "n": int(n[x]), "conv": int(conv[x]), "children": int(open_children[x]) if whole else 0, "leaves": int(open_leaves[x]) if whole else 0,
            "saved": int(below[x]) if whole else 0, "bytes": size, "ends": end_of(x) if whole else NOBODY,
        })
    spine = pa.array([places], pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "conv", "children", "leaves", "saved", "bytes")] + [("ends", pa.string())])))

    inner = np.flatnonzero(~is_open)
    long = depth[inner] - above[inner]
    for part in np.split(np.arange(len(inner)), np.flatnonzero(np.diff(np.cumsum(long) // (1 << 16))) + 1):  # a batch of rows at a time
        some, many = inner[part], long[part]
        x = np.repeat(some, many)
        d = np.repeat(above[some] + 1, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        whole, top = d == depth[x], d == above[x] + 1
        over = parent[x]
        by_place = top & is_open[over]
        parent_conv = np.where(top, conv[over], conv[x])
        place = np.array([place_of[o] if b else -1 for o, b in zip(over.tolist(), by_place.tolist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(x), block)), pa.array(conv[x]), pa.array(d), pa.array(parent_conv, mask=by_place), pa.array(n[x]), pa.array(np.where(whole, children[x], 1)), pa.array(leaves[x]),
            pa.array(below[x] + (n[x] - 1) * (upto(x, depth[x]) - upto(x, d - 1))), pa.array([end_of(a) if w else NOBODY for a, w in zip(x.tolist(), whole.tolist(), strict=True)], pa.string()),
            pa.array(place, mask=~by_place), *(pa.nulls(len(x), kind) for kind in (pa.binary(), pa.binary(), pa.int32(), spine.type)),
        ], names=_FOREST_COLUMNS)
    nulls = [pa.nulls(1, pa.int64()) for _ in range(7)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([block]), *nulls, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([keys[0]], pa.binary()), pa.array([keys[-1]], pa.binary()), pa.array([common], pa.int32()), spine],
        names=_FOREST_COLUMNS,
    )


_FOREST = f"block bigint, {_NODE}, place bigint, {_SPINE}"
_FOREST_COLUMNS = ["block", *NODE_COLUMNS, "place", "first", "last", "common", "places"]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to blocks of different conversations, and these to forests."""
    block = TaskContext.get().partitionId() << 32
    rows: list[list] = [[], [], [], [], []]  # keys, sizes, first numbers, how many, digests of numbers
    size = 0
    for batch in batches:
        for key, sizes, conv, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "conv", "n", "ids")), strict=True):
            keys, _, _, ns, digests = rows
            if keys and keys[-1] == key:
                ns[-1] += n
                digests[-1].update(b"," + ids.encode())
                continue
            if len(keys) >= BLOCK or size > BLOCK_BYTES:
                yield from _block_rows(block, *rows[:4], [d.hexdigest() for d in digests])
                rows, size, block = [[], [], [], [], []], 0, block + 1
            for column, value in zip(rows, (key, sizes, conv, n, hashlib.sha256(ids.encode())), strict=True):
                column.append(value)
            size += len(key) + len(sizes)
    if rows[0]:
        yield from _block_rows(block, *rows[:4], [d.hexdigest() for d in rows[4]])


def _merge_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the blocks' paths, merged over all blocks in order; and for each place with whole children, whose parent it is.

    What is open is one path of nodes. A node that no later block runs through is closed: it adds to its parent, which names it in the end.
    """
    path: list[dict] = []
    key, out = b"", []

    def close(depth: int):
        while len(path) > depth:
            d, x = len(path) - 1, path.pop()
            saved = x["saved"] + (x["n"] - 1) * x["bytes"]
            leaves = x["leaves"] if x["children"] else 1
            out.extend([*row, x["conv"], *rest] for row, rest in x["inner"])
            out.extend([b, None, None, x["conv"], None, None, None, None, None, p] for b, p in x["refs"])
            row, rest = [None, x["conv"], d], [x["n"], x["children"], leaves, saved, x["ends"], None]
            if path:
                over = path[-1]
                over["children"] += 1
                over["leaves"] += leaves
                over["saved"] += saved
                over["inner"].append((row, rest))
            else:
                out.append([*row, None, *rest])

    def meet(d: int, place: dict, ref: tuple[int, int]):
        if d == len(path):
            path.append({**place, "inner": [], "refs": []})
        else:
            x = path[d]
            x["conv"] = min(x["conv"], place["conv"])
            x["ends"] = x["ends"] if place["ends"] == NOBODY else place["ends"]
            for c in ("n", "children", "leaves", "saved"):
                x[c] += place[c]
        if place["children"]:
            path[d]["refs"].append(ref)

    def rows():
        columns = list(zip(*out, strict=True)) if out else [[]] * 10
        kinds = [pa.int64()] * 8 + [pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", *NODE_COLUMNS, "place"])
        out.clear()
        return batch

    for batch in batches:
        for r in batch.to_pylist():
            close(common_turns(key, r["first"]) + 1)
            start = len(r["first"]) // WIDE + 1
            for at, place in enumerate(r["places"]):
                if at == start:
                    close(r["common"] + 1)
                meet(at if at < start else at - start + r["common"] + 1, place, (r["block"], at))
            if len(r["places"]) == start:
                close(r["common"] + 1)
            key = r["last"]
            if len(out) > 10_000:
                yield rows()
    close(0)
    yield rows()


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each different beginning of ``sequences`` (conv_id, turns), the root included.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of text that members share with a smaller
    number of copies) and ends_sha256, of the numbers of members that end there.
    """
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(_packed(sequences).withColumn("mark", F.xxhash64("key")), "trie-turns")
    alike = rows.repartitionByRange(n, "mark", "conv_id").sortWithinPartitions("mark", "key", "conv_id").select("conv_id", "key", "sizes")
    pieces = materialise(alike.mapInArrow(_pieces, "key binary, sizes binary, conv bigint, n bigint, ids string"), "trie-pieces")
    ranged = pieces.repartitionByRange(n, "key").sortWithinPartitions("key", "conv")
    forest = materialise(ranged.mapInArrow(_forests, _FOREST), "trie-forest")
    paths = forest.filter("places is not null").select("block", "first", "last", "common", "places")
    merged = materialise(paths.repartition(1).sortWithinPartitions("block").mapInArrow(_merge_paths, f"block bigint, {_NODE}, place bigint"), "trie-paths")
    parents = merged.filter("place is not null").select("block", "place", F.col("parent_conv_id").alias("named"))
    inner = forest.filter("places is null").select("block", *NODE_COLUMNS, "place")
    own = [F.coalesce("parent_conv_id", "named").alias(c) if c == "parent_conv_id" else F.col(c) for c in NODE_COLUMNS]
    return inner.join(parents, ["block", "place"], "left").select(*own).unionByName(merged.filter("place is null").select(*NODE_COLUMNS))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations as they stand: (conv_id, turn, role, text)."""
    return prefix_trie(sequences(conversations))
