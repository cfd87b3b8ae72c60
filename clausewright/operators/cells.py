"""Exact nearest neighbours by cells with centres and radii: cells that the triangle inequality rules out are never read.

Centres are fitted on a bounded sample; every row belongs to its nearest centre, and a cell's radius is the distance of its farthest row. A query is
asked of its own cell first. Its k-th best distance there is a threshold; of the other cells only those whose centre is at most threshold plus
radius away are asked as well. Cosines are compared as distances of unit vectors; zero vectors, which have cosine 0 with everything, are a cell that every query reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators import search
from clausewright.sources.tables import stored

#: Rows, chosen by a hash of their key, that the centres are fitted on at most.
SAMPLE = 8192
#: What rounding may add to a distance, as a part of it.
SLACK = 1e-6
#: The cell of zero vectors.
ZERO = -1


@dataclass(frozen=True)
class Cells:
    """Centres (one row each), radii, how many rows each cell has (by its number), and the written rows (key, embedding, cell)."""

    metric: str
    key: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: dict[int, int]
    rows: DataFrame


def _prepared(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null")


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0))


def _in_metric(column: pa.Array, metric: str, size: int) -> np.ndarray:
    x = search.matrix(column, size)
    return search.unit(x) if metric == "cosine" else x


def _centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Means of the rows nearest to them, from rows chosen far from each other."""
    rng = np.random.default_rng(1)
    chosen = [x[rng.integers(len(x))]]
    far = _distances(x, np.array(chosen))[:, 0] ** 2
    while len(chosen) < n and far.sum() > 0:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, _distances(x, chosen[-1][None])[:, 0] ** 2)
    centres = np.array(chosen)
    for _ in range(rounds):
        own = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres


def fit_cells(vectors: DataFrame, metric: str = "cosine", key: str = "vec_id", cells: int = 64) -> Cells:
    """Every row of (key, embedding) in a cell; null vectors are left out. Only the sample, and two numbers for each cell, pass through the driver."""
    rows = _prepared(vectors, key)
    sample = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").toArrow()["embedding"]
    size = search.vector_size(sample) if len(sample) else 1
    x = _in_metric(sample, metric, size) if len(sample) else np.zeros((1, 1))
    centres = _centres(x[x.any(1)] if metric == "cosine" and x.any() else x, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _in_metric(batch.column(1), metric, size)
            d = _distances(v, centres)
            own = np.where(v.any(1) | (metric != "cosine"), d.argmin(1), ZERO)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d.min(1))], names=[key, "embedding", "cell", "off"])

    placed = stored(rows.mapInArrow(place, f"{key} long, embedding array<double>, cell int, off double"), "cells")
    known = placed.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()  # one row a cell
    radii = np.full(len(centres), -np.inf)
    for r in known:
        if r.cell != ZERO:
            radii[r.cell] = r.radius
    return Cells(metric, key, centres, radii, {r.cell: r.n for r in known}, placed.drop("off"))


def _by_cell(numbers: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(int(v)) for pair in numbers.items() for v in pair)), F.col("cell"))


def _asked(queries: DataFrame, index: Cells, k: int, query_key: str) -> DataFrame:
    """(query, key, score): the k best of each query in each cell it is asked of. Queries and rows of a cell meet in blocks and parts."""
    counts = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect() if r.cell in index.sizes}  # one row a cell
    pieces = lambda n: -(-n // search.BLOCK)
    run, schema = search.topk_task(k, index.metric, query_key, index.key)
    if not counts:
        return queries.sparkSession.createDataFrame([], schema)
    blocks, parts = _by_cell({c: pieces(n) for c, n in counts.items()}), _by_cell({c: pieces(index.sizes[c]) for c in counts})
    deal = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = F.col("cell").isin(*counts)
    left = queries.filter(here).withColumn("block", deal(query_key, blocks)).withColumn("part", each(parts))
    right = index.rows.filter(here).withColumn("part", deal(index.key, parts)).withColumn("block", each(blocks))
    on = ["cell", "block", "part"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def _own_cells(asked: DataFrame, index: Cells, query_key: str) -> DataFrame:
    """Queries in the cell of their nearest centre that has rows."""
    metric, centres, filled = index.metric, index.centres, np.where(np.isinf(index.radii), np.inf, 0.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_in_metric(batch.column(1), metric, centres.shape[1]), centres) + filled
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32))], names=[query_key, "embedding", "cell"])

    return asked.mapInArrow(place, f"{query_key} long, embedding array<double>, cell int")


def _near_cells(asked: DataFrame, index: Cells, query_key: str) -> DataFrame:
    """Queries (key, embedding, cell, least) in every other cell that may hold one of their k nearest; ``least`` is their k-th best score so far, or null."""
    metric, centres, radii, zeros = index.metric, index.centres, index.radii, ZERO in index.sizes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _in_metric(batch.column(1), metric, centres.shape[1])
            d = _distances(q, centres)
            least = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            reach = np.sqrt(np.maximum(2 - 2 * least if metric == "cosine" else least, 0))
            # No threshold yet, or a zero query, which is equally near to everything: every cell.
            open_ = np.isnan(least) | ((metric == "cosine") & ~q.any(1))
            reach = np.where(open_, np.inf, reach + SLACK * (1 + reach))
            near = (d - radii[None] <= reach[:, None]) & ~np.isinf(radii)[None]
            near[np.arange(len(d)), batch.column(2).to_numpy()] = False  # its own cell has been asked
            row, cell = np.nonzero(near)
            if zeros:
                row, cell = np.concatenate([row, np.arange(len(d))]), np.concatenate([cell, np.full(len(d), ZERO)])
            taken = [batch.column(c).take(pa.array(row)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(cell.astype(np.int32))], names=[query_key, "embedding", "cell"])

    return asked.mapInArrow(place, f"{query_key} long, embedding array<double>, cell int")


def search_cells(queries: DataFrame, index: Cells, k: int, query_key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """((query, key, score, rank), (query, cell)): what ``search.block_topk`` gives, and which cells each query was asked of."""
    far_first = index.metric != "cosine"
    if not index.sizes:  # no rows, so not even a length of vectors is known
        none = queries.sparkSession.createDataFrame([], f"{query_key} long, {index.key} long, score double, rank int, cell int")
        return none.drop("cell"), none.select(query_key, "cell")
    own = stored(_own_cells(_prepared(queries, query_key), index, query_key), "asked-first")
    first = stored(_asked(own, index, k, query_key), "found-first")
    kth = search.top_k(first, query_key, index.key, k, descending=not far_first).filter(F.col("rank") == k).select(query_key, F.col("score").alias("least"))
    rest = own.join(kth, query_key, "left").select(query_key, "embedding", "cell", "least")
    more = stored(_near_cells(rest, index, query_key), "asked-more")
    found = first.unionByName(_asked(more, index, k, query_key))
    return search.top_k(found, query_key, index.key, k, descending=not far_first), own.unionByName(more).select(query_key, "cell")


def rows_read(visits: DataFrame, index: Cells, query_key: str = "query_id") -> DataFrame:
    """(query, n_cells, n_rows, n_rows_all): the cells each query was asked of, their rows, and all rows."""
    n = F.coalesce(_by_cell(index.sizes), F.lit(0))
    return visits.groupBy(query_key).agg(F.count("*").alias("n_cells"), F.sum(n).cast("long").alias("n_rows"), F.lit(sum(index.sizes.values())).cast("long").alias("n_rows_all"))
