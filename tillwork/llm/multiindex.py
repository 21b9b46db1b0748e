"""Nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; an entry lies in the cell of its
two centroids. For a query, cells are taken off a heap by falling inner product: the sum over
both halves of what the query's half and the centroid give, plus what entries spread around the
centroid may add. It ends when the cells hold ``probe`` of all entries. These entries are ranked
by the inner product of the original vectors, so long vectors count at any distance.

Codebooks are fitted on a bounded sample; every entry is indexed. The share of entries to be
probed, not a count, is the parameter: vectors without clusters need the same share at any size
for the same recall. Queries and entries meet block by block, so that no pair becomes a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash

SAMPLE = 20_000  # vectors on which the codebooks are fitted
ENTRY_BLOCK, QUERY_BLOCK = 8192, 1024  # rows that meet in one task
ROUNDS = 12
REACH = 2.0  # deviations beyond the centroid, in the query's direction, that a cell is credited with
SLACK = 1e-9  # products this close are compared again in one order of summation


def vectors_of(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Valid vectors as doubles, and which rows they are.

    Not valid: null, zero, a null or non-finite component, or another length than ``dim``.
    """
    length = np.asarray(pc.list_value_length(column).fill_null(-1), dtype=np.int64)
    flat = column.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan")))
    dim = dim or int(length.max(initial=0))
    rows = np.flatnonzero((length == dim) & (length > 0))
    begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    out = values[begin[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    good = np.isfinite(out).all(1) & (out != 0).any(1)
    return out[good], rows[good]


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centroids of the rows of x by Lloyd's rounds from far-apart beginnings."""
    rng = np.random.default_rng(seed)
    centre = x[rng.integers(len(x), size=1)]
    far = ((x - centre[0]) ** 2).sum(1)
    while len(centre) < k and far.max(initial=0) > 0:
        centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = nearest(x, centre)
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)


def probed_cells(first: np.ndarray, second: np.ndarray, size: np.ndarray, wanted: int) -> np.ndarray:
    """Cells in order of summed cost until they hold ``wanted`` entries: a mask over all cells.

    ``first``, ``second``: the query's costs of the centroids of either half, least first; ``size``:
    entries of each cell. The multi-sequence walk: a pair is pushed when both pairs
    before it have been taken.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    first, second = first[a].tolist(), second[b].tolist()
    n, m = len(first), len(second)
    mask = np.zeros(n * m, bool)
    done = [0] * n  # how many pairs of each row have been taken
    heap, found = [(first[0] + second[0], 0, 0)], 0
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = a[i] * m + b[j]
        mask[cell] = True
        found += size[cell]
        if j + 1 < m and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if i + 1 < n and done[i + 1] == j:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
    return mask


def _best(ids: np.ndarray, entries: np.ndarray, vector: np.ndarray, row: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the k best of the entries whose product in ``row`` is finite."""
    open_ = np.flatnonzero(row > -np.inf)
    if len(open_) > k:
        open_ = open_[row[open_] >= np.partition(row[open_], -k)[-k] - SLACK]
    score = (entries[open_] * vector).sum(1)
    order = np.lexsort((ids[open_], -score))[:k]
    return ids[open_][order], score[order]


def search(vectors: DataFrame, every: int = 20, k: int = 20, centroids: int = 32, probe: float = 0.6,
           id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """The k nearest of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Queries are the rows whose id ``every`` divides; candidates all rows with another id.
    Nearest is the largest inner product in double precision, ties go to the smaller id. Fewer
    rows if there are fewer candidates. Rows whose id is null, and vectors that are null, zero,
    of an unusual length or that hold null or non-finite components, take no part. Rows that
    repeat an id are entries of their own; a query's rows share one result. No rows give none.
    """
    named = columns(vectors, id_col, vector_col).toDF("vec_id", "vector").filter("vec_id IS NOT NULL")
    spark = named.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = named.filter("size(vector) > 0").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return empty
    dim = length["n"]
    half = dim // 2

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = vectors_of(batch.column("vector"), dim)
            yield pa.record_batch([batch.column("vec_id").take(pa.array(rows)).cast(pa.int64()),
                                   pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "vector"])

    valid = stash(named.mapInArrow(clean, "vec_id long, vector binary"), "vectors")
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return empty
    x = np.stack([np.frombuffer(v) for v in sample])
    books = [codebook(x[:, s], centroids, seed) for s in (slice(0, half), slice(half, dim))]
    width = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, dim)
            halves = x[:, :half], x[:, half:]
            own = [nearest(v, c) for v, c in zip(halves, books)]
            off = [((v - c[o]) ** 2).sum(1) for v, c, o in zip(halves, books, own)]
            yield pa.record_batch([*batch.columns, pa.array((own[0] * width + own[1]).astype(np.int32)), *map(pa.array, off)],
                                  ["vec_id", "vector", "cell", "off_0", "off_1"])

    coded = stash(valid.mapInArrow(assign, "vec_id long, vector binary, cell int, off_0 double, off_1 double"), "cells")
    size = np.zeros(len(books[0]) * width, np.int64)  # as many numbers as there are cells
    off = np.zeros((2, len(size)))
    unit = float((x**2).sum(1).mean())
    # sums of millionths of the sample's mean square are the same in any order of the rows
    sums = [F.sum(F.round(F.least(F.col(c) / unit, F.lit(1e18)) * 1e6).cast("decimal(38,0)")).cast("double").alias(c)
            for c in ("off_0", "off_1")]
    for r in coded.groupBy("cell").agg(F.count("*").alias("n"), *sums).collect():
        size[r["cell"]] = r["n"]
        off[:, r["cell"]] = r["off_0"] * 1e-6 * unit, r["off_1"] * 1e-6 * unit
    coded = coded.drop("off_0", "off_1")
    grid, spread_of = size.reshape(-1, width), []
    for side, (book, axis) in enumerate(zip(books, (1, 0))):
        square = off[side].reshape(-1, width).sum(axis) / np.maximum(grid.sum(axis), 1)
        spread_of.append(REACH * np.sqrt(square / max(1, book.shape[1])))
    total = int(size.sum())
    wanted = max(int(np.ceil(probe * total)), 2 * k + 1)
    first_block, part_of = _blocks(size)
    query_blocks = total // every // QUERY_BLOCK + 1

    def as_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = np.asarray(batch.column("cell")), np.asarray(batch.column("vec_id"))
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = first_block[cell] + (spread % part_of[cell].astype(np.uint64)).astype(np.int64)
            for q in range(query_blocks):
                yield pa.record_batch([pa.array(at), pa.array(np.full(len(at), q)), *batch.columns],
                                      ["block", "query_block", "vec_id", "vector", "cell"])

    def as_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, dim)
            cost = [-(v @ c.T + np.sqrt((v**2).sum(1))[:, None] * s)
                    for v, c, s in zip((x[:, :half], x[:, half:]), books, spread_of)]
            row, at, masks = [], [], []
            for i in range(len(x)):
                mask = probed_cells(cost[0][i], cost[1][i], size, wanted)
                blocks = np.unique(np.concatenate([np.arange(first_block[c], first_block[c] + part_of[c])
                                                   for c in np.flatnonzero(mask & (size > 0))]))
                row += [i] * len(blocks)
                at.append(blocks)
                masks += [np.packbits(mask).tobytes()] * len(blocks)
            if row:
                rows = batch.select(["vec_id", "vector"]).take(pa.array(row))
                ids = np.asarray(rows.column("vec_id"))
                yield pa.record_batch([pa.array(np.concatenate(at)), pa.array(ids // every % query_blocks),
                                       *rows.columns, pa.array(masks, pa.binary())],
                                      ["block", "query_block", "vec_id", "vector", "cells"])

    def compare(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if entries.num_rows and queries.num_rows:
            ids, cells = np.asarray(entries.column("vec_id")), np.asarray(entries.column("cell"))
            e = np.frombuffer(b"".join(entries.column("vector").to_pylist())).reshape(-1, dim)
            q_ids = np.asarray(queries.column("vec_id"))
            q = np.frombuffer(b"".join(queries.column("vector").to_pylist())).reshape(-1, dim)
            for lo in range(0, len(q), 256):
                product = q[lo:lo + 256] @ e.T
                for i, row in enumerate(product, lo):
                    mask = np.unpackbits(np.frombuffer(queries.column("cells")[i].as_py(), np.uint8), count=len(size)).astype(bool)
                    row[~mask[cells] | (ids == q_ids[i])] = -np.inf
                    found, score = _best(ids, e, q[i], row, k)
                    out[0].append(np.full(len(found), q_ids[i]))
                    out[1].append(found)
                    out[2].append(score)
        return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))],
                        ["query_id", "vec_id", "score"])

    entries = coded.mapInArrow(as_entries, "block long, query_block long, vec_id long, vector binary, cell int")
    queries = coded.filter(F.col("vec_id") % every == 0).mapInArrow(
        as_queries, "block long, query_block long, vec_id long, vector binary, cells binary")
    found = entries.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    # rows that repeat a query find the same again, which takes no further place
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def _blocks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: a large cell has blocks of its own, small ones share."""
    first, parts, block, room = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, ENTRY_BLOCK
    for c, n in enumerate(size.tolist()):
        if n > ENTRY_BLOCK:
            parts[c] = -(-n // ENTRY_BLOCK)
            first[c] = block + 1
            block, room = block + 1 + int(parts[c]), ENTRY_BLOCK
            continue
        if n > room:
            block, room = block + 1, ENTRY_BLOCK
        first[c] = block
        room -= n
    return first, parts
