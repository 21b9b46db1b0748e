"""Exact measures over all pairs of points, added up block by block.

Equal points are collapsed into weights and hashed into blocks of a bounded size, one row per block.
Each pair of blocks is compared once, tile by tile in NumPy, and adds to the sums of the points of both,
so pairs of points are never rows, and blocks never pass through the driver. The work is quadratic by definition; the memory of a task is not.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.session import shared_folder, shuffles_released

BLOCK_ROWS = 8192
TILE_ROWS = 256  # a tile of distances stays in the processor's cache
RUN = 8  # blocks a task compares with the one it holds
CLOSE = 1e-6  # of a square: below, a product of matrices is not exact enough


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pairwise/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _kernel(offsets: np.ndarray, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A local function, so that it is sent to workers by value: they need not have this package installed.

    For a block and the blocks that follow it, the summed distance of every point of each to every group of the other.
    """
    width = int(offsets[-1])

    def unpacked(batch, i):
        w = np.asarray(batch.column("w")[i].values, float)
        at = np.asarray(batch.column("labels")[i].values.flatten()).reshape(len(w), -1) + offsets[:-1]
        member = np.zeros((len(w), width))
        np.put_along_axis(member, at, w[:, None], axis=1)
        return np.asarray(batch.column("x")[i].values, float).reshape(len(w), -1), member

    def sums(key, block, found):
        return pa.record_batch([pa.array([key], pa.int32()), pa.array([block], pa.int32()), pa.array([found.ravel()])], ["key", "block", "sums"])

    def met(a, of_a, to_a, b, of_b, same):
        """Add the distances of both blocks to the sums of ``a``; returns those of ``b``."""
        centre = a.mean(0)
        p, q = a - centre, b - centre
        far_p, far_q = (p * p).sum(1), (q * q).sum(1)
        # Squares by one product; where they are so small that its error would show, they are worked out again.
        left, right = np.column_stack([-2 * p, far_p, np.ones(len(p))]), np.vstack([q.T, np.ones(len(q)), far_q])
        small = CLOSE * (far_p.max() + far_q.max())
        to_b, of_a_turned, whole = np.zeros(of_b.shape), np.ascontiguousarray(of_a.T), np.empty(tile * tile)
        for s in range(0, len(a), tile):
            for t in range(s if same else 0, len(b), tile):
                m, n = min(tile, len(a) - s), min(tile, len(b) - t)
                flat = whole[:m * n]
                d = np.matmul(left[s:s + m], right[:, t:t + n], out=flat.reshape(m, n))
                near = np.flatnonzero(flat <= small)
                if len(near):
                    away = a[s + near // n] - b[t + near % n]
                    flat[near] = (away * away).sum(1)
                np.sqrt(flat, out=flat)
                to_a[s:s + m] += d @ of_b[t:t + n]
                if not same:
                    to_b[t:t + n] += (of_a_turned[:, s:s + m] @ d).T
                elif s != t:
                    to_a[t:t + n] += (of_a_turned[:, s:s + m] @ d).T
        return to_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i, (key, first, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("key", "first", "block")])):
                points, member = unpacked(batch, i)
                if first:
                    if held:
                        yield sums(*held[:2], held[4])
                    held = key, block, points, member, np.zeros(member.shape)
                    continue
                of_b = met(*held[2:], points, member, block == held[1])
                if block != held[1]:
                    yield sums(key, block, of_b)
        if held:
            yield sums(*held[:2], held[4])

    return run


def _adder(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the sums of each block; rows of a block come side by side."""
    def points(block, found):
        found = found.reshape(-1, width)
        columns = [pa.array(np.full(len(found), block, np.int32)), pa.array(np.arange(len(found), dtype=np.int32))]
        return pa.record_batch([*columns, *[pa.array(c) for c in found.T]], ["block", "place", *[f"s{i}" for i in range(width)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                more = np.asarray(batch.column("sums")[i].values)
                if block == held:
                    total += more
                    continue
                if held is not None:
                    yield points(held, total)
                held, total = block, more.copy()
        if held is not None:
            yield points(held, total)

    return run


def block_sums(packs: DataFrame, blocks: int, offsets: np.ndarray) -> DataFrame:
    """Rows (block, place, sums): the summed distance of every packed point to every group, all blocks added up.

    The blocks form a ring. Each meets itself and the half of the ring that follows it, ``RUN`` blocks at a time: a row with
    the block itself, then those it meets, are sent to one task. No join, so Spark cannot take the many copies of
    a block for a table as small as the packed one and send them through the driver.
    """
    half, width = blocks // 2, int(offsets[-1])
    runs = half // RUN + 1
    own = packs.select(F.explode(F.sequence(F.col("block") * runs, F.col("block") * runs + runs - 1)).alias("key"), F.lit(True).alias("first"), *packs.columns)
    after = packs.select("*", F.explode(F.sequence(F.lit(0), F.lit(half))).alias("step")).withColumn(
        "l", F.pmod(F.col("block") - F.col("step"), F.lit(blocks)))
    # On a ring of even length opposite blocks would meet twice.
    met = after.where((F.col("step") * 2 < blocks) | (F.col("l") < half)).select(
        (F.col("l") * runs + F.floor(F.col("step") / RUN)).cast("int").alias("key"), F.lit(False).alias("first"), *packs.columns)
    most = 8 * int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.unionByName(met).repartition(min(blocks * runs, most), "key").sortWithinPartitions("key", F.desc("first"), "block")
    partial = rows.mapInArrow(_kernel(offsets, TILE_ROWS), "key int, block int, sums array<double>")
    together = partial.repartition(min(blocks, most), "block").sortWithinPartitions("block", "key")
    names = [f"s{i}" for i in range(width)]
    total = together.mapInArrow(_adder(width), ", ".join(["block int", "place int", *[f"{c} double" for c in names]]))
    return total.select("block", "place", F.array(*names).alias("sums"))


# Silhouette -----------------------------------------------------------------------------

def silhouettes(points: DataFrame, labels: Sequence[str]) -> dict[str, float | None]:
    """Mean Euclidean silhouette of several labelings of the same points, in one pass.

    Distances are computed once; each labeling only adds a small matrix product. A
    labeling with a single group has none. Labels are numbers from 0 on; gaps are empty groups.
    """
    marked = points.select("x", F.array(*[F.col(c).cast("int") for c in labels]).alias("labels"))
    packed = marked.groupBy("x", "labels").agg(F.count("*").alias("w"))
    sizes = _cluster_sizes(packed, len(labels))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(int)
    blocks = max(1, math.ceil(packed.count() / BLOCK_ROWS))
    home = F.pmod(F.xxhash64("x", "labels"), F.lit(blocks)).cast("int").alias("block")
    lists = packed.groupBy(home).agg(F.collect_list(F.struct("x", "labels", "w")).alias("points"))
    packs = _written(lists.select("block", F.flatten("points.x").alias("x"), F.col("points.labels").alias("labels"), F.col("points.w").alias("w")))
    placed = packs.select("block", F.posexplode(F.arrays_zip("labels", "w")).alias("place", "p")).select("block", "place", "p.labels", "p.w")
    # Merged: the packed table says nothing about the size of its rows one by one.
    scored = block_sums(packs, blocks, offsets).join(placed.hint("merge"), ["block", "place"])
    means = [_mean_silhouette(j, sizes[j], int(offsets[j])).alias(f"m{j}") for j in range(len(labels))]
    row = scored.agg(*means).first()
    return {c: row[f"m{j}"] for j, c in enumerate(labels)}


def _cluster_sizes(packed: DataFrame, labelings: int) -> list[list[int]]:
    rows = (
        packed.select("w", F.posexplode("labels").alias("labeling", "cluster"))
        .groupBy("labeling", "cluster").agg(F.sum("w").alias("n")).collect())
    out = [dict() for _ in range(labelings)]
    for r in rows:
        out[r.labeling][r.cluster] = r.n
    return [[d.get(c, 0) for c in range(max(d) + 1)] for d in out]


def _mean_silhouette(labeling: int, sizes: list[int], offset: int) -> Column:
    if sum(n > 0 for n in sizes) < 2:
        return F.lit(None).cast("double")
    own = F.col("labels")[labeling]
    size = F.array(*[F.lit(s) for s in sizes])
    near = F.try_divide(F.col("sums")[own + offset], size[own] - 1)
    to_others = F.transform(
        F.sequence(F.lit(0), F.lit(len(sizes) - 1)),
        lambda c: F.when((c != own) & (F.get(size, c) > 0), F.get("sums", c + offset) / F.get(size, c)))
    far = F.array_min(to_others)
    width = F.try_divide(far - near, F.greatest(near, far))
    each = F.when(size[own] == 1, 0.0).otherwise(F.coalesce(width, F.lit(0.0)))
    return F.sum(each * F.col("w")) / F.sum("w")
