"""Running independent model fits side by side and summarising their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def run_parallel(spark: SparkSession, fn: Callable, tasks: Sequence, parallelism: int) -> list:
    """Call ``fn`` for every task from a few driver threads; each call starts Spark jobs.

    Each call has local properties of its own: Spark notes the running query in them, and threads
    that share them remove each other's note ("Cannot parse null string").
    """
    calls = [(inheritable_thread_target(spark)(fn), task) for task in tasks]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda call: call[0](call[1]), calls, chunksize=1)


def mean_and_std(scores: Sequence[float]) -> tuple[float, float]:
    """Mean and population deviation over the folds."""
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


ROWS_PER_TASK = 100_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Fewer partitions for a table of known, small size that iterative fits scan often.

    Only ever lowers their number; a large table keeps the partitions it has.
    """
    wanted = max(1, -(-rows // ROWS_PER_TASK))
    return df.coalesce(wanted) if wanted < df.rdd.getNumPartitions() else df
