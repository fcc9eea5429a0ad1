"""Range-sorted streams over hot keys, and equi-joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that are never too many for one task.
LEAST_HOT = 1000


def ranged(df: DataFrame, *keys: str | F.Column) -> DataFrame:
    """The rows in one order over all partitions. A key that holds a third of the rows spans partitions, as long as later keys tell its rows apart.

    ``df`` is sampled first, so it should be cheap to read."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """Inner equi-join of ``left`` with ``right``, which has one row a key; ``counts (key, n)`` are ``left``'s rows by key or more.

    Keys of more than ``hot_share`` of all rows are at most ``1 / hot_share``: their rows of ``right`` are broadcast, and all other keys are joined by a shuffle."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(LEAST_HOT, (total or 0) * hot_share)
    if (most or 0) <= bound:
        return left.join(right, key)
    hot = right.join(counts.where(F.col("n") > bound).select(key), key, "left_semi")
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(right, key))
