"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import release, written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for each node of ``edges (a, b)``: the least node that it reaches. Edges stay distributed.

    A round hangs each node's larger neighbours under the least node around it, then each node and its smaller neighbours under the least of these; the least is found by a
    partial aggregate, so a node with very many neighbours costs its task one row from each other task. The rounds end when the edges stay as they are: each node then
    hangs under its component's least one. Rows are written to shared storage after each round."""
    rows = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(rows)
    for _ in range(most_rounds):
        both = rows.union(rows.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        after = written(small)
        release(rows)
        rows, before, state = after, state, _state(after)
        if state == before:
            labels = written(rows.union(rows.select("b", "b").distinct()).toDF("node", "component"))
            release(rows)
            return labels
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _state(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
