"""Running values over rows in order, where one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.sources.storage import stored


def running(rows: DataFrame, key: str, order: list[Column], *, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, over the earlier rows of their key, the sums and the last values that aren't null, and the next ones over the later rows.

    The rows are range-partitioned by key and order, so a long key spans partitions; a partition's rows of a key run on their own, and what other partitions add
    is broadcast: a row a partition at most, as a key goes on from one partition to the next only as its first (for what comes next, its last). The order of equal rows isn't defined: ``order`` should tell rows apart where it matters."""
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    valued = rows.where(F.col(key).isNotNull()).withColumns({f"__{n}": v for n, v in (sums | lasts | nexts).items()}).withColumns({f"__o{k}": o for k, o in enumerate(order)})
    sort = [F.col(key), *(F.col(f"__o{k}").asc_nulls_last() for k in range(len(order)))]
    placed = stored(valued.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda name, w: F.last(name, ignorenulls=True).over(w)
    own, own_later = before(Window.partitionBy(key, "__part").orderBy("__at")), before(Window.partitionBy(key, "__part").orderBy(F.desc("__at")))
    here = placed.withColumns({n: F.sum(f"__{n}").over(own) for n in sums} | {n: last(f"__{n}", own) for n in lasts} | {n: last(f"__{n}", own_later) for n in nexts})
    end = lambda n, by: by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col("__at"))).alias(f"__{n}")
    whole = [F.sum(f"__{n}").alias(f"__{n}") for n in sums] + [end(n, F.max_by) for n in lasts] + [end(n, F.min_by) for n in nexts]
    earlier, later = before(Window.partitionBy(key).orderBy("__part")), before(Window.partitionBy(key).orderBy(F.desc("__part")))
    parts = placed.groupBy(key, "__part").agg(F.count("*").alias("__n"), *whole)
    more = F.sum("__n").over(earlier)  # null where no other partition adds anything
    more = F.coalesce(more, F.sum("__n").over(later)) if nexts else more
    carried = parts.select(key, "__part", more.alias("__n"), *(F.sum(f"__{n}").over(earlier).alias(f"__c{n}") for n in sums), *(last(f"__{n}", earlier).alias(f"__c{n}") for n in lasts), *(last(f"__{n}", later).alias(f"__c{n}") for n in nexts))
    out = here.join(F.broadcast(carried.where("__n IS NOT NULL").drop("__n")), [key, "__part"], "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__c{n}", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"__c{n}") for n in (*lasts, *nexts)})
    return out.select(*rows.columns, *sums, *lasts, *nexts)
