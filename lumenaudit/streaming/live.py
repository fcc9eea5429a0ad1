"""Streams that keep state by run, and streams written exactly once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lumenaudit.sources.store import Store
from lumenaudit.streaming.chunks import RUN_TTL_MS
from lumenaudit.streaming.progress import percent_of, step_of

c = F.col
#: Settings of queries with state by column: it is kept in RocksDB, and a batch runs only for rows, not to look for state whose time is over (with time by the clock there would always be a next one).
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Pages that a run may crawl unless its start says otherwise.
PAGES = 250


@contextmanager
def column_state(spark: SparkSession):
    """Queries started within can keep state by column."""
    before = {k: spark.conf.get(k, None) for k in STATEFUL}
    for k, v in STATEFUL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Shown(StatefulProcessor):
    """State of a run: its limit of pages, and the most progress that it has shown."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "pages int, shown int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages, shown = self.state.get() or (PAGES, 0)
        # plain lists: most runs have few rows in a batch, where frames cost more than the rows
        came = sorted((x for df in rows for x in zip(*(df[k].tolist() for k in ("seq", "step", "fixed", "start", "done", "seen")), strict=True)), key=lambda x: x[0])
        percents, most = [], []
        for _, _, fixed, start, done, seen in came:
            if not pd.isna(start):
                pages = int(start) or PAGES
            percent = fixed
            if pd.isna(fixed):  # of a crawl
                percent = 5 + math.floor(min(1.0, done / min(max(seen, 1), pages) if seen > 0 else 0.0) * 55 + 0.5)
            shown = max(shown, int(percent))
            percents.append(int(percent))
            most.append(shown)
        self.state.update((pages, shown))
        yield pd.DataFrame({"run_id": [key[0]] * len(came), "seq": [x[0] for x in came], "step": pd.Series([x[1] for x in came], dtype=object), "percent": percents, "shown": most})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, ttl_ms: int = RUN_TTL_MS) -> DataFrame:
    """``run_id, seq, step, percent, shown`` on a stream of parsed events, a run's in order of ``seq`` over its batches: as ``progress`` gives for a batch. Needs ``column_state``."""
    kind = events.schema["run_id"].dataType.simpleString()
    none = F.lit(None).cast("int")
    crawl = c("stage") == "crawl"
    fixed = F.when(~F.coalesce(crawl, F.lit(False)), percent_of(c("stage"), none, none, c("index"), c("total"), F.lit(PAGES)))
    done = F.coalesce("crawled", F.lit(0)).cast("long")
    rows = events.where("type = 'progress'").select(
        "run_id", c("seq").cast("long").alias("seq"), step_of(c("stage"), c("crawled"), c("index"), c("total")).alias("step"), fixed.cast("double").alias("fixed"),
        F.when(c("stage") == "start", F.coalesce("maxPages", F.lit(0))).cast("double").alias("start"), done.alias("done"), (done + F.coalesce("queued", F.lit(0))).alias("seen"),
    )
    return rows.groupBy("run_id").transformWithStateInPandas(Shown(ttl_ms), f"run_id {kind}, seq long, step string, percent int, shown int", "Append", "ProcessingTime")


def record_opens(opens: DataFrame, store: Store, checkpoint: str, name: str = "opens") -> StreamingQuery:
    """Writes a stream of opens ``(send_id, ts)`` to the store, each exactly once: a batch is published together with its number, and one that the store has already is left out,
    so that a batch run again after a failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch.select("send_id", "ts"), writer=name, batch=number)

    return opens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def opened_reports(sends: DataFrame, audits: DataFrame, asked: DataFrame) -> DataFrame:
    """``send_id, audit_id, status`` of asked sends: ``ok``, ``no report`` where the audit or its report is missing, ``no send`` for unknown ones. sends: ``id, audit_id``; audits: ``id, html``."""
    known = sends.select(c("id").alias("send_id"), "audit_id").dropDuplicates(["send_id"])
    reports = audits.where(F.coalesce("html", F.lit("")) != "").select(c("id").alias("audit_id"), F.lit(True).alias("found"))
    got = asked.select("send_id").distinct().join(known.withColumn("sent", F.lit(True)), "send_id", "left").join(reports, "audit_id", "left")
    return got.select("send_id", "audit_id", F.when(c("sent").isNull(), "no send").when(c("found").isNull(), "no report").otherwise("ok").alias("status"))
