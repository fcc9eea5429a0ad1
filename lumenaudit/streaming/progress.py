"""Event streams of audits: parsing, progress, opens and the request limiter. Each has one form for batches and streams alike where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "type string, stage string, maxPages int, competitors int, crawled int, queued int, url string, available boolean, index int, total int, error string, data string"
WINDOW_MS, MOST_REQUESTS = 600_000, 5

# The steps of an audit with fixed progress.
STEPS = {
    "start": ("Preparing audit scope...", 4), "pagespeed_done": ("PageSpeed checks finished", 30), "scoring": ("Scoring technical and authority signals...", 78),
    "llm": ("Generating evidence-grounded narrative...", 84), "report": ("Assembling report workspace...", 92), "persist": ("Saving audit history...", 96),
}


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; blank and malformed lines are left out. Works on streams."""
    event = F.from_json(F.col(column), EVENT)
    return lines.where(F.trim(F.col(column)) != "").withColumn("e", event).where("e.type IS NOT NULL").select(*[c for c in lines.columns if c != column], "e.*")


def percent_of(stage: Column, crawled: Column, queued: Column, index: Column, total: Column, most_pages: Column) -> Column:
    """The progress that an event stands for."""
    done = F.coalesce(crawled, F.lit(0))
    seen = done + F.coalesce(queued, F.lit(0))
    share = F.when(seen > 0, done / F.least(F.greatest(seen, F.lit(1)), most_pages)).otherwise(F.lit(0.0))
    out = F.when(stage == "crawl", F.lit(5) + F.floor(F.least(F.lit(1.0), share) * 55 + 0.5)).when(stage == "crawl_done", F.lit(62))
    out = out.when(stage == "competitor", F.lit(62) + F.floor(index / F.greatest(total, F.lit(1)) * 10 + 0.5))
    for name, (_, percent) in STEPS.items():
        out = out.when(stage == name, F.lit(percent))
    return out.otherwise(F.lit(5)).cast("int")


def step_of(stage: Column, crawled: Column, index: Column, total: Column) -> Column:
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    out = F.when(stage == "crawl", F.concat(F.lit("Crawling site pages... "), number(crawled), F.lit(" crawled"))).when(stage == "crawl_done", F.concat(F.lit("Crawl complete: "), number(crawled), F.lit(" pages")))
    out = out.when(stage == "competitor", F.concat(F.lit("Crawling competitor "), number(index), F.lit(" of "), number(total), F.lit("...")))
    for name, (step, _) in STEPS.items():
        out = out.when(stage == name, F.lit(step))
    return out.otherwise(F.lit("Working..."))


def progress(events: DataFrame) -> DataFrame:
    """``run_id, seq, step, percent, shown``: progress by event, and as shown, which never falls. events: parsed, with ``run_id, seq``."""
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.coalesce(F.last(F.when(F.col("stage") == "start", F.coalesce(F.nullif("maxPages", F.lit(0)), F.lit(250))), ignorenulls=True).over(order), F.lit(250))
    c = F.col
    out = events.where("type = 'progress'").withColumn("limit", limit)
    out = out.select("run_id", "seq", step_of(c("stage"), c("crawled"), c("index"), c("total")).alias("step"), percent_of(c("stage"), c("crawled"), c("queued"), c("index"), c("total"), c("limit")).alias("percent"))
    return out.withColumn("shown", F.max("percent").over(order))


def outcome(events: DataFrame) -> DataFrame:
    """``run_id, data, error``: the last result of each run, its first error, or that it has neither."""
    c = F.col
    got = events.groupBy("run_id").agg(F.max_by("data", F.when(c("type") == "result", c("seq"))).alias("data"), F.min_by("error", F.when(c("type") == "error", c("seq"))).alias("failed"))
    return got.select("run_id", F.when(c("failed").isNull(), c("data")).alias("data"), F.when(c("failed").isNotNull(), c("failed")).when(c("data").isNull(), F.lit("The stream ended without a result")).alias("error"))


def lines(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(run_id, seq, value)``: the JSON lines of runs, their progress events first and then one result or error. events: ``run_id, seq, stage`` and what else an event
    says; outcomes: ``run_id, data, error``. Nulls are left out."""
    said = [n for n in events.columns if n not in ("run_id", "seq")]
    sent = events.select("run_id", F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(F.lit("progress").alias("type"), *said)).alias("value"))
    failed = F.col("error").isNotNull()
    end = F.when(failed, F.to_json(F.struct(F.lit("error").alias("type"), "error"))).otherwise(F.to_json(F.struct(F.lit("result").alias("type"), "data")))
    return sent.unionByName(outcomes.select("run_id", F.lit((1 << 63) - 1).alias("seq"), end.alias("value")))


def save_lines(rows: DataFrame, folder: str) -> None:
    """Files of JSON lines with their run; a run's lines follow each other, a long run over several files."""
    rows.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq").select("run_id", "value").write.json(folder)


def stream_lines(rows: DataFrame, folder: str, checkpoint: str):
    """The same for a stream, from which all that has come by now is written."""
    return rows.select("run_id", "value").writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def accepted(times: list[int], log: list[int], window_ms: int, most: int) -> tuple[list[bool], list[int]]:
    """Which requests of one client, in order, are let through: at most ``most`` accepted within the window before each. Refused ones don't count."""
    out = []
    for t in times:
        log = [x for x in log if x > t - window_ms]
        ok = len(log) < most
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def rate_limit(requests: DataFrame, *, client: str, at_ms: str, tie: str, window_ms: int = WINDOW_MS, most: int = MOST_REQUESTS) -> DataFrame:
    """Adds ``accepted`` to a batch of requests. A client's decisions depend on those before, so its requests are taken in order; only the log of
    accepted times is held, as rows stream through sorted partitions."""
    names = list(requests.columns)
    schema = T.StructType([*requests.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = object(), []
        for df in batches:
            flags = []
            for who, t in zip(df[client], df[at_ms], strict=True):
                if who != now:
                    now, log = who, []
                ok, log = accepted([t], log, window_ms, most)
                flags += ok
            yield df[names].assign(accepted=flags)

    return requests.repartition(client).sortWithinPartitions(client, at_ms, tie).mapInPandas(run, schema)


def rate_limit_stream(requests: DataFrame, *, client: str, at_ms: str, window_ms: int = WINDOW_MS, most: int = MOST_REQUESTS) -> DataFrame:
    """The same on a stream: ``client, at_ms, accepted``. State is the log of accepted times; it goes when event time has passed a client by more than a window.
    Requests that come later than a window are left out, as their client's log may be gone."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        times = sorted(t for df in batches for t in df[at_ms].tolist())
        flags, log = accepted(times, log, window_ms, most)
        state.update((log,))
        state.setTimeoutTimestamp(max(log[-1] + 2 * window_ms if log else 0, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: [key[0]] * len(times), at_ms: times, "accepted": flags})

    kind = requests.schema[client].dataType.simpleString()
    timed = requests.select(client, at_ms, F.timestamp_millis(at_ms).alias("at")).withWatermark("at", f"{window_ms} milliseconds")
    return timed.groupBy(client).applyInPandasWithState(run, f"{client} {kind}, {at_ms} long, accepted boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def open_counts_stream(opens: DataFrame) -> DataFrame:
    """Running opens by send, for a sink in update mode."""
    return opens.groupBy("send_id").agg(F.count("*").alias("open_count"), F.min("ts").alias("first_opened_at"), F.max("ts").alias("last_opened_at"))
