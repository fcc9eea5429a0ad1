"""The audit store, event streams and the request limiter."""

import json

import numpy as np
from pyspark.sql import functions as F

from lumenaudit.operators import history
from lumenaudit.streaming import progress as stream


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 10)], "id int, domain string, industry string, created_at int")
    new = spark.createDataFrame([(9, "b", "z", 20), (3, "c", "w", 20)], "id int, domain string, industry string, created_at int")
    assert sorted(map(tuple, history.upsert_clients(old, new).collect())) == [(1, "a", "x", 10), (2, "b", "z", 10), (3, "c", "w", 20)]


def test_delete_and_opens(spark):
    clients = spark.createDataFrame([(1,), (2,)], "id int")
    audits = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, client_id int")
    sends = spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 12, 2)], "id int, audit_id int, client_id int")
    _, a, s = history.delete_client(clients, audits, sends, F.col("id") == 1)
    assert sorted(r.id for r in a.collect()) == [11, 12] and sorted((r.id, r.client_id) for r in s.collect()) == [(101, None), (102, 2)]
    opens = spark.createDataFrame([(100, 5), (100, 3)], "send_id int, ts int")
    got = {r.id: (r.open_count, r.first_opened_at, r.last_opened_at) for r in history.with_opens(sends, opens).collect()}
    assert got == {100: (2, 3, 5), 101: (0, None, None), 102: (0, None, None)}
    assert history.valid_uuid("0f8fad5b-d9cb-469f-a165-70867728950e") and not history.valid_uuid("x")


def test_events_and_progress(spark):
    lines = [{"type": "progress", "stage": "start", "maxPages": 10}, {"type": "progress", "stage": "crawl", "crawled": 5, "queued": 50}, {"type": "progress", "stage": "pagespeed_done"}, {"type": "progress", "stage": "competitor", "index": 1, "total": 2}, {"type": "result", "data": "D"}]
    rows = [("r", k, json.dumps(x)) for k, x in enumerate(lines)] + [("r", 9, "not json"), ("r", 10, " "), ("q", 0, json.dumps({"type": "error", "error": "E"})), ("p", 0, json.dumps(lines[0]))]
    events = stream.parse_events(spark.createDataFrame(rows, "run_id string, seq int, value string"))
    got = stream.progress(events.where("run_id = 'r'")).orderBy("seq").collect()
    assert [(r.percent, r.shown) for r in got] == [(4, 4), (33, 33), (30, 33), (67, 67)] and got[1].step == "Crawling site pages... 5 crawled"
    out = {r.run_id: (r.data, r.error) for r in stream.outcome(events).collect()}
    assert out["r"] == ("D", None) and out["q"] == (None, "E") and out["p"][1] is not None


def limited(times, window, most):
    log, out = [], []
    for t in times:
        log = [x for x in log if x > t - window]
        out.append(len(log) < most)
        if out[-1]:
            log.append(t)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(int(c), int(t), k) for k, (c, t) in enumerate(zip(r.integers(0, 5, 300), np.sort(r.integers(10_000, 14_000, 300)), strict=True))]
    want = {}
    for c in range(5):
        mine = [x for x in rows if x[0] == c]
        want |= dict(zip((x[2] for x in mine), limited([x[1] for x in mine], 300, 3), strict=True))
    df = spark.createDataFrame(rows, "client int, at_ms long, id int")
    assert {x.id: x.accepted for x in stream.rate_limit(df, client="client", at_ms="at_ms", tie="id", window_ms=300, most=3).collect()} == want
    for part in range(2):
        df.where(F.col("id") < 150 if part == 0 else F.col("id") >= 150).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.rate_limit_stream(source, client="client", at_ms="at_ms", window_ms=300, most=3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT count(*) n, count_if(accepted) a FROM limited").first()
    assert got.n == 300 and got.a == sum(want.values())


def test_open_counts_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "send_id int, ts int").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("send_id int, ts int").parquet(str(tmp_path / "in"))
    q = stream.open_counts_stream(source).writeStream.outputMode("complete").format("memory").queryName("opens").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("opens").collect())) == [(1, 2, 3, 5), (2, 1, 9, 9)]


def test_lines_to_files(spark, tmp_path):
    events = spark.createDataFrame([("r", 2, "crawl", 7), ("r", 1, "start", None), ("q", 1, "start", None)], "run_id string, seq int, stage string, crawled int")
    ends = spark.createDataFrame([("r", "D", None), ("q", None, "E"), ("p", None, None)], "run_id string, data string, error string")
    rows = stream.lines(events, ends)
    stream.save_lines(rows, str(tmp_path / "batch"))
    texts = [json.loads(x) for p in sorted((tmp_path / "batch").glob("*.json")) for x in p.read_text().splitlines()]
    assert [json.loads(x["value"]) for x in texts if x["run_id"] == "r"] == [{"type": "progress", "stage": "start"}, {"type": "progress", "stage": "crawl", "crawled": 7}, {"type": "result", "data": "D"}]
    assert [json.loads(x["value"])["type"] for x in texts if x["run_id"] == "q"] == ["progress", "error"] and [x["run_id"] for x in texts].count("p") == 1
    source = spark.readStream.schema("run_id string, value string").json(str(tmp_path / "batch"))
    stream.stream_lines(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 6
