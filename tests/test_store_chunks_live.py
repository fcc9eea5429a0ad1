"""Chunked streams, state by run, exactly-once appends and the store of audits."""

import random

import pytest
from pyspark.sql import functions as F

from lumenaudit.operators import history
from lumenaudit.sources.store import Conflict, Store
from lumenaudit.streaming import chunks, live


def test_chunks_cut_anywhere(spark):
    r = random.Random(1)
    rows, want = [], []
    for run in ("a", "b", "c", "d"):
        text = "\n".join(r.choice(["", "  ", "plain", "é€😀" * r.randrange(9), "x" * r.randrange(60)]) for _ in range(80)) + r.choice(["", "\n"])
        data = text.encode() + (b"\xff\xfe end" if run == "b" else b"")
        if run == "c":
            data = b"\xef\xbb\xbf" + data
        lines = data.decode("utf-8", "replace").removeprefix("﻿" if run == "c" else "").split("\n")
        want += [(run, n, x) for n, x in enumerate(lines) if x.strip()]
        cuts = sorted(r.sample(range(len(data)), 40 if run != "d" else 3))
        rows += [(run, n, data[a:b]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    rows += [("a", 1000, None), (None, 0, b"of no run\n"), ("e", 0, b"one "), ("e", 1, b"line"), ("e", 2, b"")]
    want.append(("e", 0, "one line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunks.chunk_lines(spark.createDataFrame(rows, "run_id string, seq long, data binary").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == sorted(want)
    assert chunks.chunk_lines(spark.createDataFrame([], "run_id string, seq long, data binary")).collect() == []


def landed(spark, stream, tmp_path):
    with live.column_state(spark):
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").collect()))


def test_chunks_of_a_stream_in_any_order(spark, tmp_path):
    data = b"\xef\xbb\xbfone\ntw\xc3\xb6\n\nthree \xe2\x82\xac and the last"
    pieces = [data[k : k + 2] for k in range(0, len(data), 2)]
    rows = [("r", n, p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
    parts = [rows[5:9] + rows[:1], rows[1:5] + rows[3:4], rows[9:] + [("q", 0, b"no end", True), ("p", 1, b"its first chunk never comes\n", True)]]
    for p in parts:
        spark.createDataFrame(p, "run_id string, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("run_id string, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert landed(spark, chunks.chunk_lines_stream(source), tmp_path) == [("q", 0, "no end"), ("r", 0, "one"), ("r", 1, "twö"), ("r", 3, "three € and the last")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/audits", "id long, domain string, created_at string", "id")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_append_once_and_merge(spark, store):
    one = spark.createDataFrame([(k, f"d{k}", "t0") for k in range(100)], "id long, domain string, created_at string")
    assert store.read().collect() == [] and store.find([1]).collect() == []
    assert store.append(one, writer="w", batch=7) and not store.append(one, writer="w", batch=7) and store.append(one.where("id < 0"), writer="w", batch=8)
    store.merge(spark.createDataFrame([(5, "new", "t1"), (200, "more", "t1")], one.schema), ("created_at",))
    assert rows_of(store.read()) == sorted([(k, "new" if k == 5 else f"d{k}", "t0") for k in range(100)] + [(200, "more", "t1")])
    again = Store(spark, store.path, "id long, domain string, created_at string", "id")
    assert rows_of(again.find([5, 200, 999])) == [(5, "new", "t0"), (200, "more", "t1")]


def test_point_reads_leave_files_out(spark, store):
    for k in range(6):
        store.append(spark.range(k * 1000, k * 1000 + 1000).select("id", F.lit("d").alias("domain"), F.lit("t").alias("created_at")))
    every, some = store.read().inputFiles(), store.find([1500, 4242]).inputFiles()
    assert len(some) < len(every) / 2 and rows_of(store.find([1500, 4242])) == [(1500, "d", "t"), (4242, "d", "t")]


def test_a_killed_writer_leaves_the_old_state(spark, store, monkeypatch):
    one = spark.createDataFrame([(1, "a", "t")], "id long, domain string, created_at string")
    store.append(one)
    monkeypatch.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.append(one.withColumn("id", F.lit(2)), writer="w", batch=1)
    monkeypatch.undo()
    assert rows_of(store.read()) == [(1, "a", "t")]
    assert store.append(one.withColumn("id", F.lit(2).cast("long")), writer="w", batch=1)  # its next try isn't taken for a repeat
    assert rows_of(store.read()) == [(1, "a", "t"), (2, "a", "t")]


def test_rivals(spark, store, monkeypatch):
    """A rival's append between a writer's read and its publication: both appends stay, a merge starts again on what is there."""
    row = lambda k, d: spark.createDataFrame([(k, d, "t")], "id long, domain string, created_at string")
    store.append(row(1, "first"))
    rival, written, done = Store(spark, store.path, "id long, domain string, created_at string", "id"), store._written, []

    def late(rows):
        files = written(rows)
        if not done:
            done.append(1)
            rival.append(row(1 if merging else 3, "rival"))
        return files

    for merging in (False, True):
        done.clear()
        monkeypatch.setattr(store, "_written", late)
        if merging:
            store.merge(row(1, "merged").unionByName(row(4, "new")), ("created_at",))
        else:
            store.append(row(2, "second"))
        monkeypatch.undo()
    assert [r[0] for r in rows_of(store.read())] == [1, 2, 3, 4] and store.find([1]).first().domain == "merged"
    monkeypatch.setattr(store, "_publish", lambda *a: False)
    with pytest.raises(Conflict):
        store.append(row(9, "never"), tries=3)


def test_opens_are_recorded_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k % 2, k), (9, k)], "send_id long, ts long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("send_id long, ts long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    opens = Store(spark, f"file://{tmp_path}/opens", "send_id long, ts long", "send_id")
    for attempt in range(2):  # the second one has lost its checkpoint and starts anew
        live.record_opens(source, opens, f"{tmp_path}/state{attempt}").awaitTermination()
    assert rows_of(history.open_counts(opens.read())) == [(0, 2, 0, 2), (1, 1, 1, 1), (9, 3, 0, 2)]


def test_opened_reports(spark):
    sends, audits = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 30)], "id long, audit_id long"), spark.createDataFrame([(10, "<p>"), (30, "")], "id long, html string")
    got = live.opened_reports(sends, audits, spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5)], "send_id long"))
    assert rows_of(got.select("send_id", "status")) == [(1, "ok"), (2, "no report"), (3, "no report"), (4, "no report"), (5, "no send")]


def test_audit_by_id(spark, tmp_path):
    names = ("id", "client_id", "domain", "requested_url", "created_at", "scores", "findings", "category_details", "competitors", "crawl_summary", "report")
    schema = ", ".join(f"{n} {'long' if n == 'client_id' else 'string'}" for n in names)
    ids = [f"{k:08d}-0000-0000-0000-000000000000" for k in range(3)]
    data = [(ids[0], 1, "a.example", "https://a.example", "2024", '{"overall":5}', "[]", "{}", "[]", '{"crawledPages":7}', None), (ids[1], None, "b.example", None, None, None, None, None, None, None, '{"workspace":{"kept":1},"markdown":"# m","html":"<p>"}')]
    store = Store(spark, f"file://{tmp_path}/audits", schema, "id")
    store.append(spark.createDataFrame(data, schema))
    clients = spark.createDataFrame([(1, "A")], "id long, company_name string")
    a, b = (history.audit_by_id(store, clients, k).first() for k in ids[:2])
    assert (a.company_name, a.llm_status, a.html, a.markdown) == ("A", "skipped", "", None)
    assert '"pageCount":7' in a.workspace and '"overall":5' in a.workspace and '"pages":[]' in a.workspace
    assert (b.company_name, b.workspace, b.markdown, b.html) == ("b.example", '{"kept":1}', "# m", "<p>")
    assert [history.audit_by_id(store, clients, k).count() for k in (ids[2], "x", "")] == [0, 0, 0]
