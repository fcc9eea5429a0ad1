"""Queries over streams and over tables that grow, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenaudit.operators import history
from lumenaudit.plans.registry import query
from lumenaudit.sources.storage import shared_folder, stored
from lumenaudit.sources.store import Store
from lumenaudit.sources.tables import table
from lumenaudit.streaming import chunks, live
from lumenaudit.streaming import progress as events_of

c = F.col


#: Rows of a file, at least, where a part of a stream comes in several.
FILE_ROWS = 10_000


def arriving(rows: DataFrame, part: F.Column, parts: int) -> DataFrame:
    """The rows as a stream that brings one part after another, each in as many files: they are written and read by all cores."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    numbered = stored(rows.withColumn("__part", part))
    sizes = {r["__part"]: r["count"] for r in numbered.groupBy("__part").count().collect()}  # a row a part
    # so few files that each has rows of each part: a file without rows would not be written
    files = max(1, min(2 * spark.sparkContext.defaultParallelism, *(sizes.get(k, 0) // FILE_ROWS for k in range(parts))))
    for k in range(parts):
        mine = numbered.where(c("__part") == k).drop("__part")
        (mine.repartition(files) if files > 1 else mine.coalesce(1)).write.mode("append").parquet(folder)
        if len(spark.read.schema(rows.schema).parquet(folder).inputFiles()) != files * (k + 1):
            raise ValueError("a part of the stream has another number of files")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def landed(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source has no more, with state by column."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    with live.column_state(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


LINES_SQL = """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line, '{"id":' || event_id || ',"said":"é€' || event_type || '😀"}' AS value FROM events"""


def event_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as lines, sent in chunks that end within a line, mostly within one of its characters: ``run_id, seq, data, last``."""
    line = F.concat(F.lit('{"id":'), c("event_id").cast("string"), F.lit(',"said":"é€'), "event_type", F.lit('😀"}'))
    e = table(spark, sf, "events").select(c("user_id").alias("run_id"), "event_id", line.cast("binary").alias("bytes"))
    cut = F.pmod(F.xxhash64("event_id"), F.octet_length("bytes")).cast("int")
    e = e.withColumn("cut", cut).select("run_id", "event_id", F.expr("substring(bytes, 1, cut)").alias("head"), F.expr("substring(bytes, cut + 1)").alias("tail"))
    order = Window.partitionBy("run_id").orderBy("event_id")
    e = e.withColumns({"seq": F.row_number().over(order) - 1, "open": F.lag("tail").over(order), "more": F.lead("event_id").over(order).isNotNull()})
    sent = e.select("run_id", c("seq").cast("long").alias("seq"), F.when(c("open").isNull(), c("head")).otherwise(F.concat("open", F.lit(b"\n"), "head")).alias("data"), F.lit(False).alias("last"))
    ends = e.where("NOT more").select("run_id", (c("seq") + 1).cast("long").alias("seq"), c("tail").alias("data"), F.lit(True).alias("last"))
    return sent.unionByName(ends)


@query(LINES_SQL)
def chunked_lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_lines(event_chunks(spark, sf))


@query(LINES_SQL)
def chunked_lines_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks come in three parts, each run's out of order."""
    return landed(chunks.chunk_lines_stream(arriving(event_chunks(spark, sf), F.pmod(c("seq") * 2 + 1, F.lit(3)), 3)))


RUNS_SQL = """WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_type AS t, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
l AS (SELECT *, coalesce(last_value(CASE WHEN t = 'purchase' THEN coalesce(nullif(k % 40, 0), 250) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 250) AS pages FROM e),
p AS (SELECT run_id, seq, CASE t WHEN 'purchase' THEN 'Preparing audit scope...' WHEN 'view' THEN 'Crawling site pages... ' || k || ' crawled' WHEN 'click' THEN 'Crawling competitor ' || k || ' of 100...' ELSE 'Working...' END AS step,
(CASE t WHEN 'purchase' THEN 4 WHEN 'view' THEN 5 + floor(least(1.0::DOUBLE, CASE WHEN k + 7 > 0 THEN k / least(greatest(k + 7, 1), pages)::DOUBLE ELSE 0 END) * 55 + 0.5) WHEN 'click' THEN 62 + floor(k / 100.0::DOUBLE * 10 + 0.5) ELSE 5 END)::INT AS percent FROM l)
SELECT *, max(percent) OVER (PARTITION BY run_id ORDER BY seq) AS shown FROM p"""


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an audit's: a purchase starts a run anew with its limit of pages, views are crawled pages, clicks competitors."""
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.create_map(*(F.lit(x) for x in ("purchase", "start", "view", "crawl", "click", "competitor")))[c("event_type")]
    line = F.to_json(F.struct(F.lit("progress").alias("type"), F.coalesce(stage, F.lit("other")).alias("stage"), k.alias("crawled"), F.lit(7).alias("queued"), k.alias("index"), F.lit(100).alias("total"), (k % 40).alias("maxPages")))
    return events_of.parse_events(table(spark, sf, "events").select(c("user_id").alias("run_id"), c("event_id").alias("seq"), line.alias("value")))


@query(RUNS_SQL)
def progress_runs(spark: SparkSession, sf: str) -> DataFrame:
    return events_of.progress(run_events(spark, sf)).select("run_id", "seq", "step", "percent", "shown")


@query(RUNS_SQL)
def progress_runs_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = stored(run_events(spark, sf))
    least, most = e.agg(F.min("seq"), F.max("seq")).first()
    part = F.least(F.floor((c("seq") - (least or 0)) * 4 / ((most or 0) - (least or 0) + 1)), F.lit(3))
    return landed(live.progress_stream(arriving(e, part, 4)))


@query("SELECT user_id AS send_id, count(*) AS open_count, min(ts) AS first_opened_at, max(ts) AS last_opened_at FROM events WHERE event_type = 'view' GROUP BY 1")
def opens_once(spark: SparkSession, sf: str) -> DataFrame:
    """Opens come as a stream and are recorded once; then all of it is run again from the start, as after a lost checkpoint, which adds nothing."""
    folder = shared_folder(spark)
    opens = table(spark, sf, "events").where("event_type = 'view'").select(c("user_id").alias("send_id"), "ts", "event_id")
    stream = arriving(opens, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3).select("send_id", "ts")
    store = Store(spark, f"{folder}/opens", "send_id long, ts timestamp_ntz" if dict(opens.dtypes)["ts"] == "timestamp_ntz" else "send_id long, ts timestamp", "send_id")
    for attempt in range(2):
        live.record_opens(stream, store, f"{folder}/state{attempt}").awaitTermination()
    return history.open_counts(store.read())


@query("""SELECT DISTINCT l_orderkey * 8 + l_linenumber AS send_id, CASE WHEN l_linenumber < 7 THEN l_orderkey END AS audit_id, CASE WHEN l_linenumber = 7 THEN 'no send' WHEN o_orderkey IS NULL OR o_orderstatus = 'P' THEN 'no report' ELSE 'ok' END AS status
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber < 6 WHERE l_returnflag = 'R'""")
def opened_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as sends of their order's report; the seventh of an order was never sent, the sixth's report is gone, and open orders have none yet."""
    line = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), c("l_linenumber").alias("n"), F.when(c("l_linenumber") < 6, c("l_orderkey")).otherwise(-c("l_orderkey")).alias("audit_id"))
    audits = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") != "P", F.concat(F.lit("<html>"), "o_comment" if "o_comment" in table(spark, sf, "orders").columns else "o_orderstatus")).alias("html"))
    got = live.opened_reports(line.where("n < 7").select("id", "audit_id"), audits, line.select(c("id").alias("send_id")))
    return got.withColumn("audit_id", F.abs("audit_id"))


def order_store(spark: SparkSession, sf: str) -> Store:
    """Orders as a table of audits, in two appends and a merge that renames every fifth one and adds some."""
    store = Store(spark, f"{shared_folder(spark)}/audits", "id long, domain string, created_at string", "id")
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("domain"), c("o_orderdate").cast("string").alias("created_at"))
    store.append(o.where("id % 7 < 4"), writer="first", batch=0)
    store.append(o.where("id % 7 >= 4"), writer="second", batch=0)
    store.append(o.where("id % 7 < 4"), writer="first", batch=0)  # once more, as after a failure
    news = o.where("id % 5 = 0").select("id", F.concat(F.lit("new "), "domain").alias("domain"), F.lit("later").alias("created_at"))
    store.merge(news.unionByName(o.where("id % 50 = 1").select((-c("id")).alias("id"), F.lit("added").alias("domain"), "created_at")), ("created_at",))
    return store


STORE_SQL = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new ' || o_orderstatus ELSE o_orderstatus END AS domain, o_orderdate::VARCHAR AS created_at FROM orders
UNION ALL SELECT -o_orderkey, 'added', o_orderdate::VARCHAR FROM orders WHERE o_orderkey % 50 = 1"""


@query(STORE_SQL)
def audit_store(spark: SparkSession, sf: str) -> DataFrame:
    return order_store(spark, sf).read()


@query(f"SELECT * FROM ({STORE_SQL}) WHERE id IN (SELECT unnest([max(o_orderkey), min(o_orderkey), -1]) FROM orders)")
def audit_store_find(spark: SparkSession, sf: str) -> DataFrame:
    """Point reads: the files' ranges of keys tell which are read."""
    least, most = table(spark, sf, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return order_store(spark, sf).find([most, least, -1])


@query("""WITH a AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer)
SELECT k AS audit_id, CASE WHEN k % 4 = 0 THEN 'site' || k || '.example' ELSE c_name END AS company_name, CASE WHEN k % 3 = 0 THEN 'generated' ELSE 'skipped' END AS llm_status, CASE WHEN k % 3 = 0 THEN '<p>' || k || '</p>' ELSE '' END AS html,
CASE WHEN k % 3 = 0 THEN '# ' || k END AS markdown, CASE WHEN k % 3 = 0 THEN 'stored ' || k ELSE 'site' || k || '.example' END AS domain, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN 0 ELSE k % 100 END AS pages,
CASE WHEN k % 3 = 0 THEN NULL ELSE c_mktsegment || '"' || k END AS first_finding, CASE WHEN k % 3 = 0 THEN NULL ELSE 'skipped' END AS told FROM a""")
def audits_reopened(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as stored audits: every third with a report of its own, the others rebuilt from their columns."""
    k, whole = c("c_custkey"), c("c_custkey") % 3 == 0
    report = F.to_json(F.struct(F.struct(F.lit("generated").alias("status")).alias("llm"), F.concat(F.lit("<p>"), k, F.lit("</p>")).alias("html"), F.concat(F.lit("# "), k).alias("markdown"), F.struct(F.struct(F.concat(F.lit("stored "), k).alias("domain")).alias("primary")).alias("workspace")))
    finding = F.to_json(F.array(F.struct(F.concat("c_mktsegment", F.lit('"'), k).alias("id"))))
    audits = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 4 > 0, k).alias("client_id"), F.concat(F.lit("site"), k, F.lit(".example")).alias("domain"), F.lit("https://x.example").alias("requested_url"), F.lit("2024").alias("created_at"), F.lit(None).cast("string").alias("scores"),
        finding.alias("findings"), F.lit(None).cast("string").alias("category_details"), F.lit(None).cast("string").alias("competitors"), F.when(k % 5 > 0, F.to_json(F.struct((k % 100).alias("crawledPages")))).alias("crawl_summary"), F.when(whole, report).alias("report"),
    )
    clients = table(spark, sf, "customer").select(k.alias("id"), c("c_name").alias("company_name"))
    got = history.reopened(audits, clients)
    at = lambda path: F.get_json_object("workspace", path)
    return got.select("audit_id", "company_name", "llm_status", "html", "markdown", at("$.primary.domain").alias("domain"), at("$.primary.pageCount").cast("long").alias("pages"), at("$.primary.findings[0].id").alias("first_finding"), at("$.llm.status").alias("told"))
