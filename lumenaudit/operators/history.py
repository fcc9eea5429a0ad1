"""The audit store: clients, audits, sends and opens as tables, and the queries over them. Stores are append-only; the current state is a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.text import stripped


def latest_history(audits: DataFrame, clients: DataFrame, sends: DataFrame, most: int = 50) -> DataFrame:
    """The latest audits, with the client's name and the sends as an array, the latest first.

    The limit comes before the joins: they only see ``most`` rows, whatever the stores hold."""
    top = audits.orderBy(F.col("created_at").desc(), "id").limit(most)
    own = sends.join(F.broadcast(top.select(F.col("id").alias("audit_id"))), "audit_id", "left_semi")
    nested = own.groupBy("audit_id").agg(F.sort_array(F.collect_list(F.struct("sent_at", "id", "open_count")), asc=False).alias("sends"))
    out = top.join(clients.select(F.col("id").alias("client_id"), "company_name"), "client_id", "left").join(nested.withColumnRenamed("audit_id", "id"), "id", "left")
    return out.withColumn("sends", F.coalesce("sends", F.array().cast(nested.schema["sends"].dataType)))


def history_kpis(history: DataFrame) -> DataFrame:
    """Counts of audits, sends and opened sends of a history."""
    opened = F.size(F.filter("sends", lambda s: s["open_count"] > 0))
    return history.agg(F.count("*").alias("audits"), F.coalesce(F.sum(F.size("sends")), F.lit(0)).cast("long").alias("sends"), F.coalesce(F.sum(opened), F.lit(0)).cast("long").alias("opened"))


def reopened(audits: DataFrame, clients: DataFrame) -> DataFrame:
    """Stored audits as a workspace reopens them: ``audit_id, client_id, company_name, scores, llm_status, html, markdown, workspace``, with what older rows lack taken from their columns.

    audits: ``id, client_id, domain, requested_url, created_at`` and JSON texts ``scores, findings, category_details, competitors, crawl_summary, report``. clients: ``id, company_name``.
    A workspace is JSON: the stored one, else one without pages from the columns."""
    c = F.col
    part = lambda path: F.get_json_object("report", path)
    filled = lambda name, empty: F.coalesce(c(name), F.lit(empty))
    llm = F.coalesce(part("$.llm"), F.lit('{"status":"skipped"}'))
    js = lambda name, empty: F.parse_json(filled(name, empty))
    primary = F.struct(
        c("domain"), c("requested_url").alias("startUrl"), F.coalesce(F.get_json_object("crawl_summary", "$.crawledPages").cast("long"), F.lit(0)).alias("pageCount"), F.array().cast("array<string>").alias("pages"),
        F.struct(js("crawl_summary", "{}").alias("summary")).alias("crawl"), js("scores", "{}").alias("scores"), js("findings", "[]").alias("findings"), js("category_details", "{}").alias("categoryDetails"),
    )
    whole = F.struct(c("created_at").alias("createdAt"), F.struct(c("requested_url").alias("url")).alias("input"), primary.alias("primary"), js("competitors", "[]").alias("competitorComparison"), F.parse_json(llm).alias("llm"))
    rebuilt = F.to_json(whole, {"ignoreNullFields": "false"})
    named = audits.join(clients.select(c("id").alias("client_id"), "company_name"), "client_id", "left")
    return named.select(
        c("id").alias("audit_id"), "client_id", F.coalesce(F.nullif("company_name", F.lit("")), "domain").alias("company_name"), filled("scores", "{}").alias("scores"), F.get_json_object(llm, "$.status").alias("llm_status"),
        F.coalesce(part("$.html"), F.lit("")).alias("html"), F.nullif(part("$.markdown"), F.lit("")).alias("markdown"), F.coalesce(part("$.workspace"), rebuilt).alias("workspace"),
    )


def audit_by_id(audits, clients: DataFrame, audit_id: str) -> DataFrame:
    """One stored audit, reopened; a malformed id finds nothing. audits: a DataFrame, or a ``Store`` by id, of which only files that can hold the id are read."""
    if not valid_uuid(audit_id):
        found = (audits if isinstance(audits, DataFrame) else audits.find([audit_id])).where(F.lit(False))
    else:
        found = audits.where(F.col("id") == audit_id) if isinstance(audits, DataFrame) else audits.find([audit_id])
    return reopened(found, clients)


def valid_uuid(text: str) -> bool:
    import re

    return bool(re.fullmatch(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", text or ""))


def upsert_clients(old: DataFrame, new: DataFrame, key: str = "domain", kept: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """``old`` with ``new`` merged in by ``key``: known rows keep ``kept`` and take the other columns. One shuffle by key, no lookups."""
    order = Window.partitionBy(key)
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    first, last = order.orderBy("__v"), order.orderBy(F.col("__v").desc())
    ranked = both.withColumn("__r", F.row_number().over(last)).withColumns({c: F.first(c).over(first) for c in kept})
    return ranked.where("__r = 1").drop("__r", "__v").select(*old.columns)


def new_send(requests: DataFrame) -> DataFrame:
    """Rows of a send from what was posted: trimmed address in lower case, trimmed name or none, with ``error`` where the request is invalid."""
    email, name = F.lower(stripped(F.col("prospect_email"))), F.nullif(stripped(F.col("prospect_name")), F.lit(""))
    error = F.when(F.col("audit_id").isNull() | ~F.col("audit_id").rlike("^[0-9a-fA-F-]{36}$"), "A valid audit is required").when(email.isNull() | ~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "A valid email is required").when(F.length(name) > 200, "The name is too long")
    return requests.withColumns({"prospect_email": email, "prospect_name": name, "error": error})


def open_counts(events: DataFrame, key: str = "send_id", at: str = "ts") -> DataFrame:
    """Opens of each send: how many, the first and the last. Opens are appended, never updated, so the count needs no lock."""
    return events.groupBy(key).agg(F.count("*").alias("open_count"), F.min(at).alias("first_opened_at"), F.max(at).alias("last_opened_at"))


def with_opens(sends: DataFrame, events: DataFrame) -> DataFrame:
    """Sends with their opens; those never opened count 0."""
    got = open_counts(events).withColumnRenamed("send_id", "id")
    return sends.drop("open_count", "first_opened_at", "last_opened_at").join(got, "id", "left").withColumn("open_count", F.coalesce("open_count", F.lit(0)))


def sends_of_domain(sends: DataFrame, domain: str, most: int = 25) -> DataFrame:
    return sends.where(F.col("domain") == domain).orderBy(F.col("sent_at").desc(), "id").limit(most)


def delete_client(clients: DataFrame, audits: DataFrame, sends: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after clients for which ``gone`` holds were deleted: their audits and those audits' sends go, other sends lose the client."""
    left = clients.where(~gone)
    ids = left.select(F.col("id").alias("client_id"))
    audits_left = audits.join(ids, "client_id", "left_semi").unionByName(audits.where("client_id IS NULL"))
    sends_left = sends.join(audits_left.select(F.col("id").alias("audit_id")), "audit_id", "left_semi")
    known = ids.withColumn("__k", F.lit(True))
    return left, audits_left, sends_left.join(known, "client_id", "left").withColumn("client_id", F.when(F.col("__k"), F.col("client_id"))).drop("__k")
