"""Redirects of a snapshot of answers: where each URL ends up, by pointers that double, and pages that share their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions import urls
from lumenaudit.sources.storage import stored

# Answers that lead elsewhere, and how many of them are followed.
REDIRECTS = (301, 302, 303, 307, 308)
MOST_REDIRECTS = 5
c = F.col


def followed(answers: DataFrame) -> DataFrame:
    """``url, final_url, hops, status, ok, error`` of every URL of ``answers (url, status, location)``, one answer a URL (of several the first by status and location).

    At most five redirects are followed: the pointers of 1, 2 and 4 hops come from one join each, and 5 are 4 and 1, however long chains are or whether they loop. A location is taken relative to its URL;
    one that leads out of the snapshot has status 0, one without location ends there. A URL that many others lead to is one row of the joined side; its others are split by the engine where they are skewed."""
    one = answers.where(c("url").isNotNull()).groupBy("url").agg(F.min(F.struct(F.coalesce("status", F.lit(0)).alias("status"), "location")).alias("a")).select("url", "a.status", c("a.location").alias("location"))
    moved = c("status").isin(*REDIRECTS)
    target = urls.resolved(c("location"), c("url"))
    one = one.withColumn("to", F.when(moved & (F.coalesce("location", F.lit("")) != ""), F.coalesce(target, c("location"))))
    first = stored(one)
    lost = first.where(c("to").isNotNull()).select(c("to").alias("url")).distinct().join(first.select("url"), "url", "left_anti")  # outside the snapshot
    known = first.unionByName(lost, allowMissingColumns=True).withColumn("status", F.coalesce("status", F.lit(0)))
    step = stored(known.select("url", F.coalesce("to", "url").alias("p"), c("to").isNotNull().cast("int").alias("h")))

    def after(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(c("url").alias("p"), c("p").alias("next"), c("h").alias("more")), "p").select("url", c("next").alias("p"), (c("h") + c("more")).alias("h"))

    two = stored(after(step, step))
    five = after(after(two, two), step)
    ends = known.select(c("url").alias("p"), "status", "to")
    got = first.select("url").join(five, "url").join(ends, "p")
    error = F.when(c("to").isNotNull(), "Too many redirects").when(moved, "Redirect without Location header").when(c("status") == 0, "Not in the snapshot")
    return got.select("url", c("p").alias("final_url"), c("h").alias("hops"), "status", (c("status").between(200, 299) & c("to").isNull()).alias("ok"), error.alias("error"))


def same_end(found: DataFrame) -> DataFrame:
    """``final_url, urls, first_url``: ends that several URLs share, by canonical URL."""
    return found.where("ok").groupBy(urls.canonical(c("final_url")).alias("final_url")).agg(F.count("*").alias("urls"), F.min("url").alias("first_url")).where("urls > 1")
