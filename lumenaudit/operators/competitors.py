"""Comparison of audited sites with their competitors; competitors that failed keep their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.text import stripped

# The compared signals.
SIGNALS = (("Schema coverage", "schema_count"), ("FAQ pages", "faq_pages"), ("Topical depth", "topical_depth"), ("Trust pages", "trust_pages"))
NO_PAGES = "The crawl returned no usable pages"


def _said(label: str, name: str, ahead: bool) -> Column:
    p, c = F.col(f"p.{name}"), F.col(f"c.{name}")
    if ahead:
        return F.when(p > c, F.concat(F.lit(f"{label}: audited site has "), p.cast("string"), F.lit(", competitor has "), c.cast("string")))
    return F.when(c > p, F.concat(F.lit(f"{label}: competitor has "), c.cast("string"), F.lit(", audited site has "), p.cast("string")))


def failure(fetch_error: Column, blocked: Column) -> Column:
    """Why a competitor has no pages: the first error, else robots.txt, else nothing was found. The texts are fixed values."""
    return F.coalesce(F.concat(F.lit("Crawl failed: "), fetch_error), F.when(blocked, F.lit("The site's robots.txt disallows crawling")), F.lit("No pages could be crawled"))


def compare(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """pairs: ``site_id, competitor_id, name, url, error, ord``. sites: scored sites. At most five competitors a site, in order.

    Sites join by key on both sides, so neither has to fit in memory; failed competitors survive the left join."""
    kept = pairs.where("ord < 5")
    cols = ["site_id", "domain", "start_url", "page_count", "aeo_geo", "overall", *(n for _, n in SIGNALS)]
    own = sites.select(*cols)
    joined = kept.alias("k").join(own.alias("p"), F.col("k.site_id") == F.col("p.site_id")).join(own.alias("c"), F.col("k.competitor_id") == F.col("c.site_id"), "left")
    failed = F.col("k.error").isNotNull() | F.col("c.site_id").isNull() | (F.coalesce("c.page_count", F.lit(0)) == 0)
    listed = lambda ahead: F.when(failed, F.array().cast("array<string>")).otherwise(F.filter(F.array(*(_said(label, n, ahead) for label, n in SIGNALS)), lambda x: x.isNotNull()))
    return joined.select(
        F.col("k.site_id"), F.col("k.ord"), F.coalesce(F.nullif("k.name", F.lit("")), "c.domain", "k.url").alias("name"), F.coalesce("c.domain", "k.url").alias("domain"),
        F.when(failed, F.coalesce("k.error", F.lit(NO_PAGES))).alias("error"), F.when(~failed, F.col("c.overall")).alias("overall"), F.when(~failed, F.col("c.aeo_geo")).alias("aeo_geo"),
        F.when(~failed, F.col("c.aeo_geo") - F.col("p.aeo_geo")).alias("score_diff"), listed(False).alias("gaps"), listed(True).alias("advantages"), F.coalesce("c.page_count", F.lit(0)).alias("crawled_pages"),
    )


def competitor_list(text: Column) -> Column:
    """Competitors as typed, by lines or commas: trimmed, without blanks, the first five."""
    return F.slice(F.filter(F.transform(F.split(text, "\r?\n|,"), stripped), lambda x: x != ""), 1, 5)
