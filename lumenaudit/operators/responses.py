"""Projections of an audit for its response: pages without their text, the crawl's summary, PageSpeed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
MOST_PAGES, MOST_TYPES, MOST_ERRORS = 250, 8, 50
# Metrics and the audits they come from, the first that there is.
METRICS = {
    "first_contentful_paint": ("first-contentful-paint",), "largest_contentful_paint": ("largest-contentful-paint",), "total_blocking_time": ("total-blocking-time",),
    "cumulative_layout_shift": ("cumulative-layout-shift",), "speed_index": ("speed-index",), "interaction_to_next_paint": ("experimental-interaction-to-next-paint", "interactive"),
}


def response_pages(pages: DataFrame) -> DataFrame:
    """The first 250 pages of each site, without text and html. pages: page signals with ``site_id, ord, status``."""
    text = lambda name: F.coalesce(c(name), F.lit("")).alias(name)
    narrow = pages.select(
        "site_id", "ord", "url", "status", "title", text("meta_description"), "content_type", "indexable", text("robots_meta"), "h1_count", "word_count", "has_visible_faq", "schema_count",
        F.slice("schema_types", 1, MOST_TYPES).alias("schema_types"), "image_count", "images_with_alt", (F.size("phones") > 0).alias("has_phone"), (F.size("emails") > 0).alias("has_email"),
    )
    return narrow.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("ord"))).where(c("rank") <= MOST_PAGES).drop("rank")


def crawl_summary(errors: DataFrame) -> DataFrame:
    """``(site_id, failed_requests, errors)``: how many there were, and the first 50 of them. errors: ``site_id, ord, url, error``."""
    ranked = errors.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("ord")))
    first = F.sort_array(F.collect_list(F.when(c("rank") <= MOST_ERRORS, F.struct("rank", "url", "error"))))
    return ranked.groupBy("site_id").agg(F.count("*").alias("failed_requests"), first.alias("errors")).withColumn("errors", F.transform("errors", lambda e: F.struct(e["url"].alias("url"), e["error"].alias("error"))))


def pagespeed_metrics(body: Column) -> Column:
    """Metrics of a PageSpeed answer (JSON): what it displays, ``Unknown`` where it has none."""
    shown = lambda audit: F.nullif(F.get_json_object(body, f"$.lighthouseResult.audits['{audit}'].displayValue"), F.lit(""))
    there = F.coalesce(F.get_json_object(body, "$.lighthouseResult.audits").isNotNull(), F.lit(False))
    return F.struct(there.alias("available"), *(F.coalesce(*map(shown, audits), F.lit("Unknown")).alias(name) for name, audits in METRICS.items()))
