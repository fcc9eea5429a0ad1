"""Audit requests: the first rule that a request breaks, and the input that a valid one stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.functions import urls
from lumenaudit.operators.competitors import competitor_list

c = F.col
# Least, most and default of each limit.
LIMITS = {"max_pages": (1, 250, 250), "max_duration_ms": (60_000, 300_000, 150_000), "max_competitor_pages": (1, 75, 25)}
# Names of fields in messages, and their longest values.
NAMES = {"company_name": "companyName", "industry": "industry", "city": "city", "max_pages": "maxPages", "max_duration_ms": "maxDurationMs", "max_competitor_pages": "maxCompetitorPages"}
MOST_URL, MOST_FIELD, MOST_COMPETITOR_TEXT, MOST_COMPETITORS = 2048, 200, 5000, 20


def validated(requests: DataFrame) -> DataFrame:
    """Adds ``error``, null for a valid request.

    requests: ``url, company_name, industry, city`` (strings), ``competitors`` (as typed) or ``competitor_urls`` (an array), and the limits as doubles, each null where not given."""
    rules = [(F.coalesce(c("url"), F.lit("")) == "", "A website URL or domain is required"), (tx.js_length(c("url")) > MOST_URL, "The website URL is too long")]
    rules += [(tx.js_length(c(f)) > MOST_FIELD, f'"{NAMES[f]}" must be a string of at most {MOST_FIELD} characters') for f in ("company_name", "industry", "city")]
    rules += [(tx.js_length(c("competitors")) > MOST_COMPETITOR_TEXT, "The competitor list is too long"), (F.size("competitor_urls") > MOST_COMPETITORS, f"Provide at most {MOST_COMPETITORS} competitor URLs")]
    rules += [(F.isnan(f) | (F.abs(f) == float("inf")), f'"{NAMES[f]}" must be a number') for f in LIMITS]
    return requests.withColumn("error", F.coalesce(*(F.when(test, F.lit(said)) for test, said in rules)))


def normalized(requests: DataFrame) -> DataFrame:
    """Valid requests as audits take them: a full URL, empty strings for what isn't given, five competitors at most, limits within their bounds."""
    listed = F.slice(F.filter("competitor_urls", lambda u: F.coalesce(u, F.lit("")) != ""), 1, 5)
    limit = lambda f, low, high, usual: F.when(c(f).isNull(), float(usual)).otherwise(F.least(F.greatest(c(f), F.lit(float(low))), F.lit(float(high))))
    none = F.array().cast("array<string>")
    return validated(requests).where("error IS NULL").drop("error").withColumns(
        {"url": urls.normalized(c("url")), "competitors": F.coalesce(competitor_list(F.nullif("competitors", F.lit(""))), listed, none)}
        | {f: F.coalesce(f, F.lit("")) for f in ("company_name", "industry", "city")} | {f: limit(f, *bounds) for f, bounds in LIMITS.items()}
    ).drop("competitor_urls")
