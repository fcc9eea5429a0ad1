"""Site signals: pages aggregated by site in one shuffle. ``ord`` is the order of arrival within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.functions import urls
from lumenaudit.operators.site_flags import city_mentions, site_flags
from lumenaudit.operators.sites_text import TEXT_FLAGS, WORD_END, WORD_START, freshness
from lumenaudit.sources.storage import stored

# Schema types that count for a fact.
TYPE_FLAGS = {
    "schema_local_business": "LocalBusiness|Organization|ProfessionalService|Store|Restaurant|MedicalBusiness|LegalService",
    "schema_faq": "FAQPage", "schema_product": "Product|Offer|AggregateOffer", "schema_service": "Service", "schema_article": "Article|BlogPosting|NewsArticle",
    "schema_breadcrumb": "BreadcrumbList", "schema_review": "Review|AggregateRating", "schema_product_only": "Product", "schema_offer": "Offer",
}
# What marks comparison, trust and customer pages.
COMPARISON = f"compare|comparison|versus|{WORD_START}vs{WORD_END}|alternative"
TRUST = "case|testimonial|review|customer|portfolio|press|award|certification|security|privacy"
CUSTOMERS = "case-study|case-studies|customers"
MOST_PROFILES = 30


def in_order(value: Column, most: int | None = None) -> Column:
    """The values of a group by ``ord``, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), value.alias("v"))))
    out = F.transform(rows, lambda r: r["v"])
    return F.slice(out, 1, most) if most else out


def home_page(pages: DataFrame) -> DataFrame:
    """The home page of each site: the start URL, else a root path, else the first page."""
    c = F.col
    rank = F.when((c("url") == urls.canonical(c("start_url"))) | (c("requested_url") == urls.canonical(c("start_url"))), 0).when(urls.path(c("url")) == "/", 1).otherwise(2)
    return pages.groupBy("site_id").agg(F.min_by(F.struct("url", "headers", "page_id"), F.struct(rank.alias("r"), c("ord").alias("o"))).alias("home"))


def duplicates_by_site(pages: DataFrame, column: str, name: str) -> DataFrame:
    """How many different values of a site, but for case, occur more than once; blanks don't count. One shuffle by site and value."""
    low = pages.where(F.col(column) != "").groupBy("site_id", F.lower(column).alias("v")).count()
    return low.where("count > 1").groupBy("site_id").agg(F.count("*").cast("int").alias(name))


def _distinct(pages: DataFrame, values: Column) -> DataFrame:
    """``site_id, value, at``: the distinct values of a site's arrays, with the place of the first."""
    rows = pages.select("site_id", "ord", F.posexplode(values).alias("k", "value"))
    return rows.groupBy("site_id", "value").agg(F.min(F.struct("ord", "k")).alias("at"))


def distinct_values(pages: DataFrame) -> list[DataFrame]:
    """``types, same_as, phone_count, email_count`` by site. A page's values meet only equal ones; of a site's, only what its row shows comes together: its types, and its first thirty profiles."""
    shown = lambda rows, name: rows.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]).alias(name))
    counted = lambda column, name: _distinct(pages, F.col(column)).groupBy("site_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    profiles = _distinct(pages, F.col("same_as")).withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("at"))).where(F.col("rank") <= MOST_PROFILES)
    return [shown(_distinct(pages, F.flatten("nodes.types")), "types"), shown(profiles, "same_as"), counted("phones", "phone_count"), counted("emails", "email_count")]


def site_signals(pages: DataFrame, sites: DataFrame, *, as_of_year: int) -> DataFrame:
    """One row per site.

    pages: page signals with ``site_id, ord, start_url, requested_url, headers``. sites: ``site_id, start_url, city, robots_found,
    bots (map of bot to allowed and evidence), llms_found, llms_length, sitemap_found, sitemap_urls``. Sites without pages keep a row of neutral values.
    """
    c = F.col
    count = lambda test: F.count_if(test).cast("int")
    ratio = lambda n: F.when(c("page_count") > 0, c(n) / c("page_count")).otherwise(F.lit(0.0))
    # the text that comparisons are looked up in, folded once for its several uses
    told = pages.withColumn("__told", F.concat_ws(" ", "url", "title", "text")).withColumn("__low", tx.folded(c("__told")))
    agg = told.groupBy("site_id").agg(
        count(F.lit(True)).alias("page_count"),
        F.sum(F.size("nodes")).cast("int").alias("schema_count"),
        F.sum(F.size("invalid")).cast("int").alias("invalid_count"),
        count(c("has_visible_faq") | tx.matches(c("url"), "faq")).alias("faq_pages"),
        count(c("content_type") == "service").alias("service_pages"), count(c("content_type") == "product").alias("product_pages"),
        count(c("content_type") == "location").alias("location_pages"), count(c("content_type") == "education").alias("education_pages"),
        count(tx.mentions(c("__told"), c("__low"), COMPARISON)).alias("comparison_pages"),
        count(tx.matches(F.concat_ws(" ", "url", "title"), TRUST)).alias("trust_pages"),
        F.bool_or(c("content_type") == "pricing").alias("has_pricing_page"), F.bool_or(c("content_type") == "docs").alias("has_docs"),
        F.bool_or(tx.matches(c("url"), CUSTOMERS)).alias("has_customer_pages"),
        F.min_by(F.when(c("content_type") == "about", c("url")), F.when(c("content_type") == "about", c("ord"))).alias("about_url"),
        F.min_by(F.when(c("content_type") == "contact", c("url")), F.when(c("content_type") == "contact", c("ord"))).alias("contact_url"),
        count(~c("indexable")).alias("noindex_pages"), count(c("title") != "").alias("titled"), count(c("meta_description") != "").alias("described"),
        count(c("h1_count") == 1).alias("single_h1"), F.avg("alt_ratio").alias("alt"), F.avg(c("likely_labeled").cast("double")).alias("labeled"),
        count(c("has_landmarks")).alias("landmark_pages"), F.avg(c("word_count").cast("double")).alias("mean_words"),
    )
    flags = TEXT_FLAGS | {"has_freshness": freshness(as_of_year)}
    mentioned = city_mentions(pages, sites).withColumn("city_mentioned", F.lit(True))
    joined = sites.join(agg, "site_id", "left").join(duplicates_by_site(pages, "title", "duplicate_titles"), "site_id", "left").join(duplicates_by_site(pages, "meta_description", "duplicate_descriptions"), "site_id", "left")
    joined = joined.join(home_page(pages), "site_id", "left").join(site_flags(pages, flags), "site_id", "left").join(mentioned, "site_id", "left")
    for part in distinct_values(pages):
        joined = joined.join(part, "site_id", "left")
    joined = stored(joined)  # a row a site: the joins are planned without the many expressions that read them
    numbers = [n for n, t in agg.dtypes if t == "int"] + ["duplicate_titles", "duplicate_descriptions", "phone_count", "email_count"]
    joined = joined.fillna(0, numbers).fillna(False, ["has_pricing_page", "has_docs", "has_customer_pages", "city_mentioned", *flags])
    none = F.array().cast("array<string>")
    # a site without pages has no profiles, one whose pages lack them an empty list of them
    out = joined.withColumns({"types": F.coalesce("types", none), "same_as": F.when(c("page_count") > 0, F.coalesce("same_as", none))})
    out = out.withColumns({k: F.exists("types", lambda t: tx.matches(t, p)) for k, p in TYPE_FLAGS.items()})
    header = lambda k: F.coalesce(c("home.headers")[k], F.lit(""))
    city = F.coalesce(c("city"), F.lit(""))
    return out.withColumns({
        "schema_found": c("schema_count") > 0, "topical_depth": c("service_pages") + c("product_pages") + c("education_pages") + c("comparison_pages"),
        "likely_ecommerce": c("ecommerce_words") | c("schema_product"), "has_reviews": c("review_words") | c("schema_review"),
        "city": city,
        "title_coverage": ratio("titled"), "description_coverage": ratio("described"), "h1_coverage": ratio("single_h1"),
        "average_alt": F.coalesce("alt", F.lit(1.0)), "form_coverage": F.coalesce("labeled", F.lit(1.0)),
        "average_words": F.coalesce(tx.rounded(c("mean_words")), F.lit(0)),
        "llms_useful": F.coalesce("llms_length", F.lit(0)) > 250,
        "has_https": F.coalesce(c("home.url").startswith("https://"), F.lit(False)), "has_hsts": header("strict-transport-security") != "",
        "has_csp": header("content-security-policy") != "", "has_frame_protection": (header("x-frame-options") != "") | F.contains(header("content-security-policy"), F.lit("frame-ancestors")),
        "has_nosniff": header("x-content-type-options") == "nosniff", "has_referrer_policy": header("referrer-policy") != "",
        "origin": urls.origin(c("start_url")),
    }).drop("chars", "alt", "labeled", "mean_words", "home", "titled", "described", "single_h1", "ecommerce_words", "review_words")
