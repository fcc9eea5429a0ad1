"""The whole audit as one plan: snapshot of pages in, scored sites with findings and plans out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions import urls
from lumenaudit.functions.text import cut_bytes, js_length
from lumenaudit.operators.findings import with_findings
from lumenaudit.operators.frontier import sitemap_tree
from lumenaudit.operators.pages import page_signals
from lumenaudit.operators.robots import bot_access
from lumenaudit.operators.robots import sitemaps as named_sitemaps
from lumenaudit.operators.scoring import score_sites
from lumenaudit.operators.sites import site_signals
from lumenaudit.sources.html_tokens import parse_pages
from lumenaudit.sources.storage import spread, stored

HEADERS = "map<string,string>"


def snapshot(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, url, html)`` as a crawl's: site, order of arrival, status and headers. No shuffle: html stays where it was read.

    ``ord`` is the order of a site's pages: by ``page_id``, those without one last, pages of one id by URL; repeated pages each count. Pages whose URL has no host belong to no site and are left out."""
    order = F.struct(F.col("page_id").isNull().alias("unnumbered"), "page_id", F.col("url"), F.monotonically_increasing_id().alias("row"))
    out = pages.select("page_id", "url", "html", urls.domain(F.col("url")).alias("site_id"), order.alias("ord")).where("site_id <> ''")
    out = out.withColumns({"requested_url": F.col("url"), "url": urls.canonical(F.col("url")), "status": F.lit(200), "headers": F.create_map().cast(HEADERS), "truncated": F.octet_length("html") > 900_000})
    return out.withColumn("start_url", F.concat(F.lit("https://"), "site_id", F.lit("/")))


ROBOTS_BYTES, LLMS_BYTES, SITEMAP_BYTES = 300_000, 500_000, 1_200_000


def auxiliary(sites: DataFrame, robots: DataFrame | None = None, llms: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """Sites ``(site_id, start_url)`` with what their auxiliary files say; files that aren't given, or that a site lacks, are taken as not found.

    robots, llms: ``site_id, body``; sitemaps: ``site_id, url, body``, the main one at ``/sitemap.xml`` of the site's origin. Bodies count up to their byte limits."""
    base = sites.withColumns({"city": F.lit(""), "origin": urls.origin(F.col("start_url"))})
    files = base.select("site_id", "origin")
    if robots is None:
        files, found = files.withColumn("body", F.lit("")), None
    else:
        robots = robots.select("site_id", cut_bytes(F.col("body"), ROBOTS_BYTES).alias("body"))
        files, found = files.join(robots, "site_id", "left"), robots.select("site_id", F.lit(True).alias("robots_found"))
    out = base.join(bot_access(files), "site_id", "left")
    if llms is not None:
        llms = llms.select("site_id", F.lit(True).alias("llms_found"), js_length(cut_bytes(F.coalesce("body", F.lit("")), LLMS_BYTES)).alias("llms_length"))
    if sitemaps is not None:
        docs = sitemaps.join(base.select("site_id", "origin"), "site_id").withColumn("body", cut_bytes(F.col("body"), SITEMAP_BYTES))
        main = base.select("site_id", F.concat("origin", F.lit("/sitemap.xml")).alias("url"))
        listed = None if robots is None else named_sitemaps(files).join(base.select("site_id", "origin"), "site_id").select("site_id", "url")
        pages = sitemap_tree(docs, main, listed=listed).groupBy("site_id").agg(F.count("*").cast("int").alias("sitemap_urls"))
        answered = docs.join(main, ["site_id", "url"]).select("site_id").distinct()
        sitemaps = answered.join(pages, "site_id", "full").select("site_id", F.lit(True).alias("sitemap_found"), F.coalesce("sitemap_urls", F.lit(0)).alias("sitemap_urls"))
    for part, columns in ((found, {"robots_found": False}), (llms, {"llms_found": False, "llms_length": 0}), (sitemaps, {"sitemap_found": False, "sitemap_urls": 0})):
        out = out.join(part, "site_id", "left") if part is not None else out.withColumns({k: F.lit(None) for k in columns})
        out = out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in columns.items()})
    return out.drop("origin")


def signals_of(pages: DataFrame) -> DataFrame:
    """Page signals of a snapshot, stored: html is read and parsed once, whatever reads the signals by column afterwards."""
    return stored(page_signals(parse_pages(spread(pages), ["page_id", "site_id", "ord", "url", "requested_url", "start_url", "status", "headers", "truncated"])))


def audit(signals: DataFrame, *, as_of_year: int, robots: DataFrame | None = None, pagespeed: DataFrame | None = None, llms: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """Scored sites with findings. robots, llms, sitemaps: as in ``auxiliary``. pagespeed: ``site_id, mobile, desktop, lighthouse_accessibility``."""
    sites = auxiliary(signals.select("site_id", "start_url").distinct(), robots, llms, sitemaps)
    out = site_signals(signals, sites, as_of_year=as_of_year).withColumn("domain", F.col("site_id"))
    if pagespeed is None:
        out = out.withColumns({c: F.lit(None).cast("int") for c in ("mobile", "desktop", "lighthouse_accessibility")})
    else:
        out = out.join(pagespeed, "site_id", "left")
    return with_findings(score_sites(out))


def example_site(spark: SparkSession, **changed) -> DataFrame:
    """One site's signals with plausible values, for tests and for queries on parts of the plan."""
    bots = {b: (True, f"{b}: allowed at /") for b in ("Googlebot", "OAI-SearchBot", "ChatGPT-User")}
    values = {
        "site_id": ("string", "example.com"), "domain": ("string", "example.com"), "start_url": ("string", "https://example.com"), "origin": ("string", "https://example.com"), "page_count": ("int", 20),
        "sitemap_found": ("boolean", True), "sitemap_urls": ("int", 40), "robots_found": ("boolean", True), "bots": ("map<string,struct<allowed:boolean,evidence:string>>", bots),
        "llms_found": ("boolean", True), "llms_useful": ("boolean", True), "llms_length": ("int", 900), "noindex_pages": ("int", 0), "schema_found": ("boolean", True), "schema_count": ("int", 12),
        "types": ("array<string>", ["Organization", "FAQPage"]), "schema_local_business": ("boolean", True), "schema_faq": ("boolean", True), "schema_product": ("boolean", False), "schema_service": ("boolean", True),
        "schema_article": ("boolean", True), "schema_breadcrumb": ("boolean", True), "schema_review": ("boolean", False), "schema_product_only": ("boolean", False), "schema_offer": ("boolean", False), "invalid_count": ("int", 0),
        "faq_pages": ("int", 1), "service_pages": ("int", 3), "product_pages": ("int", 1), "comparison_pages": ("int", 1), "location_pages": ("int", 0), "topical_depth": ("int", 10), "has_direct_answers": ("boolean", True),
        "has_process": ("boolean", True), "has_pricing": ("boolean", True), "has_freshness": ("boolean", True), "about_url": ("string", "https://example.com/about"), "contact_url": ("string", "https://example.com/contact"),
        "same_as": ("array<string>", ["https://linkedin.com/x", "https://youtube.com/x"]), "has_credentials": ("boolean", True), "has_case_studies": ("boolean", True), "has_author": ("boolean", True), "trust_pages": ("int", 1),
        "phone_count": ("int", 1), "email_count": ("int", 0), "title_coverage": ("double", 1.0), "description_coverage": ("double", 0.9), "h1_coverage": ("double", 0.9), "duplicate_titles": ("int", 0), "duplicate_descriptions": ("int", 0),
        "average_words": ("int", 500), "mobile": ("int", None), "desktop": ("int", None), "lighthouse_accessibility": ("int", None), "average_alt": ("double", 0.9), "form_coverage": ("double", 1.0), "landmark_pages": ("int", 10),
        "likely_ecommerce": ("boolean", False), "has_reviews": ("boolean", False), "has_shipping_returns": ("boolean", False), "likely_saas": ("boolean", False), "has_pricing_page": ("boolean", False), "has_docs": ("boolean", False),
        "has_integrations": ("boolean", False), "has_security_trust": ("boolean", False), "has_customer_pages": ("boolean", False), "city": ("string", ""), "city_mentioned": ("boolean", False), "has_address": ("boolean", False),
        "has_hours": ("boolean", False), "has_service_area": ("boolean", False), "has_https": ("boolean", True), "has_hsts": ("boolean", True), "has_csp": ("boolean", False), "has_frame_protection": ("boolean", True),
        "has_nosniff": ("boolean", True), "has_referrer_policy": ("boolean", False),
    }
    row = {k: changed.get(k, v) for k, (_, v) in values.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, (t, _) in values.items()))
