"""Queries over sites whose every signal varies, so that each check, score and finding takes all its values; their SQL states the checks a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.operators import compat, competitors, requests, responses, tasks
from lumenaudit.operators.findings import exploded, with_findings
from lumenaudit.operators.scoring import ORDER, score_sites
from lumenaudit.plans.registry import DOMAIN, c, plan_pages, query
from lumenaudit.sources.storage import spread, stored
from lumenaudit.sources.tables import table

# Signals of the site of a customer, in SQL of both engines. k: the customer's key.
INT = {
    "page_count": "k % 23", "sitemap_urls": "k % 41", "llms_length": "k % 907", "noindex_pages": "k % 4 * (k % 3 % 2)", "schema_count": "k % 17", "invalid_count": "k % 5 % 3", "faq_pages": "k % 3", "service_pages": "k % 6",
    "product_pages": "k % 7 % 5", "comparison_pages": "k % 13 % 2", "topical_depth": "k % 11", "location_pages": "k % 19 % 2", "trust_pages": "k % 5", "phone_count": "k % 8 % 3", "email_count": "k % 9 % 2",
    "duplicate_titles": "k % 10 % 3", "duplicate_descriptions": "k % 12 % 5", "average_words": "k * 7 % 500", "landmark_pages": "k % 29 % 3", "mobile": "CASE WHEN k % 4 > 0 THEN k * 13 % 101 END", "desktop": "CASE WHEN k % 8 > 1 THEN k * 17 % 101 END",
    "lighthouse_accessibility": "CASE WHEN k % 5 > 0 THEN k * 19 % 101 END",
}
FLAG = {
    "sitemap_found": "k % 3 > 0", "robots_found": "k % 4 > 0", "google": "k % 13 > 0", "searchbot": "k % 7 > 1", "chatgpt": "k % 6 > 0", "llms_found": "k % 5 < 3", "llms_useful": "k % 907 > 250", "schema_found": "k % 17 > 0",
    "schema_local_business": "k % 2 = 0", "schema_faq": "k % 5 = 1", "schema_product": "k % 9 = 2", "schema_service": "k % 4 = 3", "schema_article": "k % 3 = 1", "schema_breadcrumb": "k % 7 > 2", "schema_review": "k % 6 = 5",
    "schema_product_only": "k % 18 = 2", "schema_offer": "k % 27 = 2", "has_direct_answers": "k % 5 > 1", "has_process": "k % 8 > 3", "has_pricing": "k % 9 > 3", "has_freshness": "k % 10 > 4", "has_credentials": "k % 11 > 5",
    "has_case_studies": "k % 12 > 4", "has_author": "k % 3 = 2", "likely_ecommerce": "k % 5 = 2", "has_reviews": "k % 4 = 1", "has_shipping_returns": "k % 7 = 3", "likely_saas": "k % 6 = 4", "has_pricing_page": "k % 4 = 0",
    "has_docs": "k % 5 = 4", "has_integrations": "k % 8 = 2", "has_security_trust": "k % 9 = 4", "has_customer_pages": "k % 7 = 5", "city_mentioned": "k % 14 = 3", "has_address": "k % 10 = 1", "has_hours": "k % 6 = 1",
    "has_service_area": "k % 15 = 7", "has_https": "k % 8 > 0", "has_hsts": "k % 3 = 0", "has_csp": "k % 4 = 2", "has_frame_protection": "k % 5 < 4", "has_nosniff": "k % 7 < 4", "has_referrer_policy": "k % 9 < 5",
}
RATIO = {"title_coverage": "k % 21", "description_coverage": "k * 3 % 21", "h1_coverage": "k * 5 % 21", "average_alt": "k * 11 % 21", "form_coverage": "k * 13 % 21"}
TEXT = {
    "site_id": "concat('site', k, '.example')", "start_url": "concat('https://site', k, '.example/')", "origin": "concat('https://site', k, '.example')", "city": "CASE WHEN k % 9 = 4 THEN 'Springfield' ELSE '' END",
    "about_url": "CASE WHEN k % 5 > 0 THEN concat('https://site', k, '.example/about') END", "contact_url": "CASE WHEN k % 6 > 1 THEN concat('https://site', k, '.example/contact') END",
    "company_name": "CASE WHEN k % 3 = 0 THEN '' ELSE c_name END", "industry": "CASE WHEN k % 4 = 0 THEN '' ELSE c_mktsegment END", "type_list": "CASE WHEN k % 2 = 0 THEN 'Organization' ELSE '' END",
}
MADE_LIST = [*(f"CAST({e} AS INT) AS {n}" for n, e in INT.items()), *(f"({e}) AS {n}" for n, e in FLAG.items()), *(f"CAST({e} AS DOUBLE) / 20 AS {n}" for n, e in RATIO.items()), *(f"{e} AS {n}" for n, e in TEXT.items()), "CAST(k % 4 AS INT) AS profiles"]
MADE = ", ".join(MADE_LIST)


def varied_sites(spark: SparkSession, sf: str) -> DataFrame:
    made = spread(table(spark, sf, "customer")).selectExpr("*", "c_custkey AS k").selectExpr("k", *MADE_LIST)
    bot = lambda name, ok: F.struct(c(ok).alias("allowed"), F.concat(F.lit(f"{name}: "), F.when(c(ok), "allowed").otherwise("blocked")).alias("evidence"))
    bots = F.map_from_arrays(F.array(*map(F.lit, ("Googlebot", "OAI-SearchBot", "ChatGPT-User"))), F.array(bot("Googlebot", "google"), bot("OAI-SearchBot", "searchbot"), bot("ChatGPT-User", "chatgpt")))
    profile = F.transform(F.sequence(F.lit(1), F.greatest(c("profiles"), F.lit(1))), lambda n: F.concat(F.lit("https://profile.example/"), n.cast("string")))
    none = F.array().cast("array<string>")
    return made.withColumns({"domain": c("site_id"), "bots": bots, "types": F.filter(F.array("type_list"), lambda t: t != ""), "same_as": F.when(c("profiles") > 0, profile).otherwise(none)}).drop("google", "searchbot", "chatgpt", "type_list", "profiles")


# The checks once more, by points and SQL of DuckDB: a condition, r:ratio or n:number of 100.
POINTS = {
    "crawlability": [(12, "page_count >= 10"), (14, "sitemap_found"), (8, "robots_found"), (18, "google"), (16, "searchbot"), (8, "chatgpt"), (8, "llms_found AND llms_useful"), (16, "noindex_pages = 0")],
    "structured_data": [(18, "schema_found"), (12, "schema_local_business"), (18, "schema_service OR schema_product"), (14, "schema_faq OR schema_article"), (8, "schema_breadcrumb"), (10, "schema_review"), (20, "invalid_count = 0")],
    "answer_readiness": [(18, "faq_pages > 0 OR schema_faq"), (18, "has_direct_answers"), (18, "topical_depth >= 8"), (14, "service_pages + product_pages >= 3"), (10, "comparison_pages > 0"), (10, "has_process"), (6, "has_pricing"), (6, "has_freshness")],
    "entity_trust": [(14, "about_url IS NOT NULL"), (14, "contact_url IS NOT NULL"), (12, "profiles >= 2"), (16, "has_credentials"), (16, "has_case_studies"), (12, "has_author"), (16, "phone_count > 0 OR email_count > 0")],
    "technical_seo": [(16, "r:title_coverage"), (14, "r:description_coverage"), (12, "r:h1_coverage"), (10, "duplicate_titles = 0"), (8, "duplicate_descriptions = 0"), (10, "sitemap_found"), (12, "noindex_pages = 0"), (10, "average_words >= 250"), (8, "schema_breadcrumb")],
    "page_experience": [(35, "n:mobile"), (25, "n:desktop"), (15, "r:average_alt"), (10, "r:form_coverage"), (15, "has_https")],
    "ecommerce": [(20, "product_pages >= 3"), (22, "schema_product_only"), (18, "schema_offer"), (20, "has_reviews"), (20, "has_shipping_returns")],
    "saas": [(20, "has_pricing_page"), (18, "has_docs"), (18, "has_integrations"), (22, "has_security_trust"), (22, "has_customer_pages")],
    "local": [(18, "city_mentioned"), (18, "phone_count > 0"), (18, "has_address"), (14, "has_hours"), (14, "has_service_area"), (18, "location_pages > 0 OR schema_local_business")],
    "general": [(20, "about_url IS NOT NULL"), (20, "contact_url IS NOT NULL"), (25, "topical_depth >= 6"), (20, "trust_pages > 0"), (15, "has_pricing OR has_process")],
    "security": [(25, "has_https"), (15, "has_hsts"), (20, "has_csp"), (15, "has_frame_protection"), (15, "has_nosniff"), (10, "has_referrer_policy")],
    "accessibility": [(45, "n:lighthouse_accessibility"), (25, "r:average_alt"), (20, "r:form_coverage"), (10, "landmark_pages > 0")],
}


def _points(n: int, rule: str) -> str:
    if rule.startswith("r:"):
        return f"floor({rule[2:]} * {n} + 0.5)"
    if rule.startswith("n:"):
        return f"CASE WHEN {rule[2:]} IS NULL THEN floor({n} * 0.55 + 0.5) ELSE floor({rule[2:]}::DOUBLE / 100 * {n} + 0.5) END"
    return f"CASE WHEN {rule} THEN {n} ELSE 0 END"


def _passed(rule: str) -> str:
    return f"CASE WHEN {rule[2:]} >= 0.85 THEN 1 ELSE 0 END" if rule.startswith("r:") else f"CASE WHEN {rule[2:]} >= 80 THEN 1 ELSE 0 END" if rule.startswith("n:") else f"CASE WHEN {rule} THEN 1 ELSE 0 END"


def _sums(name: str, part) -> str:
    """Sums over the checks of each category, the vertical's own for the last."""
    by_kind = {k: "(" + " + ".join(part(n, r) for n, r in v) + ")" for k, v in POINTS.items()}
    own = f"CASE vertical {' '.join(f'WHEN {k!r} THEN {by_kind[k]}' for k in ('ecommerce', 'saas', 'local'))} ELSE {by_kind['general']} END"
    return ", ".join(f"({own if k == 'vertical_readiness' else by_kind[k]})::INT AS {name}{k}" for k in ORDER)


# each category's points add up to 100
VARIED = f"""WITH v AS (SELECT k, {MADE} FROM (SELECT *, c_custkey AS k FROM customer)),
w AS (SELECT *, CASE WHEN likely_ecommerce THEN 'ecommerce' WHEN likely_saas THEN 'saas' WHEN city <> '' OR city_mentioned OR has_address OR has_service_area THEN 'local' ELSE 'general' END AS vertical FROM v),
p AS (SELECT *, {_sums('', _points)}, {_sums('passed_', lambda n, r: _passed(r))} FROM w),
a AS (SELECT *, floor(crawlability * 0.15::DOUBLE + structured_data * 0.15::DOUBLE + answer_readiness * 0.2::DOUBLE + entity_trust * 0.15::DOUBLE + technical_seo * 0.15::DOUBLE + page_experience * 0.1::DOUBLE + vertical_readiness * 0.1::DOUBLE + 0.5)::INT AS overall,
floor(crawlability * 0.18::DOUBLE + structured_data * 0.22::DOUBLE + answer_readiness * 0.25::DOUBLE + entity_trust * 0.2::DOUBLE + vertical_readiness * 0.15::DOUBLE + 0.5)::INT AS aeo_geo,
floor(technical_seo * 0.55::DOUBLE + crawlability * 0.2::DOUBLE + structured_data * 0.15::DOUBLE + page_experience * 0.1::DOUBLE + 0.5)::INT AS seo FROM p),
s AS (SELECT *, floor(aeo_geo * 0.75::DOUBLE + entity_trust * 0.15::DOUBLE + crawlability * 0.1::DOUBLE + 0.5)::INT AS ai_readiness FROM a)"""

PERCENT = "floor({} * 100 + 0.5)::INT || '%'"
KNOWN = "CASE WHEN {} THEN 'found' ELSE 'missing' END"
TYPES = "CASE WHEN type_list = '' THEN 'No schema types found' ELSE type_list END"
# The findings once more: condition, category, severity, slug, impact, evidence.
FOUND = [
    ("NOT searchbot", "GEO/AEO", "high", "geo-aeo-chatgpt-search-crawler-appears-blocked", 16, "'OAI-SearchBot: blocked'"),
    ("NOT llms_found", "GEO/AEO", "medium", "geo-aeo-no-llms-txt-file-found", 8, "'GET /llms.txt did not return a usable file'"),
    ("NOT schema_found", "Structured Data", "high", "structured-data-no-structured-data-found", 18, "'No application/ld+json blocks were found in crawled pages'"),
    ("topical_depth < 4", "Content", "high", "content-thin-topical-coverage-for-ai-answer-engines", 18, "topical_depth || ' topical pages detected across ' || page_count || ' crawled pages'"),
    ("NOT has_direct_answers", "AEO", "medium", "aeo-few-extractable-direct-answers", 18, "'Direct-answer phrase patterns were not detected in crawled text'"),
    ("about_url IS NULL OR NOT has_credentials", "Entity Trust", "medium", "entity-trust-weak-entity-and-trust-signals", 16, f"'About page: ' || {KNOWN.format('about_url IS NOT NULL')} || ', credentials: ' || {KNOWN.format('has_credentials')}"),
    ("title_coverage < 0.85 OR description_coverage < 0.75", "SEO", "medium", "seo-metadata-coverage-is-incomplete", 14, f"{PERCENT.format('title_coverage')} || ' title coverage, ' || {PERCENT.format('description_coverage')} || ' description coverage'"),
    ("mobile < 50", "Performance", "medium", "performance-mobile-performance-is-weak", 20, "'Mobile PageSpeed score: ' || mobile || '/100'"),
    ("mobile IS NULL AND desktop IS NULL", "Performance", "low", "performance-pagespeed-data-unavailable", 0, "'PageSpeed API returned no Lighthouse result'"),
    ("vertical = 'ecommerce' AND NOT schema_product_only", "Ecommerce", "high", "ecommerce-product-schema-is-missing-or-incomplete", 22, TYPES),
    ("vertical = 'saas' AND (NOT has_pricing_page OR NOT has_security_trust)", "SaaS", "medium", "saas-saas-evaluation-content-is-incomplete", 20, "'Pricing: ' || has_pricing_page || ', docs: ' || has_docs || ', security: ' || has_security_trust"),
    ("vertical = 'local' AND (NOT has_address OR NOT has_hours)", "Local SEO", "medium", "local-seo-local-business-signals-are-incomplete", 18, "'Address: ' || has_address || ', hours: ' || has_hours || ', service area: ' || has_service_area"),
]
FOUND_SQL = VARIED + ", r AS (" + " UNION ALL ".join(
    f"SELECT site_id, {n} AS o, '{severity}' AS severity, '{slug}' AS id, '{kind}' AS category, {impact} AS score_impact, {evidence} AS evidence FROM s WHERE {test}" for n, (test, kind, severity, slug, impact, evidence) in enumerate(FOUND)
) + "), f AS (SELECT *, (row_number() OVER (PARTITION BY site_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o) - 1)::INT AS ord FROM r)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored sites with findings. The signals are stored, from all cores; scores and findings are expressions, of which a query computes what it reads."""
    return with_findings(score_sites(stored(varied_sites(spark, sf))))


SCORES = ("overall", "aeo_geo", "seo", "ai_readiness")


@query(VARIED + f" SELECT site_id, vertical, {', '.join(ORDER)}, {', '.join(SCORES)} FROM s")
def varied_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("site_id", "vertical", *ORDER, *SCORES)


@query(VARIED + f" SELECT site_id, {', '.join(f'passed_{k}' for k in ORDER)} FROM s")
def varied_passed_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Passed checks of each category."""
    passed = lambda k: F.size(F.filter(compat.category(k)["checks"], lambda x: x["status"] == "passed")).alias(f"passed_{k}")
    return scored(spark, sf).select("site_id", *map(passed, ORDER))


@query(FOUND_SQL + " SELECT site_id, ord, id, category, severity, score_impact, evidence FROM f")
def varied_findings(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(scored(spark, sf)).select("site_id", "ord", "id", "category", "severity", "score_impact", "evidence")


@query(FOUND_SQL + """, n AS (SELECT site_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS high, string_agg(id, '|' ORDER BY ord) FILTER (WHERE category IN ('GEO/AEO', 'AEO')) AS ai,
string_agg(id, '|' ORDER BY ord) FILTER (WHERE category IN ('GEO/AEO', 'AEO', 'Content', 'Entity Trust', 'Structured Data')) AS aeo FROM f GROUP BY 1)
SELECT site_id, CASE WHEN security >= 90 THEN 'A' WHEN security >= 80 THEN 'B' WHEN security >= 70 THEN 'C' WHEN security >= 60 THEN 'D' ELSE 'F' END AS security_grade,
CASE WHEN security >= 80 THEN 'Strong baseline security headers.' ELSE 'Security headers need improvement.' END AS security_summary,
CASE WHEN overall >= 80 THEN 'Strong' WHEN overall >= 60 THEN 'Developing' ELSE 'Needs Work' END AS band, CASE WHEN overall >= 75 THEN 'good' WHEN overall >= 55 THEN 'fair' ELSE 'poor' END AS tone, aeo_geo >= 70 AS would_recommend,
CASE WHEN aeo_geo >= 80 THEN 'Strong' WHEN aeo_geo >= 60 THEN 'Moderate' ELSE 'Weak' END AS prediction,
CASE WHEN industry <> '' AND city <> '' THEN '"Best ' || industry || ' in ' || city || '"' ELSE '"Best provider for this category"' END AS test_query,
'For ' || CASE WHEN industry = '' THEN 'this category' ELSE industry END || CASE WHEN city = '' THEN '' ELSE ' in ' || city END || ', AI visibility' AS insight,
CASE WHEN company_name = '' THEN site_id ELSE company_name END || ' scored ' || overall || '/100 overall and ' || aeo_geo || '/100 for GEO/AEO readiness. The audit crawled ' || page_count || ' pages and found ' || coalesce(n, 0) || ' prioritized findings with supporting evidence.' AS executive_summary,
passed_technical_seo AS seo_passed, 9 - passed_technical_seo AS seo_failed, crawlability >= 70 AS good_crawl, vertical_readiness >= 70 AS good_vertical, average_alt >= 0.85 AS alt_text, landmark_pages > 0 AS landmarks,
concat_ws('|', """ + ", ".join(f"CASE WHEN {k} >= 80 THEN 'good' WHEN {k} >= 55 THEN 'partial' ELSE 'missing' END" for k in compat.AEO_CATEGORIES) + """) AS statuses,
least(5, coalesce(n, 0))::INT AS n_top, coalesce(high, 0)::INT AS n_high, least(4, coalesce(n, 0))::INT AS n_roadmap FROM s LEFT JOIN n USING (site_id)""")
def compat_response(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    r = compat.response(s, F.size(compat.of_severity(c("findings"), "high")).alias("n_high"))
    return r.select(
        "site_id", "security_grade", "security_summary", "band", "tone", "would_recommend", F.substring_index("prediction", " ", 1).alias("prediction"), "test_query",
        F.regexp_extract("industry_insight", "^(.*, AI visibility)", 1).alias("insight"), "executive_summary", "seo_passed", "seo_failed", c("aeo_checks.crawlability").alias("good_crawl"), c("aeo_checks.vertical_readiness").alias("good_vertical"),
        c("accessibility_checks.alt_text").alias("alt_text"), c("accessibility_checks.landmarks").alias("landmarks"), F.array_join("aeo_detailed.status", "|").alias("statuses"), F.size("top_issues").alias("n_top"), "n_high",
        F.size(F.flatten("roadmap.actions")).alias("n_roadmap"),
    )


@query(FOUND_SQL + """ SELECT site_id, coalesce(len(list(id) FILTER (WHERE category IN ('GEO/AEO', 'AEO'))), 0)::INT AS ai_issues, coalesce(len(list(id) FILTER (WHERE category IN ('GEO/AEO', 'AEO', 'Content', 'Entity Trust', 'Structured Data'))), 0)::INT AS aeo_issues,
coalesce(len(list(id) FILTER (WHERE category = 'SEO')), 0)::INT AS seo_issues FROM f GROUP BY 1""")
def issues_by_category(spark: SparkSession, sf: str) -> DataFrame:
    r = compat.response(scored(spark, sf)).where(F.size("opportunities") > 0)
    return r.select("site_id", *(F.size(k).alias(k) for k in ("ai_issues", "aeo_issues", "seo_issues")))


@query(FOUND_SQL + """, n AS (SELECT site_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high' AND ord < 8) AS high FROM f GROUP BY 1)
SELECT site_id, greatest(1, least(8, coalesce(n, 0)))::BIGINT AS general, least(28, CASE vertical WHEN 'local' THEN 60 ELSE 59 END - (""" + " + ".join(f"passed_{k}" for k in ORDER) + """))::BIGINT AS category, coalesce(high, 0)::BIGINT AS high FROM s LEFT JOIN n USING (site_id)""")
def action_plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of each part of the plan, after their limits, and general ones of high impact."""
    s = stored(scored(spark, sf).select("site_id", "categories", "findings"))
    general, category = tasks.general_tasks(s), tasks.category_tasks(s)
    n = general.groupBy("site_id").agg(F.count("*").alias("general"), F.count_if(c("impact") == "High").alias("high"))
    return n.join(category.groupBy("site_id").agg(F.count("*").alias("category")), "site_id").select("site_id", "general", "category", "high")


@query(VARIED + """ SELECT site_id, json_object('company', CASE WHEN company_name = '' THEN site_id ELSE company_name END, 'pages', page_count, 'overall', overall, 'schema', schema_count, 'llms', llms_found)::VARCHAR AS bundle FROM s""")
def evidence_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle's facts read back from its JSON."""
    j = compat.evidence(stored(scored(spark, sf))).select("site_id", F.from_json("evidence", "company_name string, crawl struct<pages:int,llms_found:boolean>, scores struct<overall:int>, schema struct<count:int>").alias("j"))
    return j.select("site_id", F.to_json(F.struct(c("j.company_name").alias("company"), c("j.crawl.pages").alias("pages"), c("j.scores.overall").alias("overall"), c("j.schema.count").alias("schema"), c("j.crawl.llms_found").alias("llms"))).alias("bundle"))


@query(VARIED + """, q AS (SELECT site_id, k, overall, aeo_geo, schema_count, faq_pages, topical_depth, trust_pages, page_count, CASE WHEN k % 19 = 0 THEN 'Crawl failed: timeout' END AS error FROM s),
j AS (SELECT q.*, d.overall AS o2, d.aeo_geo AS a2, d.schema_count AS s2, d.faq_pages AS f2, d.topical_depth AS t2, d.trust_pages AS r2, d.site_id AS other, q.error IS NOT NULL OR coalesce(d.page_count, 0) = 0 AS failed FROM q LEFT JOIN q d ON d.k = q.k + 1)
SELECT site_id, coalesce(other, 'site' || (k + 1) || '.example') AS domain, CASE WHEN failed THEN coalesce(error, 'The crawl returned no usable pages') END AS error, CASE WHEN NOT failed THEN o2 END AS overall, CASE WHEN NOT failed THEN a2 - aeo_geo END AS score_diff,
CASE WHEN failed THEN '' ELSE concat_ws('|', CASE WHEN s2 > schema_count THEN 'Schema coverage: competitor has ' || s2 || ', audited site has ' || schema_count END, CASE WHEN f2 > faq_pages THEN 'FAQ pages: competitor has ' || f2 || ', audited site has ' || faq_pages END,
CASE WHEN t2 > topical_depth THEN 'Topical depth: competitor has ' || t2 || ', audited site has ' || topical_depth END, CASE WHEN r2 > trust_pages THEN 'Trust pages: competitor has ' || r2 || ', audited site has ' || trust_pages END) END AS gaps,
CASE WHEN failed THEN 0 ELSE (s2 < schema_count)::INT + (f2 < faq_pages)::INT + (t2 < topical_depth)::INT + (r2 < trust_pages)::INT END AS n_advantages FROM j""")
def varied_competitors(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(scored(spark, sf).drop("categories", "findings"))
    host = F.concat(F.lit("site"), (c("k") + 1).cast("string"), F.lit(".example"))
    failed = competitors.failure(F.when(c("k") % 19 == 0, "timeout"), F.lit(False))
    pairs = s.select("site_id", host.alias("competitor_id"), F.lit("").alias("name"), host.alias("url"), F.when(c("k") % 19 == 0, failed).alias("error"), F.lit(0).alias("ord"))
    got = competitors.compare(pairs, s)
    return got.select("site_id", "domain", "error", "overall", "score_diff", F.array_join("gaps", "|").alias("gaps"), F.size("advantages").alias("n_advantages"))


def audit_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = c("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 6 == 0, F.lit(None)).when(k % 11 == 0, F.repeat(F.lit("x"), 3000)).otherwise(F.concat(F.lit("Site"), k.cast("string"), F.lit(".example/a#b"))).alias("url"),
        F.when(k % 7 == 0, F.repeat("c_name", 20)).otherwise(c("c_name")).alias("company_name"), F.when(k % 3 == 0, c("c_mktsegment")).alias("industry"), F.when(k % 13 == 0, F.repeat(F.lit("y"), 201)).alias("city"),
        F.when(k % 17 == 0, F.repeat(F.lit("z,"), 3000)).when(k % 2 == 0, F.lit("a.example\n b.example,,c.example,d,e,f")).alias("competitors"),
        F.when(k % 19 == 0, F.array_repeat(F.lit("u.example"), 21)).when(k % 2 == 1, F.array(F.lit("v.example"), F.lit(""))).alias("competitor_urls"),
        F.when(k % 23 == 0, F.lit(float("nan"))).when(k % 5 > 0, (k % 400).cast("double")).alias("max_pages"), F.when(k % 29 == 0, F.lit(float("inf"))).when(k % 4 > 0, (k * 1000).cast("double")).alias("max_duration_ms"), (k % 90).cast("double").alias("max_competitor_pages"),
    )


INVALID = """CASE WHEN k % 6 = 0 THEN 'A website URL or domain is required' WHEN k % 11 = 0 THEN 'The website URL is too long' WHEN k % 7 = 0 THEN '"companyName" must be a string of at most 200 characters' WHEN k % 13 = 0 THEN '"city" must be a string of at most 200 characters'
WHEN k % 17 = 0 THEN 'The competitor list is too long' WHEN k % 19 = 0 THEN 'Provide at most 20 competitor URLs' WHEN k % 23 = 0 THEN '"maxPages" must be a number' WHEN k % 29 = 0 THEN '"maxDurationMs" must be a number' END"""


@query(f"SELECT k AS c_custkey, {INVALID} AS error FROM (SELECT c_custkey AS k FROM customer)")
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    return requests.validated(audit_requests(spark, sf)).select("c_custkey", "error")


@query(f"""SELECT k AS c_custkey, 'https://site' || k || '.example/a' AS url, c_name AS company_name, CASE WHEN k % 3 = 0 THEN c_mktsegment ELSE '' END AS industry, '' AS city, CASE WHEN k % 2 = 0 THEN 'a.example|b.example|c.example|d|e' ELSE 'v.example' END AS competitors,
CASE WHEN k % 5 > 0 THEN greatest(1, least(250, k % 400)) ELSE 250 END::DOUBLE AS max_pages, CASE WHEN k % 4 > 0 THEN greatest(60000, least(300000, k * 1000)) ELSE 150000 END::DOUBLE AS max_duration_ms, greatest(1, least(75, k % 90))::DOUBLE AS max_competitor_pages
FROM (SELECT *, c_custkey AS k FROM customer) WHERE {INVALID} IS NULL""")
def request_normalized(spark: SparkSession, sf: str) -> DataFrame:
    n = requests.normalized(audit_requests(spark, sf))
    return n.withColumn("competitors", F.array_join("competitors", "|"))


@query(f"SELECT site_id, page_id, rank FROM (SELECT {DOMAIN} AS site_id, page_id, (row_number() OVER (PARTITION BY {DOMAIN} ORDER BY page_id))::INT AS rank FROM pages) WHERE rank <= 250")
def response_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = plan_pages(spark, sf).withColumn("schema_types", F.array().cast("array<string>"))
    return responses.response_pages(p).select("site_id", c("ord").alias("page_id")).withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY site_id ORDER BY page_id) AS INT)"))


@query("""SELECT user_id AS site_id, count(*) AS failed_requests, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 50), '|') AS errors FROM events WHERE event_type <> 'view' GROUP BY 1""")
def crawl_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type <> 'view'").select(c("user_id").alias("site_id"), c("event_id").alias("ord"), c("event_id").cast("string").alias("url"), c("event_type").alias("error"))
    return responses.crawl_summary(e).select("site_id", "failed_requests", F.array_join("errors.url", "|").alias("errors"))


@query("""SELECT event_id, k % 5 > 0 AS available, CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 'Unknown' ELSE (k % 40) || ' s' END AS first_contentful_paint,
CASE WHEN k % 5 = 0 THEN 'Unknown' WHEN k % 2 = 0 THEN 'inp ' || k WHEN k % 7 > 0 THEN 'tti ' || k ELSE 'Unknown' END AS interaction_to_next_paint, CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE 'si ' || (k % 9) END AS speed_index FROM (SELECT event_id, event_id AS k FROM events)""")
def pagespeed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k, text = c("event_id"), lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    shown = lambda v: F.struct(v.alias("displayValue"))
    audits = F.struct(
        shown(F.when(k % 3 == 0, "").otherwise(text((k % 40).cast("string"), " s"))).alias("first-contentful-paint"), shown(text("si ", (k % 9).cast("string"))).alias("speed-index"),
        shown(F.when(k % 2 == 0, text("inp ", k.cast("string")))).alias("experimental-interaction-to-next-paint"), shown(F.when(k % 7 > 0, text("tti ", k.cast("string")))).alias("interactive"),
    )
    body = F.when(k % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.struct(audits.alias("audits")).alias("lighthouseResult"))))
    return table(spark, sf, "events").select("event_id", responses.pagespeed_metrics(body).alias("m")).select("event_id", "m.available", "m.first_contentful_paint", "m.interaction_to_next_paint", "m.speed_index")


@query("""SELECT event_id, CASE WHEN k % 3 = 0 THEN '{"a": ' || k || '}' WHEN k % 3 = 1 THEN '{"b": {"c": 1}' || chr(10) || '}' END AS found FROM (SELECT event_id, event_id AS k FROM events)""")
def answer_json(spark: SparkSession, sf: str) -> DataFrame:
    k = c("event_id").cast("string")
    answer = F.when(c("event_id") % 3 == 0, F.concat(F.lit('  {"a": '), k, F.lit("}\n"))).when(c("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```"), F.lit('{"b": {"c": 1}\n}'), F.lit("``` done"))).otherwise(F.lit("none, sorry"))
    return table(spark, sf, "events").select("event_id", compat.json_in(answer).alias("found"))


