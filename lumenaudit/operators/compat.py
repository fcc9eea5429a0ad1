"""The report that clients read: grades, bands, statuses, issue lists and texts, as one projection of scored sites with findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# The categories of findings that each list of issues has.
AI_ISSUES = ("GEO/AEO", "AEO")
AEO_ISSUES = ("GEO/AEO", "AEO", "Content", "Entity Trust", "Structured Data")
# The categories of the answer-engine checks, in order.
AEO_CATEGORIES = ("crawlability", "structured_data", "answer_readiness", "entity_trust", "vertical_readiness")
# Texts of the report.
STRONG, MODERATE, WEAK = (
    "Strong on-site readiness for AI answer engines", "Moderate readiness with clear improvement opportunities",
    "Weak readiness; answer engines may struggle to identify this site as a trusted source",
)
REASONING = "Prediction is based on crawlability, schema, answer content, entity trust, and vertical-specific evidence. It is not a live ranking guarantee."
INSIGHT = (
    ", AI visibility depends on crawl access, clear entity facts, structured data, direct-answer content, and third-party trust signals. "
    "This report grades the on-site foundation first and leaves room to add paid SERP/backlink/review providers later."
)
CAVEAT = "This diagnostic measures on-site readiness and manual competitor gaps. It does not verify live AI answer inclusion."
NARRATIVE = (
    ("GEO/AEO", "aeo_geo", "Based on crawlability, schema, answer content, entity trust, and vertical readiness."),
    ("SEO", "seo", "Based on metadata, indexability, sitemap coverage, headings, and technical signals."),
)
MOST_EVIDENCE, MOST_FINDINGS = 12, 10  # checks of a category and findings of an evidence bundle


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def band(score: Column) -> Column:
    """The word beside a score."""
    return F.when(score >= 80, "Strong").when(score >= 60, "Developing").otherwise("Needs Work")


def tone(score: Column) -> Column:
    """The colour of a score's bar; unknown scores have none."""
    return F.when(score.isNull(), "none").when(score >= 75, "good").when(score >= 55, "fair").otherwise("poor")


def check_status(status: Column) -> Column:
    return F.when(status == "passed", "good").when(status.isin("partial", "unknown"), "partial").otherwise("missing")


def score_status(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 55, "partial").otherwise("missing")


def prediction(score: Column) -> Column:
    return F.when(score >= 80, STRONG).when(score >= 60, MODERATE).otherwise(WEAK)


def titles(categories: tuple[str, ...]) -> Column:
    """Titles of the findings of some categories, in order."""
    return F.transform(F.filter("findings", lambda f: f["category"].isin(*categories)), lambda f: f["title"])


def of_severity(findings: Column, severity: str) -> Column:
    """Findings of one severity, or of ``all``."""
    return findings if severity == "all" else F.filter(findings, lambda f: f["severity"] == severity)


def category(key: str) -> Column:
    return F.element_at(F.filter("categories", lambda k: k["key"] == key), 1)


def detailed_checks() -> Column:
    """The answer-engine categories with their status, details and advice."""
    one = lambda k: F.struct(
        k["name"].alias("name"), score_status(k["score"]).alias("status"), k["score"].alias("score"), F.lit(100).alias("max_score"),
        F.transform(k["checks"], lambda x: F.concat_ws(": ", x["label"], x["evidence"])).alias("details"),
        F.concat(k["name"], F.lit(" affects whether AI and search systems can discover, understand, trust, and cite the site.")).alias("why_it_matters"),
        F.when(k["score"] >= 80, "").otherwise(F.concat(F.lit("Improve failed and partial checks in "), k["name"], F.lit("."))).alias("recommendation"),
    )
    return F.array(*(one(category(k)) for k in AEO_CATEGORIES))


def listed_checks(key: str, advice: str) -> Column:
    """The checks of a category as the report lists them."""
    return F.transform(category(key)["checks"], lambda x: F.struct(
        x["label"].alias("name"), check_status(x["status"]).alias("status"), x["score"].alias("score"), x["max_score"].alias("max_score"), x["evidence"].alias("value"),
        F.when(x["status"] == "passed", "").otherwise(advice).alias("recommendation"),
    ))


def roadmap() -> Column:
    """The roadmap of a site without a written one: the first two findings now, the next two after."""
    advice = lambda at: F.transform(F.slice("findings", at, 2), lambda f: f["recommendation"])
    phase = lambda name, title, at: F.struct(F.lit(name).alias("phase"), title.alias("title"), advice(at).alias("actions"))
    first = F.coalesce(F.nullif(F.try_element_at("findings", F.lit(1))["title"], F.lit("")), F.lit("Fix highest-impact readiness issues"))
    return F.array(phase("Now", first, 1), phase("Next", F.lit("Strengthen evidence quality"), 3))


def response(sites: DataFrame, *more: Column) -> DataFrame:
    """One row per site, with ``more`` columns. sites: scored sites with ``findings`` and the input's ``company_name, industry, city`` (empty where not given)."""
    given = lambda name: F.coalesce(c(name), F.lit(""))
    industry = F.when(given("industry") != "", c("industry")).otherwise("this category")
    target = F.when(given("city") != "", F.concat(industry, F.lit(" in "), c("city"))).otherwise(industry)
    both = (given("industry") != "") & (given("city") != "")
    passed = F.filter(category("technical_seo")["checks"], lambda x: x["status"] == "passed")
    impact = lambda s: F.when(s == "high", "High").when(s == "medium", "Medium").otherwise("Low")
    top = F.slice("findings", 1, 5)
    return sites.select(
        "site_id", *(c(k) for k in ("mobile", "desktop", "ai_readiness", "seo", "aeo_geo", "security", "accessibility", "overall")),
        titles(AI_ISSUES).alias("ai_issues"), F.transform(F.slice("findings", 1, 6), lambda f: f["recommendation"]).alias("opportunities"),
        F.struct(*(F.coalesce(c(k) >= 70, F.lit(False)).alias(k) for k in AEO_CATEGORIES)).alias("aeo_checks"), titles(AEO_ISSUES).alias("aeo_issues"),
        F.transform(F.slice("findings", 1, 10), lambda f: f["recommendation"]).alias("recommendations"),
        (c("aeo_geo") >= 70).alias("would_recommend"), F.when(both, F.concat(F.lit('"Best '), "industry", F.lit(" in "), "city", F.lit('"'))).otherwise('"Best provider for this category"').alias("test_query"),
        prediction(c("aeo_geo")).alias("prediction"), F.lit(REASONING).alias("reasoning"), detailed_checks().alias("aeo_detailed"),
        titles(("SEO",)).alias("seo_issues"), listed_checks("technical_seo", "Review and improve this technical SEO item.").alias("seo_detailed"),
        F.size(passed).alias("seo_passed"), (F.size(category("technical_seo")["checks"]) - F.size(passed)).alias("seo_failed"),
        grade(c("security")).alias("security_grade"), titles(("Security",)).alias("security_issues"), listed_checks("security", "Add or correct this security control.").alias("security_detailed"),
        F.when(c("security") >= 80, "Strong baseline security headers.").otherwise("Security headers need improvement.").alias("security_summary"),
        titles(("Accessibility",)).alias("accessibility_issues"),
        F.struct((c("average_alt") >= 0.85).alias("alt_text"), (c("form_coverage") >= 0.85).alias("form_labels"), (c("landmark_pages") > 0).alias("landmarks"), (c("h1_coverage") >= 0.85).alias("headings")).alias("accessibility_checks"),
        F.concat(F.coalesce(F.nullif("company_name", F.lit("")), "domain"), F.lit(" scored "), "overall", F.lit("/100 overall and "), "aeo_geo", F.lit("/100 for GEO/AEO readiness. The audit crawled "), "page_count",
                 F.lit(" pages and found "), F.size("findings"), F.lit(" prioritized findings with supporting evidence.")).alias("executive_summary"),
        F.transform(top, lambda f: F.struct(f["title"].alias("title"), impact(f["severity"]).alias("impact"), f["description"].alias("description"))).alias("top_issues"),
        F.transform(top, lambda f: F.struct(f["title"].alias("title"), f["recommendation"].alias("description"), F.when(f["severity"] == "high", "1-3 hours").otherwise("30-90 minutes").alias("time_estimate"))).alias("quick_wins"),
        F.concat(F.lit("For "), target, F.lit(INSIGHT)).alias("industry_insight"),
        F.array(*(F.struct(F.lit(label).alias("label"), c(k).alias("score"), F.lit(text).alias("explanation")) for label, k, text in NARRATIVE)).alias("score_narrative"),
        roadmap().alias("roadmap"), F.array(F.lit(CAVEAT)).alias("caveats"), band(c("overall")).alias("band"), tone(c("overall")).alias("tone"), *more,
    )


def evidence(sites: DataFrame) -> DataFrame:
    """``(site_id, evidence)``: what a writer of the narrative is given, as JSON: scores, 12 checks a category and 10 findings at most."""
    checks = F.transform("categories", lambda k: F.struct(k["name"].alias("name"), k["score"].alias("score"), F.slice(k["checks"], 1, MOST_EVIDENCE).alias("checks")))
    scores = F.struct(*(c(k) for k in ("mobile", "desktop", "ai_readiness", "seo", "aeo_geo", "security", "accessibility", "overall")))
    crawl = F.struct(c("page_count").alias("pages"), c("sitemap_urls"), c("robots_found"), c("llms_found"))
    content = F.struct(*(c(k) for k in ("faq_pages", "service_pages", "product_pages", "comparison_pages", "topical_depth")))
    schema = F.struct(c("schema_found").alias("found"), c("schema_count").alias("count"), c("types"))
    whole = F.struct(F.coalesce(F.nullif("company_name", F.lit("")), "domain").alias("company_name"), "domain", "start_url", crawl.alias("crawl"), scores.alias("scores"), checks.alias("categories"),
                     F.slice("findings", 1, MOST_FINDINGS).alias("findings"), content.alias("content"), schema.alias("schema"))
    return sites.select("site_id", F.to_json(whole).alias("evidence"))


def json_in(answer: Column) -> Column:
    """The JSON object in an answer: all of it, or what lies between its first and its last brace; null without one."""
    trimmed = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    found = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)
    return F.when(trimmed.startswith("{"), trimmed).otherwise(F.nullif(found, F.lit("")))
