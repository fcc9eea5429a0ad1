"""Findings: a table of rules compiled to one array per site, sorted by severity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.operators.scoring import TYPES, filled_sql, pct, quoted

SEVERITY = {"high": 3, "medium": 2, "low": 1}
FIELDS = ("id", "category", "severity", "title", "description", "recommendation", "evidence", "url", "confidence", "score_impact")
YES = "{if(%s, 'found', 'missing')}"

# When a finding holds, and its texts, in order of emission:
# condition, category, severity, title, description, recommendation, evidence, url, confidence, impact.
RULES = (
    ("NOT coalesce(bots['OAI-SearchBot'].allowed, true)", "GEO/AEO", "high", "ChatGPT Search crawler appears blocked",
     "OAI-SearchBot access is important for ChatGPT Search visibility. Blocking it can prevent content from being surfaced in ChatGPT search answers.",
     "Update robots.txt to allow OAI-SearchBot on public content that should be eligible for ChatGPT Search.",
     "{bots['OAI-SearchBot'].evidence}", "{origin}/robots.txt", "high", 16),
    ("NOT llms_found", "GEO/AEO", "medium", "No llms.txt file found",
     "An llms.txt file is not required, but it can give AI systems and agentic tools a concise map of important site content.",
     "Add /llms.txt with a short brand summary, priority pages, product/service descriptions, and preferred citation URLs.",
     "GET /llms.txt did not return a usable file", "{origin}/llms.txt", "medium", 8),
    ("NOT schema_found", "Structured Data", "high", "No structured data found",
     "AI systems and search engines have fewer explicit facts about the business, products, services, reviews, and content hierarchy.",
     "Add JSON-LD for Organization, WebSite, BreadcrumbList, and the relevant Service, Product, FAQPage, Article, or LocalBusiness types.",
     "No application/ld+json blocks were found in crawled pages", "{start_url}", "high", 18),
    ("topical_depth < 4", "Content", "high", "Thin topical coverage for AI answer engines",
     "The crawler found limited dedicated content for services, products, resources, or comparisons. AI answers tend to favor sources with clear topical depth.",
     "Create dedicated pages for each major service/product, use-case, comparison, and frequently asked buyer question.",
     "{topical_depth} topical pages detected across {page_count} crawled pages", "{start_url}", "high", 18),
    ("NOT has_direct_answers", "AEO", "medium", "Few extractable direct answers",
     "The site does not consistently use concise answer-style statements that AI systems can lift into responses.",
     "Add short answer blocks under H2/H3 questions, with plain-language definitions, cost ranges, timelines, requirements, and next steps.",
     "Direct-answer phrase patterns were not detected in crawled text", "{start_url}", "medium", 18),
    ("about_url IS NULL OR NOT has_credentials", "Entity Trust", "medium", "Weak entity and trust signals",
     "The site needs clearer evidence of who is behind the brand, why they are credible, and where third-party systems can verify the entity.",
     "Strengthen the About page, add leadership/team attribution, certifications, partner badges, profile links, case studies, and review proof.",
     "About page: " + YES % "about_url IS NOT NULL" + ", credentials: " + YES % "has_credentials", "{start_url}", "medium", 16),
    ("title_coverage < 0.85D OR description_coverage < 0.75D", "SEO", "medium", "Metadata coverage is incomplete",
     "Missing titles or descriptions reduce search snippet quality and make pages less clear to AI/search systems.",
     "Add unique title tags and meta descriptions to important pages, especially service, product, location, and resource pages.",
     pct("title_coverage") + " title coverage, " + pct("description_coverage") + " description coverage", "{start_url}", "high", 14),
    ("mobile < 50", "Performance", "medium", "Mobile performance is weak",
     "Slow mobile performance hurts conversion, crawl efficiency, and user engagement.",
     "Prioritize image optimization, JavaScript reduction, caching, and Core Web Vitals improvements for key templates.",
     "Mobile PageSpeed score: {mobile}/100", "{start_url}", "high", 20),
    ("mobile IS NULL AND desktop IS NULL", "Performance", "low", "PageSpeed data unavailable",
     "The audit could not retrieve PageSpeed data, so performance was not treated as a hard failure.",
     "Add a Google PageSpeed API key or rerun the audit if the API timed out or rate-limited the request.",
     "PageSpeed API returned no Lighthouse result", "{start_url}", "high", 0),
    ("vertical = 'ecommerce' AND NOT schema_product_only", "Ecommerce", "high", "Product schema is missing or incomplete",
     "Product schema helps search and AI systems understand item names, prices, availability, ratings, and offers.",
     "Add Product, Offer, AggregateRating, and BreadcrumbList schema to product and category templates.",
     TYPES, "{start_url}", "high", 22),
    ("vertical = 'saas' AND (NOT has_pricing_page OR NOT has_security_trust)", "SaaS", "medium", "SaaS evaluation content is incomplete",
     "AI answers for SaaS comparisons often cite pricing, documentation, integrations, security, and customer proof.",
     "Add or strengthen pricing, docs, integrations, security, comparison, and case-study pages.",
     "Pricing: {has_pricing_page}, docs: {has_docs}, security: {has_security_trust}", "{start_url}", "medium", 20),
    ("vertical = 'local' AND (NOT has_address OR NOT has_hours)", "Local SEO", "medium", "Local business signals are incomplete",
     "Local and AI recommendation systems need clear NAP, hours, service areas, and location-specific content.",
     "Add full NAP, business hours, service areas, embedded map/profile links, and location/service-area pages where relevant.",
     "Address: {has_address}, hours: {has_hours}, service area: {has_service_area}", "{start_url}", "medium", 18),
)


def _finding(rule: tuple, emit: int) -> str:
    test, category, severity, title, description, advice, evidence, url, confidence, impact = rule
    slug = re.sub(r"(^-|-$)", "", re.sub(r"[^a-z0-9]+", "-", f"{category}-{title}".lower()))[:80]
    values = (*map(quoted, (slug, category, severity, title, description, advice)), filled_sql(evidence), filled_sql(url), quoted(confidence), str(impact))
    made = f"named_struct('w', {-SEVERITY[severity]}, 'emit', {emit}, 'f', named_struct({', '.join(f'{f!r}, {v}' for f, v in zip(FIELDS, values, strict=True))}))"
    return f"if(coalesce({test}, false), {made}, null)"


def with_findings(scored: DataFrame) -> DataFrame:
    """Adds ``findings`` to scored sites: the most severe first, else in order of emission."""
    every = ", ".join(_finding(r, k) for k, r in enumerate(RULES))
    return scored.selectExpr("*", f"transform(array_sort(filter(array({every}), x -> x is not null)), x -> x.f) as findings")


def exploded(sites: DataFrame) -> DataFrame:
    """A row per finding, with ``ord``."""
    return sites.select("site_id", F.posexplode("findings").alias("ord", "f")).select("site_id", "ord", "f.*")
