"""Scores: a table of checks compiled to one projection. No joins, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHECK = "struct<label:string,status:string,score:int,max_score:int,evidence:string>"


@dataclass(frozen=True)
class Check:
    """kind: ``flag`` (all or nothing), ``ratio`` (of 1) or ``number`` (of 100, null unknown). value and evidence: SQL; {..} in evidence is SQL inside a text."""

    kind: str
    most: int
    label: str
    value: str
    evidence: str

    def sql(self) -> str:
        """The check as one SQL expression: a few long expressions are far cheaper to build and to analyse than thousands of small ones."""
        v, most = self.value, self.most
        if self.kind == "flag":
            status, score = f"if(coalesce({v}, false), 'passed', 'failed')", f"if(coalesce({v}, false), {most}, 0)"
        elif self.kind == "ratio":
            safe = f"coalesce(if(isnan({v}), 0D, greatest(0D, least(1D, {v}))), 0D)"
            status, score = f"case when {safe} >= 0.85D then 'passed' when {safe} >= 0.55D then 'partial' else 'failed' end", f"cast(floor({safe} * {most} + 0.5D) as int)"
        else:
            status = f"case when {v} is null then 'unknown' when {v} >= 80 then 'passed' when {v} >= 50 then 'partial' else 'failed' end"
            score = f"if({v} is null, {int(most * 0.55 + 0.5)}, cast(floor(greatest(0D, least(100D, cast({v} as double))) / 100D * {most} + 0.5D) as int))"
        return f"named_struct('label', {quoted(self.label)}, 'status', {status}, 'score', {score}, 'max_score', {most}, 'evidence', {filled_sql(self.evidence)})"

    def column(self) -> Column:
        return F.expr(self.sql()).cast(CHECK)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def filled_sql(template: str) -> str:
    """The SQL of a text with SQL in braces."""
    parts = [f"cast({x} as string)" if k % 2 else quoted(x) for k, x in enumerate(template.replace("}", "{").split("{")) if x]
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def filled(template: str) -> Column:
    return F.expr(filled_sql(template))


def pct(name: str) -> str:
    return f"{{concat(cast(floor(coalesce({name}, 0D) * 100D + 0.5D) as int), '%')}}"


TYPES = "{if(size(types) > 0, array_join(types, ', '), 'No schema types found')}"
BOT = "coalesce(bots['%s'].allowed, true)"
MISSING = "{coalesce(%s, 'Missing')}"

# The checks of each category in order, with their weights, labels and evidence.
CATEGORIES: dict[str, tuple[str, list[Check]]] = {
    "crawlability": ("Crawlability and AI Bot Access", [
        Check("flag", 12, "Crawled enough pages for a site-level read", "page_count >= 10", "{page_count} pages crawled"),
        Check("flag", 14, "XML sitemap is available", "sitemap_found", "{sitemap_urls} sitemap URLs found"),
        Check("flag", 8, "robots.txt is available", "robots_found", "{if(robots_found, 'robots.txt found', 'robots.txt missing')}"),
        Check("flag", 18, "Googlebot can access the site", BOT % "Googlebot", "{bots['Googlebot'].evidence}"),
        Check("flag", 16, "OAI-SearchBot can access the site", BOT % "OAI-SearchBot", "{bots['OAI-SearchBot'].evidence}"),
        Check("flag", 8, "ChatGPT-User can access the site", BOT % "ChatGPT-User", "{bots['ChatGPT-User'].evidence}"),
        Check("flag", 8, "llms.txt provides AI-readable guidance", "llms_found AND llms_useful", "{if(llms_found, concat(llms_length, ' characters'), 'llms.txt missing')}"),
        Check("flag", 16, "Important crawled pages are indexable", "noindex_pages = 0", "{noindex_pages} noindex pages found"),
    ]),
    "structured_data": ("Structured Data", [
        Check("flag", 18, "JSON-LD schema exists", "schema_found", "{schema_count} schema nodes found"),
        Check("flag", 12, "Organization or LocalBusiness schema exists", "schema_local_business", TYPES),
        Check("flag", 18, "Service or Product schema exists", "schema_service OR schema_product", TYPES),
        Check("flag", 14, "FAQ or Article schema supports answer extraction", "schema_faq OR schema_article", TYPES),
        Check("flag", 8, "Breadcrumb schema clarifies site hierarchy", "schema_breadcrumb", TYPES),
        Check("flag", 10, "Review or rating schema exists", "schema_review", TYPES),
        Check("flag", 20, "No invalid JSON-LD detected", "invalid_count = 0", "{invalid_count} invalid JSON-LD blocks"),
    ]),
    "answer_readiness": ("Answer Readiness", [
        Check("flag", 18, "FAQ or Q&A content exists", "faq_pages > 0 OR schema_faq", "{faq_pages} FAQ-like pages found"),
        Check("flag", 18, "Content includes direct answer statements", "has_direct_answers", "Direct answer language detected"),
        Check("flag", 18, "Site has topical depth", "topical_depth >= 8", "{topical_depth} service/product/resource/comparison pages"),
        Check("flag", 14, "Core offerings have dedicated pages", "service_pages + product_pages >= 3", "{service_pages} service pages, {product_pages} product pages"),
        Check("flag", 10, "Comparison or alternative content exists", "comparison_pages > 0", "{comparison_pages} comparison pages found"),
        Check("flag", 10, "Process/methodology is explained", "has_process", "Process language detected"),
        Check("flag", 6, "Pricing, quote, or cost guidance exists", "has_pricing", "Pricing/cost language detected"),
        Check("flag", 6, "Freshness signals exist", "has_freshness", "Current/recent language detected"),
    ]),
    "entity_trust": ("Entity Trust", [
        Check("flag", 14, "About/company page exists", "about_url IS NOT NULL", MISSING % "about_url"),
        Check("flag", 14, "Contact page exists", "contact_url IS NOT NULL", MISSING % "contact_url"),
        Check("flag", 12, "SameAs/social/profile links exist", "size(same_as) >= 2", "{greatest(coalesce(size(same_as), 0), 0)} external profile links"),
        Check("flag", 16, "Credentials and trust markers exist", "has_credentials", "Credentials/trust language detected"),
        Check("flag", 16, "Case studies, testimonials, or proof exists", "has_case_studies", "{trust_pages} trust pages found"),
        Check("flag", 12, "Author, founder, or team attribution exists", "has_author", "Author/team language detected"),
        Check("flag", 16, "Contact identity is machine-readable", "phone_count > 0 OR email_count > 0", "{phone_count} phones, {email_count} emails"),
    ]),
    "technical_seo": ("Technical SEO", [
        Check("ratio", 16, "Title tag coverage", "title_coverage", pct("title_coverage") + " of crawled pages have titles"),
        Check("ratio", 14, "Meta description coverage", "description_coverage", pct("description_coverage") + " of crawled pages have descriptions"),
        Check("ratio", 12, "Single-H1 coverage", "h1_coverage", pct("h1_coverage") + " of crawled pages have exactly one H1"),
        Check("flag", 10, "No duplicate titles detected", "duplicate_titles = 0", "{duplicate_titles} duplicate title values"),
        Check("flag", 8, "No duplicate descriptions detected", "duplicate_descriptions = 0", "{duplicate_descriptions} duplicate meta descriptions"),
        Check("flag", 10, "Sitemap supports discovery", "sitemap_found", "{sitemap_urls} sitemap URLs"),
        Check("flag", 12, "Crawled pages are indexable", "noindex_pages = 0", "{noindex_pages} noindex pages"),
        Check("flag", 10, "Pages have enough crawlable text", "average_words >= 250", "{average_words} average words per page"),
        Check("flag", 8, "Breadcrumb hierarchy is explicit", "schema_breadcrumb", TYPES),
    ]),
    "page_experience": ("Page Experience", [
        Check("number", 35, "Mobile PageSpeed performance", "mobile", "{coalesce(concat(mobile, '/100'), 'Unavailable')}"),
        Check("number", 25, "Desktop PageSpeed performance", "desktop", "{coalesce(concat(desktop, '/100'), 'Unavailable')}"),
        Check("ratio", 15, "Image alt text coverage", "average_alt", pct("average_alt") + " average alt coverage"),
        Check("ratio", 10, "Form labels are likely present", "form_coverage", pct("form_coverage") + " form label coverage"),
        Check("flag", 15, "HTTPS is enabled", "has_https", "{if(has_https, 'HTTPS detected', 'HTTP detected')}"),
    ]),
    "ecommerce": ("Ecommerce Readiness", [
        Check("flag", 20, "Product/category pages were found", "product_pages >= 3", "{product_pages} product-like pages"),
        Check("flag", 22, "Product schema exists", "schema_product_only", TYPES),
        Check("flag", 18, "Offer/pricing schema exists", "schema_offer", TYPES),
        Check("flag", 20, "Reviews/ratings are visible", "has_reviews", "Review or rating signals detected"),
        Check("flag", 20, "Shipping and returns content exists", "has_shipping_returns", "Shipping/returns language detected"),
    ]),
    "saas": ("SaaS Readiness", [
        Check("flag", 20, "Pricing page exists", "has_pricing_page", "Pricing page detected"),
        Check("flag", 18, "Documentation/help content exists", "has_docs", "Docs/help page detected"),
        Check("flag", 18, "Integration ecosystem is described", "has_integrations", "Integration language detected"),
        Check("flag", 22, "Security/trust content exists", "has_security_trust", "Security/trust language detected"),
        Check("flag", 22, "Case studies/customer proof exists", "has_customer_pages", "Case study pages detected"),
    ]),
    "local": ("Local Readiness", [
        Check("flag", 18, "Target city is mentioned", "city_mentioned", "{if(city <> '', city, 'No city provided')}"),
        Check("flag", 18, "Phone number is visible", "phone_count > 0", "{phone_count} phone values"),
        Check("flag", 18, "Address is visible", "has_address", "{if(has_address, 'Address pattern detected', 'No address pattern detected')}"),
        Check("flag", 14, "Business hours are visible", "has_hours", "{if(has_hours, 'Hours detected', 'Hours missing')}"),
        Check("flag", 14, "Service area language exists", "has_service_area", "{if(has_service_area, 'Service area language detected', 'Missing')}"),
        Check("flag", 18, "LocalBusiness/location structure exists", "location_pages > 0 OR schema_local_business", "{location_pages} location pages"),
    ]),
    "general": ("General Site Readiness", [
        Check("flag", 20, "About page exists", "about_url IS NOT NULL", MISSING % "about_url"),
        Check("flag", 20, "Contact page exists", "contact_url IS NOT NULL", MISSING % "contact_url"),
        Check("flag", 25, "Site has topical depth", "topical_depth >= 6", "{topical_depth} topical pages"),
        Check("flag", 20, "Trust/proof pages exist", "trust_pages > 0", "{trust_pages} trust pages"),
        Check("flag", 15, "Decision-support content exists", "has_pricing OR has_process", "Pricing/process language detected"),
    ]),
    "security": ("Security", [
        Check("flag", 25, "HTTPS enabled", "has_https", "{if(has_https, 'HTTPS detected', 'HTTPS missing')}"),
        Check("flag", 15, "HSTS header present", "has_hsts", "{if(has_hsts, 'Present', 'Missing')}"),
        Check("flag", 20, "Content Security Policy present", "has_csp", "{if(has_csp, 'Present', 'Missing')}"),
        Check("flag", 15, "Clickjacking protection present", "has_frame_protection", "{if(has_frame_protection, 'Present', 'Missing')}"),
        Check("flag", 15, "MIME sniffing protection present", "has_nosniff", "{if(has_nosniff, 'Present', 'Missing')}"),
        Check("flag", 10, "Referrer policy present", "has_referrer_policy", "{if(has_referrer_policy, 'Present', 'Missing')}"),
    ]),
    "accessibility": ("Accessibility", [
        Check("number", 45, "Lighthouse accessibility score", "lighthouse_accessibility", "{coalesce(concat(lighthouse_accessibility, '/100'), 'Unavailable')}"),
        Check("ratio", 25, "Image alt text coverage", "average_alt", pct("average_alt") + " average alt coverage"),
        Check("ratio", 20, "Form label coverage", "form_coverage", pct("form_coverage") + " likely labeled forms"),
        Check("flag", 10, "Semantic landmarks detected", "landmark_pages > 0", "{landmark_pages} pages"),
    ]),
}
# The verticals in order of precedence, and the weights of the composite scores.
VERTICALS = (("ecommerce", "likely_ecommerce"), ("saas", "likely_saas"), ("local", "city <> '' OR city_mentioned OR has_address OR has_service_area"))
ORDER = ("crawlability", "structured_data", "answer_readiness", "entity_trust", "technical_seo", "page_experience", "vertical_readiness", "security", "accessibility")
WEIGHTS = {
    "overall": {"crawlability": 0.15, "structured_data": 0.15, "answer_readiness": 0.2, "entity_trust": 0.15, "technical_seo": 0.15, "page_experience": 0.1, "vertical_readiness": 0.1},
    "aeo_geo": {"crawlability": 0.18, "structured_data": 0.22, "answer_readiness": 0.25, "entity_trust": 0.2, "vertical_readiness": 0.15},
    "seo": {"technical_seo": 0.55, "crawlability": 0.2, "structured_data": 0.15, "page_experience": 0.1},
    "ai_readiness": {"aeo_geo": 0.75, "entity_trust": 0.15, "crawlability": 0.1},
}


def _checks(key: str) -> str:
    return f"array({', '.join(k.sql() for k in CATEGORIES[key][1])})"


def _by_vertical(value) -> str:
    """SQL that chooses by vertical."""
    return "case vertical " + " ".join(f"when '{k}' then {value(k)}" for k, _ in VERTICALS) + f" else {value('general')} end"


def _sum(key: str, field: str) -> str:
    """SQL of a sum over the checks of a category: the points by their places in the array, as a loop over it would be interpreted; what they can reach is fixed."""
    one = lambda k: " + ".join(f"__{key}[{n}].score" for n in range(len(CATEGORIES[k][1]))) if field == "score" else str(sum(x.most for x in CATEGORIES[k][1]))
    return f"({_by_vertical(one) if key == 'vertical_readiness' else one(key)})"


def score_sites(signals: DataFrame) -> DataFrame:
    """Adds ``categories`` (array of key, name, score, points, max_points, checks, in order), ``vertical`` and one int column per score.

    Needs the columns of site signals and ``mobile, desktop, lighthouse_accessibility`` (null: unknown)."""
    fits = " ".join(f"when coalesce({test}, false) then '{key}'" for key, test in VERTICALS)
    out = signals.selectExpr("*", f"case {fits} else 'general' end as vertical")
    out = out.selectExpr("*", *(f"{_by_vertical(_checks) if k == 'vertical_readiness' else _checks(k)} as __{k}" for k in ORDER))
    out = out.selectExpr("*", *(f"cast(floor({_sum(k, 'score')} / greatest({_sum(k, 'max_score')}, 1) * 100D + 0.5D) as int) as {k}" for k in ORDER))
    name = lambda k: _by_vertical(lambda v: quoted(CATEGORIES[v][0])) if k == "vertical_readiness" else quoted(CATEGORIES[k][0])
    full = ", ".join(f"named_struct('key', '{k}', 'name', {name(k)}, 'score', {k}, 'points', {_sum(k, 'score')}, 'max_points', {_sum(k, 'max_score')}, 'checks', __{k})" for k in ORDER)
    out = out.selectExpr("*", f"array({full}) as categories").drop(*(f"__{k}" for k in ORDER))
    for composite, weights in WEIGHTS.items():
        out = out.selectExpr("*", f"cast(floor({' + '.join(f'{k} * {w}D' for k, w in weights.items())} + 0.5D) as int) as {composite}")
    return out
