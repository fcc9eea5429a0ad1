"""Page signals: what the parsed columns and the crawl say of each page, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx

# Page types in order of precedence, with what gives them away.
PAGE_TYPES = (
    ("contact", "contact|get-in-touch|schedule|book"),
    ("about", "about|our story|company|team"),
    ("pricing", "pricing|plans"),
    ("docs", "docs|documentation|developer|api-reference|help-center"),
    ("location", "location|near-me|service-area|areas-we-serve"),
    ("product", "product|shop|sku|add to cart"),
    ("service", "service|solutions|what we do"),
    ("education", "blog|article|guide|resource|learn|how-to|what-is"),
)
# Profile pages elsewhere.
PROFILES = r"facebook|instagram|linkedin|youtube|x\.com|twitter|tiktok|yelp|g2|capterra|trustpilot|bbb\.org"
# Words of visible questions and answers.
FAQ = r"frequently asked|faq|questions and answers|(?<![A-Za-z0-9_])q&a(?![A-Za-z0-9_])"
TYPE_TEXT_CHARS = 5000
#: What every phone number ends with.
PHONE_END = r"[0-9]{3}[-. \t\n\r\f\x0B]?[0-9]{4}"


def page_type(haystack: Column, low: Column | None = None) -> Column:
    """low: ``folded`` of the haystack, where it is at hand."""
    out = None
    for name, pattern in PAGE_TYPES:
        test = tx.matches(haystack, pattern) if low is None else tx.mentions(haystack, low, pattern)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("general"))


def alt_ratio(images: Column, with_alt: Column) -> Column:
    return F.when(images == 0, F.lit(1.0)).otherwise(with_alt / images)


def likely_labeled(inputs: Column, labels: Column, aria: Column) -> Column:
    return (inputs == 0) | (labels + aria >= F.least(inputs, F.lit(1)))


def page_signals(parsed: DataFrame) -> DataFrame:
    """Adds the derived signals to parsed pages; each needs ``url``."""
    c = F.col
    haystack = F.concat_ws(" ", c("url"), c("title"), F.array_join("h1", " "), F.array_join("h2", " "), F.substring("text", 1, TYPE_TEXT_CHARS))
    # of the next columns, each is used several times
    rows = parsed.withColumns({"__haystack": haystack, "__low": tx.folded(c("text"))}).withColumn("__low_haystack", tx.folded(c("__haystack")))
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "indexable": ~tx.matches(c("robots_meta"), "noindex"),
        "content_type": page_type(c("__haystack"), c("__low_haystack")),
        "has_visible_faq": tx.mentions(c("text"), c("__low"), FAQ) | c("faq_markup") | (c("question_headings") >= 2),
        "same_as": F.filter("links", lambda h: tx.matches(h, PROFILES)),
        "phones": F.when(c("text").rlike(PHONE_END), tx.distinct_matches(c("text"), tx.PHONE)).otherwise(none),
        "emails": F.when(F.contains("text", F.lit("@")), tx.distinct_matches(c("text"), tx.EMAIL)).otherwise(none),
        "alt_ratio": alt_ratio(c("image_count"), c("images_with_alt")),
        "likely_labeled": likely_labeled(c("inputs"), c("labels"), c("aria_labels")),
        "word_count": tx.word_count(c("text")),
        "h1_count": F.size("h1"),
        "schema_count": F.size("nodes"),
    }).drop("__haystack", "__low", "__low_haystack")
