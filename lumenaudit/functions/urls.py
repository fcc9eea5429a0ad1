"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenaudit.functions.text import stripped

# Query parameters that don't change a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
# Endings of paths that aren't pages.
ASSETS = "avif|bmp|css|csv|doc|docx|gif|ico|jpeg|jpg|js|json|mp3|mp4|mov|pdf|png|svg|webm|webp|woff|woff2|xls|xlsx|xml|zip"
# Pages without a marketing purpose.
UTILITY = "privacy|terms|login|sign-in|cart|checkout|account|wp-json|feed|tag/|category/|author/"
# Paths to crawl first, in order of weight from 100 down.
PRIORITY = ("/$", "about", "contact", "service", "solution", "product", "pricing", "faq", "location", "review", "testimonial", "case", "blog", "resource", "guide", "comparison", "integrations?", "docs?")


def host(url: Column) -> Column:
    """Host in lower case, without user and port; '' if the text is no HTTP URL."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?://[^/?#]*)", 0)), r"^(http://[^/?#:]*):80$|^(https://[^/?#:]*):443$", "$1$2")


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters and one slash at the end; scheme and host in lower case, default port dropped."""
    kept = F.array_join(F.filter(F.split(query_string(url), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).isin(*TRACKING)), "&")
    whole = F.concat(origin(url), path(url), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.regexp_replace(whole, "/$", "")


def absolute(href: Column, origin_: Column) -> Column:
    """The canonical URL of a location, a relative one taken from the origin; null where it leads to no page."""
    whole = F.when(href.rlike("(?i)^https?://"), href).when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:") | (href == ""), None)
    whole = whole.when(href.startswith("//"), F.concat(F.regexp_extract(origin_, "^https?:", 0), href)).when(href.startswith("/"), F.concat(origin_, href)).otherwise(F.concat(origin_, F.lit("/"), href))
    return F.when(host(whole) != "", canonical(whole))


def looks_like_page(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(rf"\.({ASSETS})$")


def is_utility(url: Column) -> Column:
    return url.rlike("(?i)" + UTILITY)


def same_site(a: Column, b: Column) -> Column:
    return (host(a) != "") & (domain(a) == domain(b))


def priority(url: Column) -> Column:
    """Weight of a URL in the frontier: what its path matches, less its depth."""
    p = path(url)
    score = F.lit(0)
    for k, pattern in enumerate(PRIORITY):
        score = score + F.when(p.rlike("(?i)" + pattern), F.lit(100 - k)).otherwise(F.lit(0))
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    return (score - depth * 3 - F.when(F.length(p) > 90, F.lit(8)).otherwise(F.lit(0))).cast("long")


def title_from_url(url: Column) -> Column:
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.regexp_replace(F.element_at(parts, -1), "[-_]+", " ")).otherwise(host(url))


def normalized(text: Column) -> Column:
    """The audited URL of what a user typed; null where it is none."""
    t = stripped(text)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    bare = F.concat(origin(full), path(full), F.regexp_extract(full, r"^[^?#]*(\?[^#]*)", 1))
    return F.when((t != "") & (host(full) != "") & ~t.rlike(r"^(?!(?i)https?:)[a-zA-Z][a-zA-Z0-9+.-]*://") & ~host(full).rlike(r"\s"), bare)


def is_private_host(url: Column) -> Column:
    """Hosts that must not be fetched, as far as their names tell."""
    h = F.regexp_replace(host(url), r"^\[|\]$", "")
    v4 = h.rlike(r"^(0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^(22[4-9]|2[3-5]\d)\.\d+\.\d+\.\d+$")
    raw = F.lower(F.regexp_extract(url, r"^(?i:https?)://\[([^\]]*)\]", 1))
    v6 = raw.rlike(r"^(::1$|fc|fd|fe80|::ffff:127\.|::ffff:10\.|::ffff:192\.168\.)")
    return h.isin("localhost", "localhost.localdomain") | h.endswith(".local") | v4 | v6


# Links that lead to no page.
SKIPPED = "(?i)^(?:mailto|tel|sms|javascript):"
#: Characters that a path holds percent-encoded.
UNSAFE = r"""[\x00-\x20"<>`{}\x7F-\x{10FFFF}]+"""


def _folded_path(path_: Column) -> Column:
    """A path without its ``.`` and ``..`` segments: a stack of segments, from which ``..`` takes one."""
    parts = F.split(path_, "/", -1)
    last = F.element_at(parts, -1)
    stack = F.aggregate(F.slice(parts, 2, 1 << 20), F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.array_append(s, x)))
    ended = F.when(last.isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def _encoded_path(path_: Column) -> Column:
    parts = F.regexp_extract_all(path_, F.lit(f"{UNSAFE}|{UNSAFE.replace('[', '[^', 1)}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{UNSAFE}"), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)), "")


def resolved(href: Column, base: Column) -> Column:
    """The canonical absolute URL of a page's link, null where it leads to no page: links take from the base what they lack, ``.`` and ``..`` are folded, unsafe characters of the path are percent-encoded."""
    h = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    here, folder = F.regexp_extract(base, r"^(?i:https?)://[^/?#]*", 0), F.regexp_extract(path(base), r"^.*/", 0)
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    whole = (
        F.when(h.rlike(SKIPPED) | (href == ""), None).when(h.rlike("^(?i)https?://"), h).when(h.rlike("^(?i)[a-z][a-z0-9+.-]*:"), None)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^(?i)https?:", 0), h)).when(h.startswith("/"), F.concat(here, h)).when(h.startswith("?"), F.concat(bare, h))
        .when((h == "") | h.startswith("#"), base).otherwise(F.concat(here, folder, h))
    )
    rest = F.regexp_extract(whole, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host(whole) != "", canonical(F.concat(F.regexp_extract(whole, r"^(?i:https?)://[^/?#]*", 0), _encoded_path(_folded_path(path(whole))), rest)))
