"""HTML as a column of tokens: tags, texts, and elements whose content isn't markup, in order. All signals of a page come from them by column expressions, so a page's html never leaves the JVM.

Fixed values of the format: which elements hold raw text, which belong to a head, which have no content.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.functions import urls
from lumenaudit.sources import jsonld

RAW = ("script", "style", "title", "textarea")
HEAD = ("html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template")
HEADINGS = ("h1", "h2", "h3", "h4", "dt")
LANDMARK_ROLES = ("main", "navigation", "banner", "contentinfo", "search")
_REST = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*){0,60}>"""
#: A tag with more than sixty quoted values ends at its first ``>``, also within quotes: a longer repetition could exhaust the matcher's stack.
#: Comments, raw elements to their end, tags, declarations, a tag that the end of the page cuts, texts. The same in RE2.
TOKEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{n}(?:\s{_REST}|>|/>).*?(?:</{n}\s*>|\z)" for n in RAW) + rf"|</?[a-z]{_REST}|</?[a-z][^>]*>|<[!?/][^>]*>|<[a-z/!][^>]*\z|[^<]+|<"
NAME = r"^</?([a-zA-Z][a-zA-Z0-9-]*)"
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&"
LANDMARK_TAG = r"(?i)<(?:main|nav|header|footer|aside)(?![A-Za-z0-9_])"
MOST_CODE = 0x10FFFF
c = F.col


def entities() -> dict[str, str]:
    """Named characters, with and without the semicolon where both are known."""
    return dict(sorted(html5.items()))


def decoded(text: Column) -> Column:
    """A text with its character references resolved; unknown ones stay."""
    # one text, which the optimizer makes a map of, once
    named = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in entities().items())), F.lit("\x01"), F.lit("\x02"))
    point = lambda n: F.when(n <= MOST_CODE, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(x: Column) -> Column:
        ten, sixteen = F.regexp_extract(x, "^&#([0-9]{1,7})", 1), F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]{1,6})", 1)
        by_name = F.when(x.rlike("^&[a-zA-Z]"), F.try_element_at(named, F.substring(x, 2, 64)))
        reference = F.when(ten != "", F.coalesce(point(ten.try_cast("long")), x)).when(sixteen != "", F.coalesce(point(F.conv(sixteen, 16, 10).try_cast("long")), x)).otherwise(F.coalesce(by_name, x))
        # a map is searched entry by entry: the most frequent characters come before it, and texts between references never get there
        return F.when(~x.startswith("&"), x).when(x == "&amp;", "&").when(x == "&nbsp;", "\u00a0").when(x == "&lt;", "<").when(x == "&gt;", ">").when(x == "&quot;", '"').otherwise(reference)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), one), "")).otherwise(text)


ATTRIBUTE = r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def attribute(attributes: Column, name: str) -> Column:
    """The first value of a name among a tag's attributes, '' if it has none, null if the tag lacks it."""
    mine = F.try_element_at(F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}(?:[\s=]|$)")), F.lit(1))
    return F.regexp_replace(F.regexp_extract(mine, r"(?s)^[^=]*=\s*(.*)$", 1), r"""(?s)^(["'])(.*)\1$""", "$2")


def tokens(html: Column) -> Column:
    """``array<struct<at, raw, name, kind>>``; kind is ``text``, ``open``, ``close``, ``raw`` (an element with its content) or ``other``."""
    def one(t: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(t, NAME, 1))
        kind = F.when(~t.startswith("<") | (t == "<"), "text").when(t.startswith("</") & (name != ""), "close").when(name.isin(*RAW) & t.endswith(">"), "raw").when((name != "") & t.endswith(">"), "open").when(name.isin(*RAW), "raw").otherwise("other")
        return F.struct(at.alias("at"), t.alias("raw"), name.alias("name"), kind.alias("kind"))

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), one)


def content(raw: Column) -> Column:
    """What stands in a raw element."""
    return F.regexp_replace(F.regexp_replace(raw, rf"(?is)^<[a-z]+(?:\s{_REST}|>|/>)", ""), r"(?is)</[a-z]+\s*>\z", "")


def said(token: Column) -> Column:
    """The text of a text or raw token; scripts and styles know no character references."""
    plain = token["name"].isin("script", "style")
    return F.when(token["kind"] == "text", decoded(token["raw"])).when(plain, content(token["raw"])).otherwise(decoded(content(token["raw"])))


def _inside(name: str) -> Column:
    """The normalised texts of all elements of a name, to their first end tag."""
    ends = F.transform(F.filter("tokens", lambda t: (t["name"] == name) & (t["kind"] == "close")), lambda t: t["at"])  # of few elements: evaluated for each

    def one(t: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(ends, lambda e: e > t["at"])), F.size("tokens"))
        within = F.filter(F.slice("tokens", t["at"] + 2, F.greatest(end - t["at"] - 1, F.lit(0))), lambda x: x["kind"].isin("text", "raw"))
        return tx.normalize_text(F.array_join(F.transform(within, said), ""))

    return F.transform(F.filter("tokens", lambda t: (t["name"] == name) & (t["kind"] == "open")), one)


def _of(*names: str) -> Column:
    """The attributes of the start tags of some names."""
    return F.transform(F.filter("__tags", lambda t: t["name"].isin(*names)), lambda t: t["attributes"])


def _meta(name: str) -> Column:
    first = F.filter(_of("meta"), lambda t: F.lower(F.coalesce(attribute(t, "name"), F.lit(""))) == name)
    return F.coalesce(decoded(attribute(F.try_element_at(first, F.lit(1)), "content")), F.lit(""))


def parse_pages(pages: DataFrame, keep: list[str], text_chars: int | None = tx.PAGE_TEXT_CHARS) -> DataFrame:
    """``keep`` columns and the parsed signals of each page's ``html``; a null page is an empty one. The body begins with its tag, the head's end, or what can't be in a head; script and style in it count as text.

    An audit counts a page's text to ``text_chars``; None gives it whole.
    """
    one = pages.select(*keep, F.coalesce("html", F.lit("")).alias("__html")).withColumn("tokens", tokens(c("__html")))
    start = lambda t: F.when(t["kind"] == "raw", F.regexp_extract(t["raw"], rf"(?is)^<[a-z]+(?:\s{_REST}|>|/>)", 0)).otherwise(t["raw"])
    tag = lambda t: F.struct(t["name"].alias("name"), F.slice(F.regexp_extract_all(start(t), F.lit(ATTRIBUTE), F.lit(0)), 2, 1 << 20).alias("attributes"), F.when(t["name"] == "script", t["raw"]).alias("script"))
    one = one.withColumn("__tags", F.transform(F.filter("tokens", lambda t: t["kind"].isin("open", "raw")), tag))
    begins = F.filter("tokens", lambda t: (t["kind"].isin("open", "raw") & ~t["name"].isin(*HEAD)) | ((t["kind"] == "close") & (t["name"] == "head")) | ((t["kind"] == "text") & t["raw"].rlike("[^\\s]")))
    one = one.withColumns({
        "__attributes": F.flatten(F.transform("__tags", lambda t: t["attributes"])), "__body": F.coalesce(F.try_element_at(begins, F.lit(1))["at"], F.size("tokens")),
        "__links": F.filter(F.transform(_of("a"), lambda t: decoded(attribute(t, "href"))), lambda h: h.isNotNull()), "__img": F.transform(_of("img"), lambda t: attribute(t, "alt")),
    } | {f"__{h}": _inside(h) for h in HEADINGS})
    texts = F.filter(F.slice("tokens", c("__body") + 1, F.greatest(F.size("tokens"), F.lit(1))), lambda t: t["kind"].isin("text", "raw"))
    text = tx.normalize_text(F.array_join(F.transform(texts, said), ""))
    titles = F.filter("tokens", lambda t: (t["name"] == "title") & (t["kind"] == "raw"))
    canonical = F.filter(_of("link"), lambda t: F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))) == "canonical")
    scripts = F.filter("__tags", lambda t: (t["name"] == "script") & (F.lower(F.coalesce(attribute(t["attributes"], "type"), F.lit(""))) == "application/ld+json"))
    filled = lambda h: F.filter(f"__{h}", lambda x: x != "")
    has = lambda pattern: F.exists("__attributes", lambda a: a.rlike(pattern))
    out = one.select(
        *keep, F.coalesce(tx.normalize_text(said(F.try_element_at(titles, F.lit(1)))), F.lit("")).alias("title"), tx.normalize_text(_meta("description")).alias("meta_description"),
        F.nullif(decoded(attribute(F.try_element_at(canonical, F.lit(1)), "href")), F.lit("")).alias("canonical"), _meta("robots").alias("robots_meta"), *(filled(h).alias(h) for h in ("h1", "h2", "h3")),
        (text if text_chars is None else F.substring(text, 1, text_chars)).alias("text"), c("__links").alias("links"), F.size("__img").alias("image_count"),
        F.size(F.filter("__img", lambda a: tx.normalize_text(decoded(a)) != "")).alias("images_with_alt"), F.size(_of("input", "textarea", "select")).alias("inputs"), F.size(_of("label")).alias("labels"),
        F.size(F.filter("__attributes", lambda a: a.rlike(r"(?i)^aria-label(?:[\s=]|$)"))).alias("aria_labels"), (c("__html").rlike(LANDMARK_TAG) | has(rf"""^(?i:role)\s*=\s*["']?(?:{'|'.join(LANDMARK_ROLES)})["']?$""")).alias("has_landmarks"), has(r"(?is)^(?:class|id)\s*=.*faq").alias("faq_markup"),
        sum((F.size(F.filter(f"__{h}", lambda x: x.endswith("?"))) for h in ("h2", "h3", "h4", "dt")), F.lit(0)).alias("question_headings"), (F.size(_of("form")) > 0).alias("has_form"),
        F.exists("__links", lambda x: x.startswith("tel:")).alias("has_tel_link"), F.exists("__links", lambda x: x.startswith("mailto:")).alias("has_mail_link"),
        F.filter(F.transform(scripts, lambda t: F.regexp_replace(content(t["script"]), r"^\s+|\s+$", "")), lambda b: b != "").alias("__blocks"),
    )
    return jsonld.with_nodes(out, "__blocks").drop("__blocks")


def page_links(parsed: DataFrame, root: str = "url") -> DataFrame:
    """``(url, target)``: the distinct pages of the same site that a page links to."""
    found = parsed.select("url", c(root).alias("__root"), F.explode("links").alias("href"))
    found = found.select("url", "__root", urls.resolved(c("href"), c("url")).alias("target")).where(c("target").isNotNull())
    return found.where(urls.same_site(c("target"), c("__root")) & urls.looks_like_page(c("target"))).select("url", "target").distinct()
