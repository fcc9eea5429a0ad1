"""Text expressions. Python strings hold the patterns, so that column expressions and Arrow functions share them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that page text is collapsed on.
SPACE = "[ \\t\\n\\r\\f\\x0B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
# Contact patterns.
PHONE = r"(?:\+?1[-. \t\n\r\f\x0B]?)?(?:\(?[0-9]{3}\)?[-. \t\n\r\f\x0B]?)[0-9]{3}[-. \t\n\r\f\x0B]?[0-9]{4}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PAGE_TEXT_CHARS, SITE_TEXT_CHARS = 250_000, 1_500_000


def normalize_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Signs of ASCII, and one blank before them, are passed over without a look at the long class."""
    return F.trim(F.regexp_replace(c, f"(?![!-~]| [!-~]){SPACE}", " "))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def word_count(c: Column) -> Column:
    """Words of a normalised text."""
    return F.size(F.array_remove(F.split(c, " "), "")).cast("long")


def distinct_matches(c: Column, pattern: str) -> Column:
    """Matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit("(?i)" + pattern))


def alternatives(pattern: str) -> list[str]:
    """What a pattern's bars part, but for those in groups and classes; a group around all of it goes."""
    whole = re.fullmatch(r"\(\?:([^()]*)\)", pattern)
    out, depth = [""], 0
    for part in re.findall(r"(?s)\\.|\[(?:\\.|[^\]\\])*\]|.", whole[1] if whole else pattern):
        depth += (part == "(") - (part == ")")
        out = [*out, ""] if part == "|" and depth == 0 else [*out[:-1], out[-1] + part]
    return out


def folded(c: Column) -> Column:
    """A text to look up ASCII words in, whatever their case. Two other characters have small letters in ASCII; as for ``matches``, they aren't these letters."""
    return F.lower(F.replace(F.replace(c, F.lit("\u212A"), F.lit("\uFFFD")), F.lit("\u0130"), F.lit("\uFFFD")))


def mentions(c: Column, low: Column, pattern: str) -> Column:
    """``matches``, where ``low`` holds ``folded(c)``: plain words are looked up, the rest of the pattern is matched only against texts with the letters that it begins with. No alternative may refer to another's groups."""
    parts = alternatives(pattern)
    plain = [p.lower() for p in parts if re.fullmatch("[A-Za-z0-9 &/-]+", p)]
    tests = [F.contains(low, F.lit(p)) for p in dict.fromkeys(plain) if not any(q in p and q != p for q in plain)]
    for p in (p for p in parts if not re.fullmatch("[A-Za-z0-9 &/-]+", p)):
        begins = re.match(r"(?:\(\?<!\[[^]]*\]\))?([A-Za-z0-9 &/-]*)([?*+{]?)", p)
        letters = (begins[1][:-1] if begins[2] else begins[1]).lower()
        tests.append(F.contains(low, F.lit(letters)) & matches(c, p) if letters else matches(c, p))
    return reduce(or_, tests)


def slugify(c: Column, most: int | None = None, default: str | None = None) -> Column:
    """Lower-case words of letters and digits joined by hyphens."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "(^-|-$)", "")
    out = F.substring(out, 1, most) if most else out
    return F.when(out == "", F.lit(default)).otherwise(out) if default else out


def rounded(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + F.lit(0.5)).cast("int")


def percent(c: Column) -> Column:
    return F.concat(rounded(F.coalesce(c, F.lit(0.0)) * 100.0).cast("string"), F.lit("%"))


def cut_bytes(c: Column, most: int) -> Column:
    """The first bytes of a text as UTF-8; a character that the cut parts becomes U+FFFD."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.make_valid_utf8(F.substring(c.cast("binary"), 1, most).cast("string")))


def url_encode(c: Column) -> Column:
    """Percent-encoded but for letters, digits and ``-_.!~*'()``."""
    c = F.url_encode(c)
    for sent, kept in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(sent), F.lit(kept))
    return c


def iso_time(c: Column) -> Column:
    """A timestamp in UTC to the millisecond, whatever the session's time zone."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_millis(c) / F.lit(1000).cast("decimal(4,0)"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_day(c: Column) -> Column:
    """Its day in UTC."""
    return F.substring(iso_time(c), 1, 10)


def js_length(c: Column) -> Column:
    """UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def access_digest(password: Column, prefix: str = "audit-access") -> Column:
    return F.sha2(F.concat(F.lit(prefix + ":"), password), 256)
