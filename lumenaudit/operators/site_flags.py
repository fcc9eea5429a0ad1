"""What the joined text of a site says, without joining it: flags of pages, and of the seams between neighbours.

A site's text is its pages' texts in order, joined by line ends and cut at a limit. Patterns whose matches hold no line end are found within a page. The others can match across a seam only by their white space:
what stands before it ends a page, what follows begins the next one that isn't blank. So a page sends a few booleans and a length, and its text stays where it is; only the page that the limit cuts is looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.operators.ordered import running
from lumenaudit.operators.sites_text import SEAMS
from lumenaudit.sources.storage import spread, stored

c = F.col
#: Cut pages, one a site at most, that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
BLANKS = "[ \\n]*"
#: More than what stands before a seam can be long.
END_CHARS = 16


def _low(rows: DataFrame) -> DataFrame:
    """``text`` with what ``_tests`` reads many times: its folded form, and its end without blanks."""
    return rows.withColumns({"__low": tx.folded(c("text")), "__end": F.right(F.rtrim("text", F.lit(" \n")), F.lit(END_CHARS))})


def _tests(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Whether a text of ``_low`` matches, and how it stands at its seams."""
    out = {f"f_{k}": tx.mentions(text, c("__low"), p) for k, p in patterns.items()}
    for k in SEAMS.keys() & patterns.keys():
        before, after = SEAMS[k]
        out |= {f"e_{k}": tx.matches(c("__end"), f"(?:{before})\\z"), f"s_{k}": tx.matches(text, f"\\A{BLANKS}(?:{after})")}
    return out


def site_flags(pages: DataFrame, patterns: dict[str, str], most: int = tx.SITE_TEXT_CHARS) -> DataFrame:
    """``site_id, chars``, and whether each pattern matches the first ``most`` characters of a site's text. pages: ``site_id, ord, text``.

    Null texts are left out. Pages of one ``ord``, or without one (they come last), follow the order of their texts' hashes; repeated pages each count. Sites without texts have no row."""
    rows = pages.where("text IS NOT NULL").select("site_id", "ord", F.xxhash64("text").alias("tie"), "text")
    seams = sorted(SEAMS.keys() & patterns.keys())
    # stored, as a range sort looks at its rows twice: the patterns are searched for once
    lean = stored(_low(spread(rows)).select("site_id", "ord", "tie", (F.length("text").cast("long")).alias("n"), (c("__end") == "").alias("blank"), *(v.alias(k) for k, v in _tests(c("text"), patterns).items())))
    placed = running(lean, "site_id", [c("ord"), c("tie")], sums={"begin": c("n") + 1}, lasts={f"before_{k}": F.when(~c("blank"), c(f"e_{k}")) for k in seams})
    inside = placed.where(c("begin") < most)
    cut = inside.where(c("begin") + c("n") > most).select("site_id", "ord", "tie", (most - c("begin")).cast("int").alias("room"))
    whole = inside.where(c("begin") + c("n") <= most)
    flags = [whole.select("site_id", *(F.coalesce(c(f"f_{k}") | (c(f"before_{k}") & c(f"s_{k}")), c(f"f_{k}")).alias(k) if k in seams else c(f"f_{k}").alias(k) for k in patterns))]
    n_cut = cut.limit(MOST_BROADCAST + 1).count()
    if n_cut:
        # one page a site, so little; its text is read again
        small = F.broadcast(cut) if n_cut <= MOST_BROADCAST else cut
        r, s = rows.alias("r"), small.alias("s")
        again = r.join(s, (c("r.site_id") == c("s.site_id")) & c("r.ord").eqNullSafe(c("s.ord")) & (c("r.tie") == c("s.tie"))).select("r.site_id", F.substring("text", F.lit(1), c("room")).alias("text"))
        at_seam = inside.where(c("begin") + c("n") > most).select("site_id", *(F.coalesce(f"before_{k}", F.lit(False)).alias(f"before_{k}") for k in seams))
        tested = _low(again).withColumns(_tests(c("text"), patterns)).drop("text", "__low", "__end").join(at_seam, "site_id")
        flags.append(tested.select("site_id", *((c(f"f_{k}") | (c(f"before_{k}") & c(f"s_{k}"))).alias(k) if k in seams else c(f"f_{k}").alias(k) for k in patterns)))
    every = flags[0] if len(flags) == 1 else flags[0].unionByName(flags[1])
    lengths = placed.groupBy("site_id").agg(F.least(F.lit(most), F.max(c("begin") + c("n"))).cast("int").alias("chars"))
    return lengths.join(every.groupBy("site_id").agg(*(F.bool_or(k).alias(k) for k in patterns)), "site_id", "left")


def city_mentions(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``site_id`` of sites whose city a page's text names, whatever the case. sites: ``site_id, city``. Only sites with a city take part; a city's name has no line end, so it stands within a page."""
    asked = sites.where(F.trim("city") != "").select("site_id", F.lower("city").alias("city"))
    return pages.select("site_id", "text").join(asked, "site_id").where(F.contains(F.lower("text"), c("city"))).select("site_id").distinct()


def text_sample(pages: DataFrame, most: int = 15_000) -> DataFrame:
    """``site_id, sample``: the first ``most`` characters of each site's text. Texts that begin later, and what stands later in a text, don't travel beyond the join that picks them."""
    rows = pages.where("text IS NOT NULL AND site_id IS NOT NULL").select("site_id", "ord", F.xxhash64("text").alias("tie"), "text")
    lean = rows.select("site_id", "ord", "tie", F.length("text").cast("long").alias("n"))
    placed = running(lean, "site_id", [c("ord"), c("tie")], sums={"begin": c("n") + 1}).where(c("begin") <= most)
    picked = placed.groupBy("site_id", "ord", "tie").agg(F.collect_list("begin").alias("begins")).alias("p")  # repeated pages: one text, several places
    r = rows.select("site_id", "ord", "tie", F.substring("text", 1, most).alias("text")).alias("r")
    found = r.join(picked, (c("r.site_id") == c("p.site_id")) & c("r.ord").eqNullSafe(c("p.ord")) & (c("r.tie") == c("p.tie"))).select("r.site_id", "r.ord", "r.tie", "text", "begins").dropDuplicates(["site_id", "ord", "tie"])
    parts = found.select("site_id", F.explode("begins").alias("begin"), "text")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"])
    return parts.groupBy("site_id").agg(F.substring(F.array_join(whole, "\n"), 1, most).alias("sample"))
