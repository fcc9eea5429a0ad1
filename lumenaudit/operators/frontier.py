"""The crawl frontier over a snapshot: seeds, priorities, sitemaps, and a replay of the crawl per site."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions import urls
from lumenaudit.sources.storage import stored

LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"
INDEX = r"(?i)<sitemapindex[\s>]"


def sitemap_locs(files: DataFrame) -> DataFrame:
    """``(site_id, is_index, loc)``: the locations of sitemap documents ``(site_id, body)``, trimmed, once each."""
    index = F.coalesce("body", F.lit("")).rlike(INDEX)
    loc = F.explode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1)))
    # the kind is told before the body is unfolded: beside the locations it would be searched, and the body copied, for each of them
    return files.select("site_id", "body", index.alias("is_index")).select("site_id", "is_index", loc.alias("loc")).distinct()


def sitemap_tree(files: DataFrame, roots: DataFrame, most_children: int = 15, listed: DataFrame | None = None) -> DataFrame:
    """``(site_id, url)``: page URLs of sitemaps reached from ``roots (site_id, url)`` and from further ``listed`` ones (those that robots.txt names). files: ``site_id, url, body``.

    Indexes are followed level by level, in order of URL within one. But for the roots a site's sitemaps count against ``most_children``, whether or not there is such a file."""
    links = stored(_locations(files))  # bodies are read once, whatever the depth
    below = links.where("is_index").select("site_id", "url", F.col("loc").alias("below"))
    level = roots.select("site_id", "url").distinct()
    known = level.withColumn("counts", F.lit(False))
    for depth in range(most_children + 1):
        waiting = below.join(level, ["site_id", "url"]).select("site_id", F.col("below").alias("url"))
        if depth == 0 and listed is not None:
            waiting = waiting.unionByName(listed.select("site_id", "url"))
        taken = known.where("counts").groupBy("site_id").agg(F.count("*").alias("taken"))
        fresh = waiting.distinct().join(known, ["site_id", "url"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("url")))
        level = stored(fresh.join(taken, "site_id", "left").where(F.col("n") + F.coalesce("taken", F.lit(0)) <= most_children).select("site_id", "url"))
        if level.limit(1).count() == 0:
            break
        known = known.unionByName(level.withColumn("counts", F.lit(True)))
    return links.where("NOT is_index").join(known, ["site_id", "url"], "left_semi").select("site_id", F.col("loc").alias("url")).distinct()


def _locations(docs: DataFrame) -> DataFrame:
    """``(site_id, url, loc, is_index)``: the locations of sitemaps; relative ones are taken from the origin where the documents have one."""
    found = docs.withColumn("is_index", F.col("body").rlike(INDEX)).withColumn("found", F.explode(F.regexp_extract_all("body", F.lit(LOC), F.lit(1))))  # in this order, as in sitemap_locs
    loc = urls.absolute(F.col("found"), F.col("origin")) if "origin" in docs.columns else F.col("found")
    return found.select("site_id", "url", loc.alias("loc"), "is_index").where("loc IS NOT NULL").distinct()


def seeds(start_urls: DataFrame, sitemap: DataFrame) -> DataFrame:
    """``(site_id, url, priority)``: the start URL and the site's pages of its sitemap, each once. start_urls: ``site_id, start_url``; sitemap: ``site_id, url``."""
    own = start_urls.select("site_id", urls.canonical(F.col("start_url")).alias("url"))
    mapped = sitemap.join(start_urls, "site_id").where(urls.same_site(F.col("url"), F.col("start_url")) & urls.looks_like_page(F.col("url"))).select("site_id", urls.canonical(F.col("url")).alias("url"))
    return own.unionByName(mapped).distinct().withColumn("priority", urls.priority(F.col("url")))


def enqueue(found: DataFrame, queued: DataFrame, start_urls: DataFrame) -> DataFrame:
    """What of ``found (site_id, url)`` enters the frontier: pages of the site that aren't queued yet."""
    fits = found.join(start_urls, "site_id").where(urls.same_site(F.col("url"), F.col("start_url")) & urls.looks_like_page(F.col("url"))).select("site_id", "url").distinct()
    return fits.join(queued.select("site_id", "url"), ["site_id", "url"], "left_anti")


def stop_reason(pages: Column, most_pages: Column, out_of_time: Column) -> Column:
    return F.when(pages >= most_pages, "page_limit").when(out_of_time, "time_limit").otherwise("queue_empty")


def replay(edges: DataFrame, starts: DataFrame, *, most_pages: int = 250) -> DataFrame:
    """The order in which a crawl takes a snapshot's pages: ``(site_id, ord, url, status)``, status ``page``, ``error`` (not in the snapshot) or ``blocked``.

    starts: ``site_id, url, priority, rank`` (seeds in order). edges: ``site_id, url, found, blocked, targets (array<struct<url,priority>>)``. A crawl is sequential, so
    a task replays one site; a site takes part with 4 times ``most_pages`` queued URLs at most."""

    def run(key, start: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        known = {r.url: r for r in page.itertuples()}
        start = start.sort_values("rank")
        queue: list[tuple[int, int, str]] = []
        seen: set[str] = set()
        tick = 0

        def push(url: str, priority: int) -> None:
            nonlocal tick
            if url not in seen:
                seen.add(url)
                heapq.heappush(queue, (-priority, tick, url))
                tick += 1

        for r in start.itertuples():
            push(r.url, r.priority)
        out, pages = [], 0
        while queue and pages < most_pages:
            url = heapq.heappop(queue)[2]
            row = known.get(url)
            status = "error" if row is None or not row.found else "blocked" if row.blocked else "page"
            out.append((key[0], len(out), url, status))
            if status != "page":
                continue
            pages += 1
            for t in row.targets if row.targets is not None else ():
                if pages + len(queue) >= 4 * most_pages:
                    break
                push(t["url"], t["priority"])
        return pd.DataFrame(out, columns=["site_id", "ord", "url", "status"])

    starts = starts.select(*(F.col(n).alias(n) for n in starts.columns))  # columns of its own, as both sides may come from one table
    return starts.groupBy("site_id").cogroup(edges.groupBy("site_id")).applyInPandas(run, "site_id string, ord int, url string, status string")
