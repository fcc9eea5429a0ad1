"""Queries over operators that the other registries leave out: action plans of varied sites, auxiliary files, the frontier, the limiter, event lines and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.functions import urls
from lumenaudit.operators import frontier, redirects, tasks
from lumenaudit.operators.scoring import CATEGORIES, ORDER, VERTICALS
from lumenaudit.plans import audit as whole
from lumenaudit.plans.registry import DOMAIN, ORACLES, c, page_links_same_site, plan_pages, query
from lumenaudit.plans.report_queries import FOUND_SQL, POINTS, VARIED, scored
from lumenaudit.sources.storage import shared_folder, stored
from lumenaudit.sources.tables import table
from lumenaudit.streaming import progress as stream


def _status(rule: str) -> str:
    if rule.startswith("r:"):
        return f"CASE WHEN {rule[2:]} >= 0.85 THEN 'passed' WHEN {rule[2:]} >= 0.55 THEN 'partial' ELSE 'failed' END"
    if rule.startswith("n:"):
        return f"CASE WHEN {rule[2:]} IS NULL THEN 'unknown' WHEN {rule[2:]} >= 80 THEN 'passed' WHEN {rule[2:]} >= 50 THEN 'partial' ELSE 'failed' END"
    return f"CASE WHEN {rule} THEN 'passed' ELSE 'failed' END"


def _open_checks() -> str:
    """The checks of all sites that didn't pass, in SQL; a vertical's only for its sites."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for cat, key in enumerate(ORDER):
        for kind in (*(k for k, _ in VERTICALS), "general") if key == "vertical_readiness" else (key,):
            only = f" WHERE vertical = '{kind}'" if key == "vertical_readiness" else ""
            name, checks = CATEGORIES[kind]
            for n, ((points, rule), check) in enumerate(zip(POINTS[kind], checks, strict=True)):
                parts.append(f"SELECT site_id, {cat} AS cat, {n} AS n, {text(name)} AS source, {key} AS score, {points} AS most, {_status(rule)} AS status, {text(check.label)} AS label FROM s{only}")
    return " UNION ALL ".join(parts)


SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g')"
ACTION = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(said, {w!r})' for w in words)} THEN '" + action.replace("'", "''") + "'" for words, action in tasks.ACTIONS)
ACTION += f" ELSE '{tasks.OTHER_ACTION[0]}' || source || '{tasks.OTHER_ACTION[1]}' END"


@query(f"""{VARIED}, o AS (SELECT *, row_number() OVER (PARTITION BY site_id, cat ORDER BY n) - 1 AS pos, lower(label || ' ' || source) AS said FROM ({_open_checks()}) WHERE status <> 'passed'),
i AS (SELECT *, CASE WHEN most >= 16 OR score < 55 OR status = 'failed' THEN 'High' WHEN most >= 8 OR status = 'partial' THEN 'Medium' ELSE 'Low' END AS impact FROM o),
t AS (SELECT *, (row_number() OVER (PARTITION BY site_id ORDER BY CASE impact WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, cat, pos) - 1)::INT AS ord FROM i)
SELECT site_id, ord, 'category-' || {SLUG.format('source')} || '-' || pos || '-' || {SLUG.format('label')} AS id, label AS title, {ACTION} AS detail, impact, CASE WHEN most >= 16 THEN '1-2 days' ELSE '2-4 hours' END AS effort, source FROM t WHERE ord < 28""")
def category_tasks_topk(spark: SparkSession, sf: str) -> DataFrame:
    return tasks.category_tasks(scored(spark, sf)).select("site_id", "ord", "id", "title", "detail", "impact", "effort", "source")


@query(f"""{FOUND_SQL}, e AS (SELECT site_id, 0 AS part, ord AS n, 'finding-' || id AS id, id AS same, CASE severity WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS impact, CASE severity WHEN 'high' THEN 'This week' ELSE 'Next sprint' END AS effort, category AS source FROM f WHERE ord < 8
UNION ALL SELECT site_id, 1, 0, 'roadmap-0-0', 'fix|do it', 'High', 'Now', 'Recommended Roadmap' FROM s WHERE k % 2 = 0 UNION ALL SELECT site_id, 1, 1, 'roadmap-0-1', 'fix|do it', 'High', 'Now', 'Recommended Roadmap' FROM s WHERE k % 2 = 0
UNION ALL SELECT site_id, 1, 2, 'roadmap-2-0', 'later', 'Low', 'Phase 3', 'Recommended Roadmap' FROM s WHERE k % 2 = 0),
m AS (FROM e UNION ALL SELECT site_id, 2, 0, 'general-maintain', 'maintain', 'Medium', 'Ongoing', 'Diagnostic' FROM s WHERE site_id NOT IN (SELECT site_id FROM e)),
d AS (SELECT *, row_number() OVER (PARTITION BY site_id, same ORDER BY part, n) AS r FROM m)
SELECT site_id, (row_number() OVER (PARTITION BY site_id ORDER BY part, n) - 1)::INT AS ord, id, impact, effort, source FROM d WHERE r = 1""")
def general_tasks_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of findings and of a roadmap that repeats an action in other letters."""
    s = stored(scored(spark, sf).select("site_id", "k", "findings"))
    row = "struct<phase_no:int,phase:string,title:string,action_no:int,action:string>"
    actions = F.expr(f"CAST(array(struct(0, 'Now', 'Fix', 0, 'Do it'), struct(0, 'Now', 'fix', 1, 'do IT'), struct(2, '', '', 0, 'Later')) AS array<{row}>)")
    roadmap = s.where("k % 2 = 0").select("site_id", F.explode(actions).alias("a")).select("site_id", "a.*")
    return tasks.general_tasks(s, roadmap).select("site_id", "ord", "id", "impact", "effort", "source")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, true AS accepted, [t] AS log FROM e WHERE n = 1 UNION ALL
SELECT event_id, user_id, n, len(l) < 3, CASE WHEN len(l) < 3 THEN list_append(l, t) ELSE l END FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.t - 43200000) AS l FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT event_id, user_id, accepted FROM r""")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(c("ts").cast("timestamp")).alias("at_ms"))
    return stream.rate_limit(e, client="user_id", at_ms="at_ms", tie="event_id", window_ms=12 * 3_600_000, most=3).select("event_id", "user_id", "accepted")


#: Sitemaps of a site's pages: with the one that robots.txt names as many as an audit follows. Each counts up to its byte limit.
PARTS = 14


@query(f"""WITH p AS (SELECT DISTINCT {DOMAIN} AS site_id, page_id FROM pages), n AS (SELECT site_id, min(page_id) AS k, count(*) AS pages FROM p GROUP BY 1)
SELECT site_id, k % 3 > 0 AS robots_found, k % 2 = 0 AS llms_found, CASE WHEN k % 2 = 0 THEN least(500000, k * 7001 % 600000 + 1) ELSE 0 END::INT AS llms_length, k % 5 > 0 OR k % 3 > 0 AS sitemap_found,
(CASE WHEN k % 5 > 0 THEN pages ELSE 0 END + CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END)::INT AS sitemap_urls FROM n""")
def audit_auxiliary(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with files of each kind: a sitemap index that names the sitemaps of all pages, as many as an audit follows, and one of a single page that only robots.txt names."""
    p = table(spark, sf, "pages").select(urls.domain(c("url")).alias("site_id"), "page_id")
    loc = F.concat(F.lit("<loc> /p/"), c("page_id").cast("string"), F.lit(" </loc>"))
    n = p.groupBy("site_id").agg(F.min("page_id").alias("k"))
    parts = p.groupBy("site_id", F.pmod("page_id", F.lit(PARTS)).alias("part")).agg(F.array_join(F.collect_set(loc), "\n").alias("locs")).where("part IS NOT NULL")
    home = F.concat(F.lit("https://"), "site_id")
    sites = n.select("site_id", F.concat(home, F.lit("/")).alias("start_url"))
    robots = n.where("k % 3 > 0").select("site_id", F.concat(F.lit("User-agent: *\nSitemap: "), home, F.lit("/more.xml")).alias("body"))
    llms = n.where("k % 2 = 0").select("site_id", F.repeat(F.lit("x"), (c("k") * 7001 % 600_000 + 1).cast("int")).alias("body"))
    file = lambda rows, name, body: rows.select("site_id", F.concat(home, F.lit(name)).alias("url"), F.concat(*(F.lit(b) if isinstance(b, str) else b for b in body)).alias("body"))
    named = "".join(f"<loc>/pages{k}.xml</loc>" for k in range(PARTS))
    main = file(n.where("k % 5 > 0"), "/sitemap.xml", (f"<sitemapindex>{named}<loc>/sitemap.xml</loc></sitemapindex>",))
    listed = parts.select("site_id", F.concat(home, F.lit("/pages"), c("part").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "locs", F.lit("<loc>mailto:x</loc></urlset>")).alias("body"))
    files = main.unionByName(listed).unionByName(file(n, "/more.xml", ("<urlset><loc>https://", c("site_id"), "/more</loc></urlset>",)))
    return whole.auxiliary(sites, robots, llms, files).select("site_id", "robots_found", "llms_found", "llms_length", "sitemap_found", "sitemap_urls")


@query(f"""WITH u AS (SELECT p.page_id, {DOMAIN} AS site_id, canonical, html_like FROM pages p JOIN ({ORACLES['url_domain_canonical']}) USING (page_id))
SELECT DISTINCT site_id, canonical AS url FROM u WHERE html_like UNION SELECT DISTINCT site_id, 'https://' || site_id FROM u""")
def frontier_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The seeds of crawls whose sitemaps list all sites' pages: those of other sites don't enter."""
    p = table(spark, sf, "pages").select(urls.domain(c("url")).alias("site_id"), "url")
    starts = p.select("site_id", F.concat(F.lit("https://"), "site_id", F.lit("/")).alias("start_url")).distinct()
    foreign = p.select("site_id", F.lit("https://elsewhere.example/x").alias("url"))
    return frontier.seeds(starts, p.unionByName(foreign)).select("site_id", "url")


@query(f"""WITH l AS (SELECT DISTINCT {DOMAIN} AS site_id, target AS url FROM pages JOIN ({ORACLES['page_links_same_site']}) USING (page_id)), q AS (SELECT canonical AS url FROM ({ORACLES['url_domain_canonical']}))
SELECT site_id, url FROM l WHERE url NOT IN (SELECT url FROM q WHERE url IS NOT NULL)""")
def frontier_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the snapshot's pages that aren't pages of it."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.domain(c("url")).alias("site_id"))
    found = page_links_same_site(spark, sf).join(p.select("page_id", "site_id"), "page_id").select("site_id", c("target").alias("url"))
    starts = p.select("site_id", F.concat(F.lit("https://"), "site_id", F.lit("/")).alias("start_url")).distinct()
    return frontier.enqueue(found, p.select("site_id", urls.canonical(c("url")).alias("url")).distinct(), starts)


@query("""SELECT o_custkey AS site_id, CASE WHEN count(*) >= 12 THEN 'page_limit' WHEN max(o_orderkey) % 2 = 0 THEN 'time_limit' ELSE 'queue_empty' END AS stopped_by FROM orders GROUP BY 1""")
def crawl_stop_reason(spark: SparkSession, sf: str) -> DataFrame:
    crawls = table(spark, sf, "orders").groupBy(c("o_custkey").alias("site_id")).agg(F.count("*").alias("pages"), (F.max("o_orderkey") % 2 == 0).alias("late"))
    return crawls.select("site_id", frontier.stop_reason(c("pages"), F.lit(12), c("late")).alias("stopped_by"))


@query("""SELECT user_id AS run_id, count(*) AS events, sum(event_id)::BIGINT AS crawled, CASE WHEN user_id % 4 > 0 THEN '{"run":' || user_id || '}' END AS data, CASE WHEN user_id % 4 = 0 THEN 'stopped "here"' END AS error FROM events GROUP BY 1""")
def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The events of runs written as JSON lines and read again."""
    e = table(spark, sf, "events").select(c("user_id").alias("run_id"), c("event_id").alias("seq"), F.lit("crawl").alias("stage"), c("event_id").alias("crawled"))
    failed = c("run_id") % 4 == 0
    ends = e.select("run_id").distinct().select("run_id", F.when(~failed, F.concat(F.lit('{"run":'), c("run_id").cast("string"), F.lit("}"))).alias("data"), F.when(failed, 'stopped "here"').alias("error"))
    folder = shared_folder(spark)
    stream.save_lines(stream.lines(e, ends), folder)
    back = stream.parse_events(spark.read.schema("run_id long, value string").json(folder))
    said = back.groupBy("run_id").agg(F.count_if(c("type") == "progress").alias("events"), F.sum("crawled").alias("crawled"))
    return said.join(stream.outcome(back.withColumn("seq", F.coalesce("crawled", F.lit((1 << 63) - 1)))), "run_id")


ENCODED = "url_encode({})"
for _sent, _kept in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    ENCODED = f"replace({ENCODED}, '{_sent}', '{_kept}')"


@query(f"SELECT doc_id, sha256({ENCODED.format('text')}) AS encoded FROM documents")
def url_encoded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.url_encode(c("text")), 256).alias("encoded"))


@query("SELECT event_id, strftime(epoch_ms(m), '%Y-%m-%dT%H:%M:%S.%gZ') AS at, strftime(epoch_ms(m), '%Y-%m-%d') AS day FROM (SELECT event_id, event_id * 86399977 % 1800000000000 AS m FROM events)")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    at = F.timestamp_millis(c("event_id") * 86_399_977 % 1_800_000_000_000)
    return table(spark, sf, "events").select("event_id", tx.iso_time(at).alias("at"), tx.iso_day(at).alias("day"))


@query("""WITH h AS (SELECT doc_id, text, least(octet_length(encode(text)), 100) AS n FROM documents) SELECT doc_id, n::INT AS bytes, octet_length(encode(text)) > 100 AS cut FROM h""")
def byte_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Texts up to 100 bytes; a parted character counts as the bytes it had."""
    kept = tx.cut_bytes(c("text"), 100)
    tail = F.when(kept.endswith("�") & ~F.contains("text", F.lit("�")), F.lit(100)).otherwise(F.octet_length(kept))
    return table(spark, sf, "documents").select("doc_id", tail.alias("bytes"), (F.octet_length("text") > 100).alias("cut"))


# customers' keys as URLs: chains of eight, some that loop, ends without location, and locations out of the snapshot
HOPS_SQL = """SELECT c_custkey AS k, 'https://e.com/' || c_custkey AS url, CASE WHEN c_custkey % 8 = 0 AND c_custkey % 3 > 0 THEN 200 WHEN c_custkey % 11 = 5 THEN 404 ELSE 302 END AS status,
CASE WHEN c_custkey % 8 = 0 AND c_custkey % 3 > 0 OR c_custkey % 11 = 5 OR c_custkey % 13 = 4 THEN NULL WHEN c_custkey % 8 = 0 THEN 'https://e.com/' || (c_custkey + 2) WHEN c_custkey % 17 = 6 THEN 'https://f.com/' || c_custkey ELSE 'https://e.com/' || (c_custkey - 1) END AS goes FROM customer"""
FOLLOWED_SQL = f"""WITH RECURSIVE a AS ({HOPS_SQL}), r AS (SELECT url, url AS here, 0 AS hops FROM a UNION ALL SELECT r.url, a.goes, hops + 1 FROM r JOIN a ON a.url = r.here WHERE a.goes IS NOT NULL AND hops < 5),
l AS (SELECT url, here, hops FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY hops DESC) = 1), f AS (SELECT l.url, l.here AS final_url, hops::INT AS hops, coalesce(a.status, 0)::INT AS status, a.goes, coalesce(a.status, 0) = 200 AS ok FROM l LEFT JOIN a ON a.url = l.here)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    k = c("c_custkey")
    end = (k % 8 == 0) & (k % 3 > 0)
    status = F.when(end, 200).when(k % 11 == 5, 404).otherwise(302)
    goes = F.when(end | (k % 11 == 5) | (k % 13 == 4), None).when(k % 8 == 0, F.concat(F.lit("../"), k + 2)).when(k % 17 == 6, F.concat(F.lit("//F.com:443/x/../"), k)).otherwise(F.concat(F.lit("./"), k - 1, F.lit("#x")))
    return table(spark, sf, "customer").select(F.concat(F.lit("https://e.com/"), k).alias("url"), status.alias("status"), goes.alias("location"))


@query(FOLLOWED_SQL + """ SELECT url, final_url, hops, status, ok, CASE WHEN goes IS NOT NULL THEN 'Too many redirects' WHEN status = 302 THEN 'Redirect without Location header' WHEN status = 0 THEN 'Not in the snapshot' END AS error FROM f""")
def redirects_followed(spark: SparkSession, sf: str) -> DataFrame:
    return redirects.followed(answers(spark, sf))


@query(FOLLOWED_SQL + " SELECT final_url, count(*) AS urls, min(url) AS first_url FROM f WHERE ok GROUP BY 1 HAVING count(*) > 1")
def redirects_same_end(spark: SparkSession, sf: str) -> DataFrame:
    return redirects.same_end(redirects.followed(answers(spark, sf)))


PAGE_TASKS_SQL = ORACLES["page_plan"].replace("SELECT site_id, page_id, n::INT AS n_tasks", "SELECT site_id, n, thin::INT + CASE WHEN u THEN 0 ELSE 1 END AS high").replace("greatest(0, r)::INT AS readiness, CASE WHEN thin OR NOT u THEN 'High' ELSE 'Medium' END AS priority, ", "")


@query(f"""WITH g AS ({ORACLES["general_tasks_dedupe"]}), c AS ({ORACLES["category_tasks_topk"]}), p AS ({PAGE_TASKS_SQL}),
e AS (SELECT site_id, 1 AS n, (impact = 'High')::INT AS high FROM g WHERE ord < 14 UNION ALL SELECT site_id, 1, (impact = 'High')::INT FROM c UNION ALL SELECT site_id, n, high FROM p)
SELECT site_id, sum(n)::BIGINT AS total_tasks, sum(high)::BIGINT AS high_impact_tasks FROM e GROUP BY 1""")
def action_plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All three parts of the plan together: general and category tasks of the customers' sites, page plans of the snapshot's."""
    s = stored(scored(spark, sf).select("site_id", "k", "categories", "findings"))
    row = "struct<phase_no:int,phase:string,title:string,action_no:int,action:string>"
    actions = F.expr(f"CAST(array(struct(0, 'Now', 'Fix', 0, 'Do it'), struct(0, 'Now', 'fix', 1, 'do IT'), struct(2, '', '', 0, 'Later')) AS array<{row}>)")
    roadmap = s.where("k % 2 = 0").select("site_id", F.explode(actions).alias("a")).select("site_id", "a.*")
    return tasks.plan_totals(tasks.general_tasks(s, roadmap), tasks.category_tasks(s), tasks.page_plans(plan_pages(spark, sf)))
