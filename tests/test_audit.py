"""Operators of the audit: parsing, robots, sites, scores, findings, competitors, plans and reports."""

import re

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import text as tx
from lumenaudit.functions import urls
from lumenaudit.operators import competitors, frontier, robots, tasks
from lumenaudit.operators.findings import RULES, exploded, with_findings
from lumenaudit.operators.scoring import CATEGORIES, score_sites
from lumenaudit.operators.sites import freshness
from lumenaudit.plans import audit as whole
from lumenaudit.plans import render
from lumenaudit.sources import jsonld
from lumenaudit.sources.html_tokens import decoded, parse_pages


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def parse(spark, html):
    return one(parse_pages(spark.createDataFrame([(html,)], "html string"), [])).asDict(recursive=True)


def ld(*blocks: str) -> str:
    return "<html><head>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</head><body><h1>x</h1></body></html>"


def test_json_ld_graphs_and_lists(spark):
    a = parse(spark, ld('{"@context":"x","@graph":[{"@type":"Organization"},{"@type":"FAQPage"}]}'))
    b = parse(spark, ld('[{"@type":"Product"},[{"@type":["Service","LocalBusiness"]}]]', '{"@type":"Organization","legalName":"L"}'))
    assert [n["types"] for n in a["nodes"]] == [["Organization"], ["FAQPage"]]
    assert [n["types"] for n in b["nodes"]] == [["Product"], ["Service", "LocalBusiness"], ["Organization"]] and b["nodes"][2]["name"] == "L"
    bad = parse(spark, ld('{"@type":"WebSite"}', "{ this is not valid json", "  "))
    assert len(bad["nodes"]) == 1 and bad["invalid"][0]["sample"] == "{ this is not valid json"
    assert parse(spark, ld('"text"'))["nodes"][0]["types"] == ["Unknown"]
    assert parse(spark, ld('{"@type":"A","description":"' + "x" * 9000 + '"}'))["nodes"][0]["raw"] == "{}"


def test_page_parse(spark):
    p = parse(
        spark,
        "<html><head><title> A &amp; <b>B</title><meta NAME='Description' content=' d  e '><meta name=robots content=NoIndex><link rel=Canonical href='/c'></head>"
        "<body class='x FAQ-list'><nav aria-label=n><a href='/a'>l</a><a href='tel:1'>t</a><a href='mailto:x'>m</a><a>no</a></nav><h1> One  two </h1><h1></h1>"
        "<h2>Why?</h2><h3>q</h3><img alt=' '><img alt=y><img><form><input><label>l</label><textarea></textarea></form><p>word<p>word2<script>var s=1;</script></body></html>"
    )
    assert (p["meta_description"], p["robots_meta"], p["canonical"], p["h1"], p["h2"]) == ("d e", "NoIndex", "/c", ["One two"], ["Why?"])
    assert p["links"] == ["/a", "tel:1", "mailto:x"] and p["has_tel_link"] and p["has_mail_link"] and p["has_form"] and p["has_landmarks"]
    assert (p["image_count"], p["images_with_alt"], p["inputs"], p["labels"], p["aria_labels"], p["question_headings"], p["faq_markup"]) == (3, 1, 2, 1, 1, 1, True)
    assert "var s=1;" in p["text"] and "wordword2" in p["text"] and "A &" not in p["text"]
    assert parse(spark, None)["text"] == "" and parse(spark, "plain text")["text"] == "plain text"


def test_tokens_of_odd_pages(spark):
    """Comments, raw elements, quotes in tags, pages cut anywhere, character references."""
    p = parse(spark, "<!-- <h1>no</h1> --><title>A<b></title><body data-x='a>b'><h1>x <b>y</b> &lt;z&gt;</h1><script>if (a < b) { '<h1>n</h1>' }</script><p>1 &copy; 2&nbsp;3 &#8364;&#x1F600; &unknown; &amp</p><a href=\"/q?a=1&amp;b=2\">l</a><a hre")
    assert (p["title"], p["h1"], p["links"]) == ("A<b>", ["x y <z>"], ["/q?a=1&b=2"])
    assert p["text"] == "x y <z>if (a < b) { '<h1>n</h1>' }1 © 2 3 €😀 &unknown; &l"
    assert parse(spark, "<h1>open <b>to the end")["h1"] == ["open to the end"] and parse(spark, "a < b &am")["text"] == "a < b &am"
    long = "<div " + " ".join(f"d{k}='{k}>'" for k in range(60)) + ">in</div><p " + " ".join(f'd{k}="{k}"' for k in range(3000)) + ">" + "y" * 300_000
    assert parse(spark, long)["text"] == ("in" + "y" * 300_000)[:250_000]
    assert one(spark.createDataFrame([("&notin; &NotEqualTilde; &#0065; &#99999999;",)], "t string").select(decoded(F.col("t")).alias("x"))).x == "∉ ≂̸ A &#99999999;"


def test_json_ld_to_any_depth(spark):
    deep = '{"@type":"Deep"}'
    for k in range(30):
        deep = f'{{"@graph":[{deep},{k}]}}' if k % 2 else f"[{deep}]"
    rows = [(1, deep), (2, '{"@graph":[]}'), (2, "[]"), (2, "null"), (3, "broken {"), (3, "  "), (4, None), (5, '{"@type":[],"@id":5,"name":"","headline":"H"}'), (5, '{"@graph":"","@type":"Own"}')]
    df = spark.createDataFrame(rows, "page long, block string")
    got = jsonld.nodes(df, "page").select("page", "types", "id", "name").collect()
    assert sorted((r.page, r.types[0], r.id, r.name) for r in got if r.types[0] != "Unknown") == [(1, "Deep", None, None), (5, "Own", None, None)]
    assert sum(r.page == 1 for r in got) == 16 and [(r.id, r.name) for r in got if r.page == 5 and r.types == ["Unknown"]] == [("5", "H")]
    assert not any(r.page == 2 for r in got) and [tuple(r) for r in jsonld.bad_blocks(df, "page").collect()] == [(3, "broken {")]


LINKS = [("../x", "https://e.com/a/b/c", "https://e.com/a/x"), ("./../../../y/./z/..", "https://e.com/a/b/c", "https://e.com/y"), ("?q=1&utm_source=x", "https://e.com/a/b?z#f", "https://e.com/a/b?q=1"), ("#top", "https://e.com/a/b?z=1", "https://e.com/a/b?z=1"),
         ("//F.com:443/p", "https://e.com", "https://f.com/p"), ("d e/é", "http://e.com/a/", "http://e.com/a/d%20e/%C3%A9"), (" /t\n ", "https://e.com/a", "https://e.com/t"), ("ftp://x/y", "https://e.com/a", None), ("JavaScript:x", "https://e.com/a", None), ("HTTP://E.com:80/..", "https://e.com/a", "http://e.com")]


def test_relative_links(spark):
    rows = spark.createDataFrame([(h, b) for h, b, _ in LINKS], "h string, b string").select("h", urls.resolved(F.col("h"), F.col("b")).alias("x")).collect()
    assert {r.h: r.x for r in rows} == {h: w for h, _, w in LINKS}


@pytest.mark.parametrize(("text", "hit"), [("Copyright 2030", True), ("As of 2029, x", True), ("Founded in 2010", False), ("12030 units sold in 12019", False), ("Last updated: March", True), ("our latest work", True)])
def test_freshness(spark, text, hit):
    assert one(spark.createDataFrame([(text,)], "t string").select(tx.matches(F.col("t"), freshness(2030)).alias("x"))).x is hit


ROBOTS = [
    ("User-agent: *\nDisallow: /admin", "Googlebot", "/admin/settings", False), ("User-agent: *\nDisallow: /admin", "Googlebot", "/about", True), ("", "Googlebot", "/x", True),
    ("User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /", "Googlebot", "/", True), ("User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /", "PerplexityBot", "/", False),
    ("User-agent: AuditBot\nDisallow: /internal", "AuditBot", "/internal/report", False), ("User-agent: AuditBot\nDisallow: /internal", "AuditBot", "/public", True),
    ("User-agent: *\nDisallow: /shop\nAllow: /shop/guides", "B", "/shop/cart", False), ("User-agent: *\nDisallow: /shop\nAllow: /shop/guides", "B", "/shop/guides/turf", True),
    ("User-agent: *\nDisallow: /*.pdf$\nDisallow: /search*results", "B", "/files/brochure.pdf", False), ("User-agent: *\nDisallow: /*.pdf$\nDisallow: /search*results", "B", "/files/brochure.pdf?download=1", True),
    ("User-agent: *\nDisallow: /*.pdf$\nDisallow: /search*results", "B", "/search/all/results", False), ("Disallow: /x\nUser-agent: Z\nAllow: /", "B", "/x/y", False),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "B", "/a", True), ("User-agent: *\nDisallow:\nDisallow: # none", "B", "/a", True), ("User-agent: google\nSitemap: s\nUser-agent: bing\nDisallow: /p", "Bingbot", "/p", False),
]


def test_robots(spark):
    files = spark.createDataFrame([(str(k), r[0]) for k, r in enumerate(ROBOTS)], "site_id string, body string")
    asked = spark.createDataFrame([(str(k), r[1], r[2], "https://e.com") for k, r in enumerate(ROBOTS)], "site_id string, bot string, path string, origin string")
    got = {int(r.site_id): r.allowed for r in robots.access(files, asked).collect()}
    assert [got[k] for k in range(len(ROBOTS))] == [r[3] for r in ROBOTS]
    assert robots.sitemaps(spark.createDataFrame([("s", "Sitemap: https://a/b.xml # x")], "site_id string, body string")).collect()[0].url == "https://a/b.xml"


def test_urls(spark):
    for href, want in (("/pricing", "https://example.com/pricing"), ("mailto:a", None), ("tel:1", None), ("javascript:void(0)", None), ("../x/?utm_source=a&q=1#f", "https://example.com/x/?q=1"), ("//Other.com:443/", "https://other.com"), (None, None)):
        assert one(spark.createDataFrame([(href,)], "h string").select(urls.resolved(F.col("h"), F.lit("https://example.com/about/")).alias("x"))).x == want
    df = spark.createDataFrame([("https://www.Example.com/page/?utm_source=x&utm_medium=y&gclid=1",), ("https://example.com/?q=turf",)], "u string")
    assert [r.c for r in df.select(urls.canonical(F.col("u")).alias("c")).collect()] == ["https://www.example.com/page", "https://example.com/?q=turf"]
    assert [r.d for r in df.select(urls.domain(F.col("u")).alias("d")).collect()] == ["example.com"] * 2
    assert one(df.limit(1).select(urls.priority(F.lit("https://e.com/about/")).alias("p"))).p == 100 + 99 - 3


def test_golden_scores(spark):
    r = one(with_findings(score_sites(whole.example_site(spark))))
    assert (r.crawlability, r.structured_data, r.answer_readiness, r.entity_trust, r.technical_seo, r.page_experience, r.vertical_readiness, r.security, r.accessibility) == (100, 90, 100, 100, 98, 72, 100, 70, 78)
    assert (r.overall, r.aeo_geo, r.seo, r.ai_readiness, r.vertical) == (95, 98, 95, 99, "general")
    assert len(r.categories) == 9 and sum(len(c.checks) for c in r.categories) == 8 + 7 + 8 + 7 + 9 + 5 + 5 + 6 + 4
    assert [f.id for f in r.findings] == ["performance-pagespeed-data-unavailable"]
    assert all(sum(k.most for k in checks) == 100 for _, checks in CATEGORIES.values())


def test_findings_by_severity_and_verticals(spark):
    bad = whole.example_site(spark, bots={"OAI-SearchBot": (False, "OAI-SearchBot: blocked at /")}, llms_found=False, schema_found=False, topical_depth=1, has_direct_answers=False, about_url=None, title_coverage=0.5, mobile=30, likely_ecommerce=True)
    r = one(with_findings(score_sites(bad)))
    weight = {"high": 3, "medium": 2, "low": 1}
    assert [weight[f.severity] for f in r.findings] == sorted((weight[f.severity] for f in r.findings), reverse=True)
    assert len(r.findings) == 9 and r.findings[0].url == "https://example.com/robots.txt" and r.vertical == "ecommerce"
    assert r.crawlability == 100 - 16 - 8 and len(RULES) == 12
    assert one(score_sites(whole.example_site(spark, likely_saas=True))).vertical == "saas" and one(score_sites(whole.example_site(spark, city="Oslo"))).vertical == "local"
    assert exploded(with_findings(score_sites(bad))).count() == 9


def test_numeric_checks(spark):
    got = {m: {k.label: (k.status, k.score) for k in one(score_sites(whole.example_site(spark, mobile=m))).categories[5].checks} for m in (None, 20, 50, 80, 200)}
    assert [got[m]["Mobile PageSpeed performance"] for m in (None, 20, 50, 80, 200)] == [("unknown", 19), ("failed", 7), ("partial", 18), ("passed", 28), ("passed", 35)]


def test_competitors(spark):
    own = score_sites(whole.example_site(spark, schema_count=4, trust_pages=3))
    other = score_sites(whole.example_site(spark, site_id="o.com", domain="o.com", schema_count=12, trust_pages=0))
    pairs = spark.createDataFrame([("example.com", "o.com", "", "https://o.com", None, 0), ("example.com", "gone.com", "Gone", "https://gone.com", "Request timed out", 1), ("example.com", "x", "", "https://x", None, 5)], "site_id string, competitor_id string, name string, url string, error string, ord int")
    a, b = competitors.compare(pairs, own.unionByName(other)).orderBy("ord").collect()
    assert a.gaps == ["Schema coverage: competitor has 12, audited site has 4"] and a.advantages == ["Trust pages: audited site has 3, competitor has 0"] and a.score_diff == -3  # no trust pages: 20 of the vertical, weighed 0.15
    assert (b.name, b.error, b.score_diff, b.gaps) == ("Gone", "Request timed out", None, [])


def test_action_plan(spark):
    sites = with_findings(score_sites(whole.example_site(spark, has_hsts=False)))
    cat = tasks.category_tasks(sites).orderBy("ord").collect()
    assert [t.impact for t in cat] == sorted((t.impact for t in cat), key=lambda i: -tasks.WEIGHT[i]) and len(cat) <= 28
    assert {t.title for t in cat} >= {"HSTS header present", "Mobile PageSpeed performance"}
    roadmap = spark.createDataFrame([("example.com", 0, "Now", "T", 0, "a"), ("example.com", 1, "Next", "T", 0, "A"), ("example.com", 2, "", "", 1, "b")], "site_id string, phase_no int, phase string, title string, action_no int, action string")
    gen = tasks.general_tasks(sites, roadmap).orderBy("ord").collect()
    assert [(t.id, t.impact, t.effort) for t in gen] == [("finding-performance-pagespeed-data-unavailable", "Low", "Next sprint"), ("roadmap-0-0", "High", "Now"), ("roadmap-2-1", "Low", "Phase 3")]
    none = tasks.general_tasks(sites.withColumn("findings", F.slice("findings", 1, 0)))
    assert one(none).id == "general-maintain"
    pages = spark.createDataFrame(
        [("s", 0, "https://s/x", 200, "", "", True, "", "general", 0, 100, False, 0, 2, 1, [], []), ("s", 1, "https://s/privacy", 200, "t", "", True, "", "contact", 1, 900, False, 0, 0, 0, ["1"], [])],
        "site_id string, ord int, url string, status int, title string, meta_description string, indexable boolean, robots_meta string, content_type string, h1_count int, word_count long, has_visible_faq boolean, schema_count int, image_count int, images_with_alt int, phones array<string>, emails array<string>",
    )
    p = one(tasks.page_plans(pages))
    assert [t.id for t in p.tasks] == [f"page-0-{k}" for k in ("title-missing", "description-missing", "h1", "thin-content", "faq", "schema", "alt-text")]
    assert (p.readiness, p.priority, p.title) == (100 - 10 * 4 - 18 * 2 - 5, "High", "x") and p.tasks[5].title == "Add WebPage schema"


def test_sitemaps_and_frontier(spark):
    files = spark.createDataFrame([("s", "r", "<sitemapindex ><loc>a</loc><loc>b</loc></sitemapindex>"), ("s", "a", "<urlset><loc> p1 </loc><loc>p1</loc></urlset>"), ("s", "b", "<sitemapindex><loc>r</loc><loc>c</loc></sitemapindex>"), ("s", "c", "<loc>p2</loc>")], "site_id string, url string, body string")
    got = frontier.sitemap_tree(files, spark.createDataFrame([("s", "r")], "site_id string, url string"))
    assert sorted(r.url for r in got.collect()) == ["p1", "p2"]
    got = frontier.sitemap_tree(files, spark.createDataFrame([("s", "r")], "site_id string, url string"), most_children=1, listed=spark.createDataFrame([("s", "c")], "site_id string, url string"))
    assert sorted(r.url for r in got.collect()) == ["p1"]  # a, b and c wait, one may be taken
    starts = spark.createDataFrame([("s", "u0", 5, 0)], "site_id string, url string, priority int, rank int")
    edges = spark.createDataFrame([("s", "u0", True, False, [("low", 1), ("high", 9), ("stop", 8)]), ("s", "high", True, False, [("u0", 5)]), ("s", "low", True, False, []), ("s", "stop", True, True, [])], "site_id string, url string, found boolean, blocked boolean, targets array<struct<url:string,priority:int>>")
    order = frontier.replay(edges, starts).orderBy("ord").collect()
    assert [(r.url, r.status) for r in order] == [("u0", "page"), ("high", "page"), ("stop", "blocked"), ("low", "page")]


def test_whole_audit(spark):
    pages = spark.createDataFrame([
        (0, "https://www.shop.example/", "<title>Shop home of fine things and more</title><body><h1>Shop</h1>add to cart, call (212) 555-0100, our story. Copyright 2024. <a href='https://linkedin.com/x'>in</a></body>"),
        (1, "https://shop.example/about", "<title>About</title><body><h1>About</h1><p>certified team</p></body>"),
        (2, "https://other.example/x", "<body>nothing</body>"),
    ], "page_id long, url string, html string")
    robots_txt = spark.createDataFrame([("shop.example", "User-agent: *\nDisallow: /")], "site_id string, body string")
    got = {r.site_id: r for r in whole.audit(whole.signals_of(whole.snapshot(pages)), as_of_year=2024, robots=robots_txt).collect()}
    shop, other = got["shop.example"], got["other.example"]
    assert (shop.page_count, shop.vertical, shop.phone_count, shop.has_freshness, shop.has_https, shop.about_url) == (2, "ecommerce", 1, True, True, "https://www.shop.example")
    assert not shop.bots["Googlebot"].allowed and other.bots["Googlebot"].allowed and shop.same_as == ["https://linkedin.com/x"]
    assert other.title_coverage == 0.0 and other.average_alt == 1.0 and "seo-metadata-coverage-is-incomplete" in [f.id for f in other.findings]


def test_reports(spark):
    row = render.plain(one(with_findings(score_sites(whole.example_site(spark)))))
    row |= {"competitors": [{"name": "Gone", "domain": "g", "error": "Request timed out"}, {"name": "O", "domain": "o.com", "aeo_geo": 70, "score_diff": 3, "gaps": ["g1"], "advantages": []}], "total_tasks": 1, "high_impact_tasks": 0,
            "general_tasks": [{"title": "T", "detail": "d", "impact": "Low", "effort": "e", "source": "s", "evidence": ""}]}
    row["categories"][0]["checks"][0] |= {"status": "failed", "evidence": "a|b\n c"}
    md = render.markdown(row)
    for part in ("# GEO/AEO Diagnostic Report — example.com", "| Overall | 95 |", "crawl failed", "(diff vs audited site: +3)", "- [ ] **T** (Low impact, e, s)", "a\\|b c", "All checks passed."):
        assert part in md
    assert "Googlebot can access" not in md and render.markdown({"domain": "x"}).startswith("# GEO/AEO Diagnostic Report — x")
    scores = {k: 50 for _, k in render.DIMENSIONS}
    svg = render.chart("<me>", scores, [{"name": "a" * 40, "scores": scores}, {"name": "e", "error": "x"}, *({"name": str(k), "scores": scores | {"overall": 900}} for k in range(6))])
    assert len(re.findall("<polyline", svg)) == 6 and "&lt;me&gt; (you)" in svg and "a" * 27 + "…" in svg
    assert render.chart("x", None, []) == "" and render.chart("x", scores, [{"error": "x"}]) == ""
    assert "<h1>example.com</h1>" in render.page(row)
    assert render.rendered(whole.example_site(spark)).count() == 1


def test_html_is_parsed_once(spark):
    """The audit's plan reads stored signals: no parse in any of its branches."""
    pages = spark.createDataFrame([(1, "https://a.example/", "<title>One</title>"), (2, "https://a.example/b", None)], "page_id long, url string, html string")
    out = whole.audit(whole.signals_of(whole.snapshot(pages)), as_of_year=2024)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    assert [(r.site_id, r.page_count) for r in out.collect()] == [("a.example", 2)]


def joined_flags(rows, patterns, most):
    """The patterns on each site's joined and cut text, plainly."""
    import re

    out = {}
    for site in {r[0] for r in rows}:
        texts = [r[2] for r in sorted((r for r in rows if r[0] == site and r[2] is not None), key=lambda r: (r[1] is None, r[1] or 0))]
        if texts:
            text = "\n".join(texts)[:most]
            out[site] = (len(text), *(bool(re.search(p, text, re.I)) for p in patterns.values()))
    return out


@pytest.mark.parametrize(("most", "partitions"), [(40, 3), (1_500_000, 9), (9, 4)])
def test_site_flags_are_those_of_the_joined_text(spark, most, partitions):
    import random

    from lumenaudit.operators.site_flags import site_flags, text_sample
    from lumenaudit.operators.sites_text import TEXT_FLAGS, freshness

    r = random.Random(most)
    bits = ["12", " ", "", "main", "elm street", "-", "mon", "monday ", " - 5", "4 x", "st", "st.", "2024", "12024", "how", "how to", "é😀", "x\ny", "7 \n", "\n \n"]
    rows = [(f"s{r.randrange(60)}", n, "".join(r.choice(bits) for _ in range(r.randrange(3)))) for n in range(500)]
    rows += [("hot", n, r.choice(["12", "", " ", "-", "mon", "quiet"])) for n in range(300)] + [("none", 1, None), ("cut", 0, "abc 12"), ("cut", 1, "3 elm street")]
    patterns = TEXT_FLAGS | {"has_freshness": freshness(2024)}
    df = spark.createDataFrame(rows, "site_id string, ord int, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.site_id: (x.chars, *(x[k] or False for k in patterns)) for x in site_flags(df, patterns, most).collect()}
        samples = {x.site_id: x["sample"] for x in text_sample(df, most).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == joined_flags(rows, patterns, most)
    assert all(len(samples[k]) == v[0] for k, v in got.items()) and "none" not in samples


def test_pages_without_ids_or_with_one_id_count_once(spark):
    """Six rows, one without an id, two of one id, two without a host."""
    rows = [(None, "https://a.example/n", "<title>N</title>one"), (7, "https://a.example/x", "<body>two</body>"), (7, "https://a.example/y", "<body>three</body>"), (1, "https://a.example/", "<body>four"), (2, None, "x"), (3, "nowhere", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    signals = whole.signals_of(whole.snapshot(pages))
    assert signals.count() == 4
    plan = whole.snapshot(pages)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [(r.site_id, r.page_count) for r in whole.audit(signals, as_of_year=2024).collect()] == [("a.example", 4)]
    from lumenaudit.operators.site_flags import site_flags, text_sample

    twice = spark.createDataFrame([("s", 1, "one"), ("s", 1, "two"), ("s", None, "three"), ("s", 2, "same"), ("s", 2, "same")], "site_id string, ord int, text string")
    assert site_flags(twice, {"a": "one", "b": "two\\Z"}).first()[:3] == ("s", len("one two same same three"), True)
    sample = text_sample(twice).first()["sample"].split("\n")
    assert sorted(sample[:2]) == ["one", "two"] and sample[2:] == ["same", "same", "three"]


def test_why_a_competitor_failed(spark):
    from pyspark.sql import functions as F

    from lumenaudit.operators.competitors import failure

    rows = spark.createDataFrame([("timeout", True), (None, True), (None, False)], "e string, b boolean").select(failure(F.col("e"), F.col("b")).alias("f")).collect()
    assert [r.f for r in rows] == ["Crawl failed: timeout", "The site's robots.txt disallows crawling", "No pages could be crawled"]


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from lumenaudit.sources.storage import shared_folder

    session = lambda master, base: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": base} if base else {}))
    assert shared_folder(session("yarn", "hdfs:///x/")).startswith("hdfs:///x/lumenaudit-") and shared_folder(session("local[2]", None)).startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))


def test_auxiliary_files(spark):
    sites = spark.createDataFrame([("a.example", "https://www.a.example/"), ("b.example", "https://b.example/"), ("c.example", "https://c.example/")], "site_id string, start_url string")
    llms = spark.createDataFrame([("a.example", "\U0001F600" * 3), ("b.example", None)], "site_id string, body string")
    robots_txt = spark.createDataFrame([("c.example", "Sitemap: https://c.example/gone.xml")], "site_id string, body string")
    maps = spark.createDataFrame([
        ("a.example", "https://www.a.example/sitemap.xml", "<urlset><loc>/x</loc><loc>https://www.a.example/x#top</loc><loc>tel:1</loc></urlset>"), ("b.example", "https://b.example/sitemap.xml", None), ("b.example", "https://b.example/other.xml", "<loc>/y</loc>"),
    ], "site_id string, url string, body string")
    got = {r.site_id: (r.robots_found, r.llms_found, r.llms_length, r.sitemap_found, r.sitemap_urls) for r in whole.auxiliary(sites, robots_txt, llms, maps).collect()}
    assert got == {"a.example": (False, True, 6, True, 1), "b.example": (False, True, 0, True, 0), "c.example": (True, False, 0, False, 0)}
    bare = whole.auxiliary(sites).first()
    assert (bare.robots_found, bare.llms_found, bare.llms_length, bare.sitemap_found, bare.sitemap_urls) == (False, False, 0, False, 0)


def test_scalars(spark):
    row = spark.createDataFrame([("a b+c!~*'()\u00e9/", "aa\u00e9\u00e9", -1)], "t string, u string, ms long")
    got = row.select(tx.url_encode(F.col("t")), tx.cut_bytes(F.col("u"), 3), tx.cut_bytes(F.col("u"), 6), tx.iso_time(F.timestamp_millis("ms")), tx.iso_day(F.timestamp_millis("ms")), urls.absolute(F.lit("x?q=1"), F.lit("https://h.example")), urls.absolute(F.lit("//o.example/y/"), F.lit("https://h.example"))).first()
    assert tuple(got) == ("a%20b%2Bc!~*'()%C3%A9%2F", "aa\ufffd", "aa\u00e9\u00e9", "1969-12-31T23:59:59.999Z", "1969-12-31", "https://h.example/x?q=1", "https://o.example/y")


def test_redirects(spark):
    from lumenaudit.operators.redirects import followed, same_end

    chain = [(f"https://e.com/{k}", 301, f"/{k + 1}") for k in range(8)] + [("https://e.com/8", 200, None)]
    rows = [*chain, ("https://l.com/a", 302, "b"), ("https://l.com/b", 307, "./a"), ("https://l.com/self", 308, ""), ("https://n.com/", 302, None), ("https://o.com/", 303, "https://gone.com/x"), ("https://s.com/", 404, "/ignored"), ("https://s.com/", 404, "/ignored"), (None, 200, None), ("https://t.com/", None, None)]
    got = {r.url: (r.final_url, r.hops, r.ok, r.error) for r in followed(spark.createDataFrame(rows, "url string, status int, location string").repartition(3)).collect()}
    end = ("https://e.com/8", True, None)
    for k in range(3, 9):
        assert got[f"https://e.com/{k}"] == (end[0], 8 - k, *end[1:])
    assert got["https://e.com/2"] == ("https://e.com/7", 5, False, "Too many redirects") and got["https://l.com/a"] == ("https://l.com/b", 5, False, "Too many redirects")
    assert got["https://l.com/self"][3] == got["https://n.com/"][3] == "Redirect without Location header" and got["https://o.com/"] == ("https://gone.com/x", 1, False, "Not in the snapshot")
    assert got["https://s.com/"] == ("https://s.com/", 0, False, None) and got["https://t.com/"][3] == "Not in the snapshot" and len(got) == 16
    assert [tuple(r) for r in same_end(followed(spark.createDataFrame(rows, "url string, status int, location string"))).collect()] == [("https://e.com/8", 6, "https://e.com/3")]
