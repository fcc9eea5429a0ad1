"""What the third review found: larger sites, and steps whose work grew faster than their input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenaudit.operators import frontier, tasks
from lumenaudit.operators.scoring import score_sites
from lumenaudit.plans import operator_queries, registry, report_queries, stream_queries
from lumenaudit.plans.audit import example_site
from lumenaudit.sources.html_tokens import parse_pages

SMALL = Path("/root/testdata/sf0.001")


def _above_generate(df):
    """The lines of the optimized plan above its generator."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_audit_auxiliary_counts_pages_beyond_one_sitemaps_bytes(spark, tmp_path):
    n = 60_000  # one sitemap of them all would be cut at its byte limit
    spark.range(1, n + 1).select(F.col("id").alias("page_id"), F.concat(F.lit("https://big.example/"), "id").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    (row,) = operator_queries.audit_auxiliary(spark, str(tmp_path)).collect()
    assert (row["sitemap_found"], row["sitemap_urls"]) == (True, n + 1)  # k is 1: with the page that robots.txt leads to


def test_sitemap_tree_looks_at_a_body_once(spark):
    docs = spark.createDataFrame([("a", "https://a/s.xml", "<urlset><loc>/x</loc><loc>/y</loc></urlset>", "https://a")], "site_id string, url string, body string, origin string")
    found = frontier._locations(docs)
    assert "RLIKE (?i)<sitemapindex" not in _above_generate(found) and "body" not in _above_generate(found)
    assert {r["loc"] for r in found.collect()} == {"https://a/x", "https://a/y"}


def test_robots_gate_weighs_rules_as_its_sql(spark, tmp_path):
    at = lambda k, path: (k, f"https://h.example{path}", "")
    spark.createDataFrame([at(3, "/en/123"), at(4, "/en/12345.html"), at(5, "/fr/2.html"), at(6, "/fr/")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["path"]: r["allowed"] for r in registry.robots_gate(spark, str(tmp_path)).collect()}
    assert got == {"/en/123": False, "/en/12345.html": False, "/fr/2.html": True, "/fr/": False}


def test_words_before_a_reference_arent_references(spark):
    page = spark.createDataFrame([(1, "<body>Reth&amp; x</body>")], "page_id long, html string")
    assert parse_pages(page, ["page_id"]).first()["text"] == "Reth& x"


def test_running_knows_the_next_values(spark):
    from lumenaudit.operators.ordered import running

    rows = spark.range(0, 1000, numPartitions=7).selectExpr("id", "id % 3 % 2 AS k", "IF(id % 5 = 0, NULL, id) AS v")
    got = {r["id"]: r for r in running(rows, "k", [F.col("id")], lasts={"before": F.col("v")}, nexts={"after": F.col("v")}).collect()}
    for k in (0, 1):
        ids = [x for x in range(1000) if x % 3 % 2 == k]
        for x in ids:
            assert got[x]["after"] == next((y for y in ids if y > x and y % 5), None) and got[x]["before"] == next((y for y in reversed(ids) if y < x and y % 5), None)


def test_competitor_gaps_compares_with_the_next_site(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.example/", ""), (2, "https://b.example/", ""), (3, "https://b.example/x", ""), (4, "https://c.example/", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["site_id"]: (r["domain"], r["gaps"] != "", r["advantages"] != "") for r in registry.competitor_gaps(spark, str(tmp_path)).collect()}
    assert got == {"a.example": ("b.example", True, False), "b.example": ("c.example", False, True), "c.example": ("none", False, False)}


def test_category_tasks_need_no_shuffle(spark):
    plan = tasks.category_tasks(score_sites(example_site(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")
def test_signals_of_varied_sites_come_from_all_cores(spark):
    assert len(report_queries.scored(spark, str(SMALL)).inputFiles()) > 1


def test_parts_of_a_stream_come_in_several_files(spark):
    seen = []
    stream = stream_queries.arriving(spark.range(0, 60_000).withColumn("x", F.col("id") % 3), F.col("x"), 3)
    stream.writeStream.foreachBatch(lambda df, n: seen.append((n, df.count(), [r["x"] for r in df.select("x").distinct().collect()], df.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(k, 20_000, [k], 2) for k in range(3)]


def test_mentions_find_what_matches_finds(spark):
    from lumenaudit.functions import text as tx
    from lumenaudit.operators import pages, sites
    from lumenaudit.operators.sites_text import TEXT_FLAGS, freshness

    patterns = [*TEXT_FLAGS.values(), freshness(2024), pages.FAQ, sites.COMPARISON, *(p for _, p in pages.PAGE_TYPES), "ab?|x{0}y|c[|(]d|e\\|f|(?:g|h)i"]
    assert tx.alternatives(patterns[-1]) == ["ab?", "x{0}y", "c[|(]d", "e\\|f", "(?:g|h)i"] and "how long" in tx.alternatives(TEXT_FLAGS["has_direct_answers"])
    words = [w for p in patterns for w in tx.alternatives(p)] + ["12 Oak St", "STEP 4", "Connector", "2024", "12024", "Q&A", "q&ab", "vs", "vsx", "mon \n-", "Monday -", "slacK", "İSO", "PRİCE", "é", "", "a", "y", "c|d", "E|F", "HI"]
    rows = spark.createDataFrame([(f"{a} {w}{b}",) for w in words for a in ("", "ü ") for b in ("", ".", "s")] + [(None,)], "t string").withColumn("low", tx.folded(F.col("t")))
    assert rows.where(F.concat_ws(",", *(~tx.matches(F.col("t"), p).eqNullSafe(tx.mentions(F.col("t"), F.col("low"), p)) for p in patterns)).contains("true")).count() == 0


def test_site_flags_look_words_up(spark):
    """A text is matched against few patterns; before, against each of them."""
    from lumenaudit.operators import site_flags
    from lumenaudit.operators.sites_text import TEXT_FLAGS, freshness

    text = spark.createDataFrame([("now in 2023",)], "text string")
    tests = site_flags._tests(F.col("text"), TEXT_FLAGS | {"has_freshness": freshness(2024)})
    plan = site_flags._low(text).select(*(v.alias(k) for k, v in tests.items()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 14 and plan.count("lower(") == 1


def test_values_of_a_site_dont_meet_in_one_row(spark):
    from lumenaudit.operators.sites import distinct_values

    rows = [("a", 2, [["X", "Y"], ["X"]], ["p", "q"]), ("a", 1, [["Z"], ["Y"]], [f"l{k:02}" for k in range(40)]), ("b", 1, [], [])]
    pages = spark.createDataFrame([(s, o, [(t,) for t in ts], v, v, v) for s, o, ts, v in rows], "site_id string, ord int, nodes array<struct<types:array<string>>>, same_as array<string>, phones array<string>, emails array<string>")
    types, same_as, phones, emails = ({r[0]: r[1] for r in df.collect()} for df in distinct_values(pages))
    assert types == {"a": ["Z", "Y", "X"]} and same_as == {"a": [f"l{k:02}" for k in range(30)]} and phones == emails == {"a": 42}


def test_scores_are_planned_apart_from_the_joins_of_a_site(spark):
    from lumenaudit.plans import audit as whole

    pages = spark.createDataFrame([(1, "https://a.example/", "<title>One</title>"), (2, "https://b.example/b", None)], "page_id long, url string, html string")
    out = whole.audit(whole.signals_of(whole.snapshot(pages)), as_of_year=2024)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted((r.site_id, r.page_count) for r in out.select("site_id", "page_count").collect()) == [("a.example", 1), ("b.example", 1)]
