import pytest
from pyspark.sql import functions as F

from webstrata.operators import quality as Q
from webstrata.plans.registry import build_views
from webstrata.plans.snapshot import crawl_tables, url_id

HOME = """<html lang="en"><head><title>Home</title><link rel="canonical" href="/"><link rel="alternate" hreflang="de" href="https://site.de/">
<script type="application/ld+json">{"@type":"WebPage","name":"Home"}</script></head><body><h1>Home</h1>
<a href="/a">A</a><a href="/old">Old</a><a href="https://x.com/site">X</a><a href="https://other.net/">Other</a><a href="/private/p">P</a></body></html>"""
PAGE = '<html><head><title>{t}</title><link rel="canonical" href="{c}"></head><body><h1>{t}</h1><a href="/">Home</a><a href="/deep">Deep</a></body></html>'
SITEMAP = "<urlset><url><loc>https://site.org/listed</loc><priority>0.9</priority></url><url><loc>https://site.org/a</loc></url></urlset>"


@pytest.fixture(scope="module")
def tables(spark):
    hop = "struct<url:string,status:int,headers:map<string,string>>"
    base = "https://site.org"

    def fetch(path, html, status=200, final=None, at=100, chain=None):
        final = final or path
        return (base + path, base + final, status, {"Content-Type": "text/html"}, html, chain or [(base + path, status, {})], at)

    redirect = [(base + "/old", 301, {"Location": "/new"}), (base + "/new", 200, {})]
    rows = [fetch("/", HOME), fetch("/a", PAGE.format(t="A", c="/a")), fetch("/old", PAGE.format(t="New", c="/new"), final="/new", chain=redirect),
            fetch("/gone", "<title>gone</title>", 404), fetch("/copy", PAGE.format(t="A", c="/a")),
            fetch("/a", PAGE.format(t="older A", c="/a"), at=50)]
    fetches = spark.createDataFrame(rows, f"url string, final_url string, status int, headers map<string,string>, html string, chain array<{hop}>, fetched_at long")
    robots = spark.createDataFrame([("site.org", "User-agent: *\nDisallow: /private\nSitemap: https://site.org/map.xml")], "domain string, body string")
    sitemaps = spark.createDataFrame([("https://site.org/map.xml", SITEMAP)], "sitemap_url string, xml string")
    return crawl_tables(fetches, "site.org", "strata", robots, sitemaps)


def by_url(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("url", *columns).collect()}


def test_overview_of_a_small_site(tables):
    rows = by_url(build_views(tables, ["view_crawl_overview"])["view_crawl_overview"],
                  "title", "crawl_status", "status_code", "indexable", "indexability_reason", "crawl_depth", "internal_links_count", "main_schema_types")
    assert rows["https://site.org/"] == ("Home", "done", 200, True, None, 0, 3, "WebPage")
    assert rows["https://site.org/a"] == ("A", "done", 200, True, None, 0, 2, None)
    assert rows["https://site.org/copy"][3:5] == (False, "not self canonical")
    assert rows["https://site.org/listed"][1] == "queued" and rows["https://site.org/private/p"][1] == "unknown"
    assert rows["https://site.org/old"][:3] == (None, "done", 301) and rows["https://site.org/gone"][2] == 404


def test_links_frontier_and_duplicates(tables):
    views = build_views(tables)
    broken = {(r.target_url, r.invalid_reason) for r in views["view_links_invalid_content"].collect()}
    assert broken == {("https://site.org/old", "redirects")}
    assert views["view_links_external"].select("target_url").distinct().first()[0] == "https://other.net/"
    depths = by_url(tables["urls"].join(tables["frontier"], "url_id"), "depth", "status")
    assert depths["https://site.org/new"] == (1, "queued") or depths["https://site.org/new"][0] == 1
    assert depths["https://site.org/deep"] == (1, "queued") and "https://site.org/private/p" not in depths
    assert [r.duplicate_count for r in views["view_exact_duplicates"].collect()] == [2]
    assert views["view_sitemap_statistics"].first().urls_processed == 2


def test_tables_hold_together(tables):
    assert Q.check_domains(tables).count() == 0
    assert Q.check_keys(tables).where("violations > 0").collect() == []
    assert tables["urls"].where(F.col("url_id") != url_id("url")).count() == 0


def test_every_view_of_a_crawl_can_be_built(tables):
    built = build_views(tables)
    assert len(built) >= 30
    for name, df in built.items():
        assert df.count() >= 0, name


def test_unchanged_answers_keep_the_page(spark):
    hop = "struct<url:string,status:int,headers:map<string,string>>"
    kind, base = {"Content-Type": "text/html"}, "https://site.org"

    def fetch(path, html, status, at):
        return (base + path, base + path, status, kind, html, [(base + path, status, {})], at)

    def page(title):
        return PAGE.format(t=title, c="/a")

    rows = [fetch("/a", page("Kept"), 200, 10), fetch("/a", None, 304, 20), fetch("/b", None, 304, 30),
            fetch("/c", page("One"), 200, 40), fetch("/c", page("Two"), 200, 40), fetch("/d", page("Old"), 200, 50),
            fetch("/d", "<title>gone</title>", 404, 60)]
    schema = f"url string, final_url string, status int, headers map<string,string>, html string, chain array<{hop}>, fetched_at long"
    seen = []
    for parts, order in ((1, rows), (4, rows[::-1])):
        t = crawl_tables(spark.createDataFrame(order, schema).repartition(parts), "site.org", "strata")
        overview = build_views(t, ["view_crawl_overview"])["view_crawl_overview"]
        seen.append({r.url.removeprefix(base): (r.title, r.status_code) for r in overview.where("crawl_status = 'done'").collect()})
        assert {r.url.removeprefix(base): r.last_seen for r in t["urls"].collect()}["/a"] == 20
    assert seen[0] == seen[1] and seen[0]["/a"] == ("Kept", 200) and seen[0]["/b"] == (None, 304)
    assert seen[0]["/c"] in (("One", 200), ("Two", 200)) and seen[0]["/d"] == (None, 404)
