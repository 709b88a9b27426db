import random
import time

from pyspark.sql import functions as F

from webstrata.functions import headers as Hd
from webstrata.functions.sitemap_files import read_file
from webstrata.operators import robots as R
from webstrata.operators import sitemaps as M

BODY = ("# c\nDisallow: /zzz\nUser-agent: *\nDisallow: /a/*\nAllow: /a/b\nCrawl-delay: 2\n# User-agent: q\n"
        "User-agent: bot\r\nAllow: /a/c\nCrawl-delay: x\nCrawl-delay: 0\nSitemap: https://e.com/s.xml\n sitemap:\n")


def robots(spark, body=BODY):
    return spark.createDataFrame([("e.com", body), ("f.com", "hello")], "domain string, body string")


def verdicts(spark, files, agent, urls, **options):
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = R.robots_verdict(frame, R.parse_robots(files), agent, **options).collect()
    return {r.url: r.robots_allows for r in rows}


def test_rules_follow_their_agent(spark):
    rows = R.parse_robots(robots(spark)).orderBy("seq").collect()
    assert [(r.user_agent, r.rule_type, r.rule_path) for r in rows] == [
        ("*", "disallow", "/a/*"), ("*", "allow", "/a/b"), ("bot", "allow", "/a/c")]


def test_first_match_decides(spark):
    urls = ["https://e.com/a/b", "https://e.com/a/c1", "https://e.com/q", "https://f.com/a/b", "https://g.com/"]
    assert list(verdicts(spark, robots(spark), "bot", urls).values()).count(False) == 1
    assert verdicts(spark, robots(spark), "bot", urls)["https://e.com/a/b"] is False
    assert verdicts(spark, robots(spark), "bot", urls, rfc9309=True)["https://e.com/a/b"] is True


def test_allow_all_disallow_all_and_no_file(spark):
    url = ["https://e.com/page"]
    assert verdicts(spark, robots(spark, "User-agent: *\nAllow: /\nDisallow: /"), "x", url) == {url[0]: True}
    assert verdicts(spark, robots(spark, "User-agent: *\nDisallow: /"), "x", url) == {url[0]: False}
    assert verdicts(spark, robots(spark, "User-agent: *\nDisallow:"), "x", url) == {url[0]: False}
    assert verdicts(spark, robots(spark, ""), "x", url) == {url[0]: True}


def plain_matches(rules, path):
    """Places of all rules that match, rule by rule."""
    return [i for i, (_, p) in enumerate(rules) if p == "/" or path.startswith(p.removesuffix("*"))]


def test_rules_are_found_as_by_trying_every_rule(spark):
    rng = random.Random(2)
    parts = ["a", "ab", "b", "é", ""]
    rules = [(rng.choice(["allow", "disallow"]), rng.choice(["/", ""]) * (rng.random() < .9) + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(["", "", "*"]))
             for _ in range(120)]
    for own in (rules, rules[:7], [r for r in rules if len(r[1]) > 3], rules[:1], []):
        body = "User-agent: *\n" + "".join(f"{kind}: {path}\n" for kind, path in own)
        paths = ["/" + "/".join(rng.choice(parts + ["c"]) for _ in range(rng.randint(0, 5))) for _ in range(200)]
        urls = sorted({f"https://e.com{p}" for p in paths} | {"https://e.com"})
        want = {u: plain_matches(own, u.removeprefix("https://e.com")) for u in urls}
        told = {u: [(len(own[i][1]), own[i][0] == "allow") for i in m if own[i][1]] for u, m in want.items()}
        files = robots(spark, body)
        assert verdicts(spark, files, "bot", urls) == {u: not m or own[m[0]][0] == "allow" for u, m in want.items()}
        assert verdicts(spark, files, "bot", urls, rfc9309=True) == {u: max(t, default=(0, True))[1] for u, t in told.items()}
        found = R.robots_matches(spark.createDataFrame([(u,) for u in urls], "url string"), R.parse_robots(files), "bot").collect()
        assert sorted(map(tuple, found)) == sorted((u, *own[i]) for u, m in want.items() for i in m)


def test_many_rules_on_one_domain_cost_no_scan(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /dir{i}/\n" for i in range(20_000))
    urls = spark.range(20_000).select(F.concat(F.lit("https://e.com/dir"), F.col("id") * 2, F.lit("/x")).alias("url"))
    rules = R.parse_robots(robots(spark, body))
    began = time.time()
    assert R.robots_verdict(urls, rules, "bot").where("not robots_allows").count() == 10_000
    assert time.time() - began < 60


def test_delay_falls_through_zero(spark):
    hosts = spark.createDataFrame([("e.com",), ("f.com",)], "host string")
    rows = R.crawl_delay(hosts, R.robots_delays(robots(spark)), "bot").collect()
    assert {r.host: r.crawl_delay for r in rows} == {"e.com": 2.0, "f.com": None}


def test_sitemaps_named_or_guessed(spark):
    known = spark.createDataFrame([("https://f.com/sitemaps.xml",), ("https://f.com/sitemap_index.xml",)], "sitemap_url string")
    rows = R.sitemaps_from_robots(robots(spark), known).collect()
    assert {r.domain: r.sitemap_url for r in rows} == {"e.com": "https://e.com/s.xml", "f.com": "https://f.com/sitemap_index.xml"}


FILES = [
    ("https://e.com/i.xml", '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://e.com/a.xml </loc></sitemap>'
     "<sitemap><loc>https://e.com/j.xml</loc></sitemap></sitemapindex>"),
    ("https://e.com/j.xml", "<sitemapindex><sitemap><loc>https://e.com/i.xml</loc></sitemap><sitemap><loc>https://e.com/b.xml</loc></sitemap>"
     "<sitemap><loc>https://e.com/none.xml</loc></sitemap></sitemapindex>"),
    ("https://e.com/a.xml", '<urlset xmlns:xhtml="http://www.w3.org/1999/xhtml"><url><loc>https://e.com/1?a=1&amp;b=2</loc><priority>0.8</priority>'
     '<lastmod>2020-01-01</lastmod><xhtml:link rel="alternate" hreflang="de" href="https://e.de/1"/><xhtml:link rel="alternate" hreflang="fr" href="https://e.fr/1"/>'
     "</url><url><loc>https://e.com/2</loc><priority>bad</priority></url></urlset>"),
    ("https://e.com/b.xml", "<urlset><url><loc>https://e.com/2</loc><priority>0.1</priority></url><url><loc></loc></url></urlset>"),
    ("https://e.com/x.xml", "<urlset><url>"),
]


def test_sitemaps_expand_once_in_queue_order_and_the_last_entry_counts(spark):
    files = spark.createDataFrame(FILES, "sitemap_url string, xml string")
    seeds = spark.createDataFrame([("https://e.com/i.xml", 0)], "sitemap_url string, position int")
    reached = M.expand_sitemaps(seeds, files).orderBy("depth", "visit").collect()
    assert [(r.sitemap_url[-5:], r.depth) for r in reached] == [("i.xml", 0), ("a.xml", 1), ("j.xml", 1), ("b.xml", 2)]
    rows = {r.url: r for r in M.sitemap_urls(seeds, files).collect()}
    assert rows["https://e.com/2"].sitemap_url == "https://e.com/b.xml" and rows["https://e.com/2"].priority == 0.1
    assert rows["https://e.com/1?a=1&b=2"].hreflangs == ["de", "fr"]
    kinds = {r[0][-5:]: r[1] for r in files.select("sitemap_url", M.sitemap_kind(F.col("xml"))).collect()}
    assert kinds["i.xml"] == "sitemap_index" and kinds["a.xml"] == "sitemap"


def test_files_are_read_up_to_their_break():
    read = read_file("<urlset><url><loc>a</loc><image:image><image:loc>i</image:loc></image:image></url><url><loc>b &amp; c</loc></url><url><loc>d&nbsp;</loc></url><url>")
    assert [e["loc"] for e in read["entries"]] == ["a", "b & c"] and "undefined entity" in read["error"]
    assert read_file("\ufeff \n<?xml version='1.0' encoding='utf-16'?><urlset/>") == {"children": [], "entries": [], "error": None}
    assert read_file("")["error"] and read_file("not xml")["error"] and read_file("<urlset><url></urlset>")["error"]
    links = "<urlset><url><xhtml:link hreflang='de' href='x'/><xhtml:link hreflang='' href='y'/><loc>a</loc></url><url><loc>b</loc></url></urlset>"
    assert [(e["hreflangs"], e["hrefs"]) for e in read_file(links)["entries"]] == [(["de"], ["x", "y"]), (None, None)]
    assert read_file("<s:sitemapindex><s:sitemap><loc>c</loc></s:sitemap></s:sitemapindex>")["children"] == ["c"]
    bomb = "<!DOCTYPE x [<!ENTITY a 'aaaaaaaaaa'>" + "".join(f"<!ENTITY {chr(98 + i)} '{f'&{chr(97 + i)};' * 10}'>" for i in range(9)) + "]><urlset><url><loc>&j;</loc></url></urlset>"
    assert read_file(bomb)["entries"] == [] and read_file(bomb)["error"]


def test_large_files_take_linear_time():
    began = time.process_time()
    read = read_file("<urlset>" + "".join(f"<url><loc>https://e.com/{i}</loc><priority>0.5</priority></url>\n" for i in range(50_000)) + "</urlset>")
    assert len(read["entries"]) == 50_000 and read["error"] is None and time.process_time() - began < 5


def test_sitemap_urls_read_every_file_once(spark):
    files = spark.createDataFrame(FILES, "sitemap_url string, xml string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(xml):
        read.add(1)
        return xml
    seeds = spark.createDataFrame([("https://e.com/i.xml", 0)], "sitemap_url string, position int")
    M.sitemap_urls(seeds, files.withColumn("xml", counted.asNondeterministic()("xml"))).collect()
    assert read.value == len(FILES)
    errors = {r.sitemap_url: (r.entries_read, r.children_read) for r in M.sitemap_errors(files).collect()}
    assert errors == {"https://e.com/x.xml": (0, 0)}


def test_cache_lifetime(spark):
    cases = [({"cache-control": "max-age=3600"}, 3600), ({"Cache-Control": "max-age=60"}, 60), ({"cache-control": "no-cache"}, 0),
             ({}, 3600), ({"Expires": "Thu, 01 Jan 1970 00:20:00 GMT"}, 200), ({"Expires": "Thu, 01 Jan 1970 00:00:10 GMT"}, 0),
             ({"Last-Modified": "Thu, 01 Jan 1970 00:00:00 GMT"}, 100), ({"cache-control": "max-age=soon"}, 3600)]
    rows = spark.createDataFrame([(h,) for h, _ in cases], "h map<string,string>").select(Hd.cache_ttl("h", 1000).alias("t")).collect()
    assert [r.t for r in rows] == [t for _, t in cases]


def test_hsts(spark):
    cases = ["max-age=31536000; includeSubDomains; preload", 'max-age="10"', "", None, "max-age=x; preload"]
    rows = spark.createDataFrame([(c,) for c in cases], "v string").select(Hd.parse_hsts("v").alias("h")).select("h.*").collect()
    assert [tuple(r) for r in rows] == [
        (31536000, True, True, True, True), (10, False, False, False, True), (None, False, False, False, False),
        (None, False, False, False, False), (None, False, True, False, True)]
