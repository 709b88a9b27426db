import time

from pyspark.sql import functions as F

from webstrata.functions.html import nodes_of
from webstrata.operators import links as L
from webstrata.operators import pages as P

HTML = """<html lang=" en "><head><title> T &amp; x </title><meta name="description" content=" d ">
<meta name=robots content="NoIndex, follow"><link rel="canonical alternate" href="/c"><link rel=alternate hreflang=de href="/de">
</head><body><h1>A<b>B</b></h1><h1> </h1><h2>q</h2>
<a href="/x"> t <b> u</b></a><a href="p?a=1&utm_source=q#f"><img alt=" al "></a><a href="/z/foo-bar_baz.html"></a>
<a href="#sec"></a><a href="/q" class="btn nav-link x"></a><a href="/r" id=w></a><a href="/s" data-name="dn"></a>
<a href="/im"><span><img src="/i/j.png"></span></a><a>no</a><a href=""></a><a href="/t" title=" tt "></a><a href="/u" aria-label="al"></a>
<p>one</p><p>two</p><noscript>ns</noscript><script>var a = "<p>";</script></body></html>"""


def page(spark, html, headers=None):
    return spark.createDataFrame([("https://e.com/a/b", html, headers)], "url string, html string, headers map<string,string>")


def test_content(spark):
    row = P.extract_content(page(spark, HTML, {"X-Robots-Tag": "none, NOARCHIVE"})).first()
    assert (row.title, row.meta_description, row.h1_tags, row.h2_tags) == ("T & x", "d", ["AB"], ["q"])
    assert row.html_meta_directives == ["noindex", "follow"] and row.http_header_directives == ["none", "noarchive"]
    assert row.canonical_url == "/c" and row.html_lang == "en"
    assert [tuple(h) for h in row.hreflang_urls] == [("/de", "de")]
    assert len(row.content_hash_sha256) == 64 and int(row.content_hash_simhash) > 0 and row.content_length > 0


def test_words_are_counted_without_separator_between_elements(spark):
    row = P.extract_content(page(spark, "<p>a</p><p>b</p> <p>c</p><style>x y</style>")).first()
    assert row.word_count == 2


def test_anchor_text_ladder(spark):
    texts = [r.anchor_text for r in L.extract_links(page(spark, HTML)).orderBy("position").collect()]
    assert texts == ["tu", "[IMG: al]", "[PATH: Foo Bar Baz.Html]", "[ANCHOR: sec]", "[CLASS: nav-link]", "[ID: w]",
                     "[DATA: dn]", "[IMG: j.png]", "", "[TITLE: tt]", "[ARIA: al]"]


def test_links_are_normalized_and_kept_as_written(spark):
    row = L.extract_links(page(spark, HTML)).where("position = 1").first()
    assert row.target_url == "https://e.com/a/p?a=1" and row.original_href == "https://e.com/a/p?a=1&utm_source=q#f"
    assert (row.fragment, row.url_parameters) == ("f", "a=1&utm_source=q")


def test_xpath_of_equal_siblings_is_that_of_the_first():
    nodes = nodes_of("<ul><li><a href=/x>t</a></li><li><a href='/x'>t</a></li><li>z<a>u</a></li><li><a>u</a>z</li></ul>")
    paths = [e["xpath"] for e in nodes["elements"] if e["tag"] == "a"]
    assert paths == ["/[document]/ul/li[1]/a", "/[document]/ul/li[1]/a", "/[document]/ul/li[3]/a", "/[document]/ul/li[4]/a"]


def test_deeply_nested_pages_parse_in_linear_time():
    start = time.perf_counter()
    nodes = nodes_of("<p>x<b>" * 40_000 + "<a href=/>z</a></i>")
    assert len(nodes["elements"]) == 80_001 and nodes["elements"][0]["last"] == 80_000
    assert time.perf_counter() - start < 10


def test_unclosed_elements_nest_and_void_elements_close():
    nodes = nodes_of("<div><p>a<br><p>b</div>c")
    parents = {(e["tag"], e["id"]): e["parent"] for e in nodes["elements"]}
    assert parents == {("div", 0): -1, ("p", 1): 0, ("br", 2): 1, ("p", 3): 1}
    assert [t["text"] for t in nodes["texts"]] == ["a", "b", "c"]


def test_cleaned_text_keeps_text_and_loses_scripts(spark):
    html = ('<html><script>var x=1;</script><h1>Hello World</h1><!-- note --><div class="b a">Text</div>'
            "<iframe>inner</iframe></html>")
    text = P.clean_text(page(spark, html)).first().clean_text
    assert text == "Hello World Text"


def test_hashes_have_length(spark):
    row = P.content_hash_table(page(spark, "<html><body><h1>Test Page</h1><p>Content</p></body></html>")).first()
    assert row.content_length == len("Test Page Content") and row.content_hash_simhash != ""
    empty = P.content_hash_table(page(spark, "<script>x</script>")).first()
    assert (empty.content_hash_sha256, empty.content_hash_simhash, empty.content_length) == ("", "", 0)


def test_parsing_reads_only_needed_columns_and_runs_once(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id > 3")
    plan = P.page_text(pages.select("page_id", "html")).select("page_id", "text")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1 and "GreaterThan(page_id,3)" in physical
    assert "struct<page_id:bigint,html:string>" in physical


def test_missing_html_gives_nothing(spark):
    frame = spark.createDataFrame([("https://e.com/", None)], "url string, html string")
    assert L.extract_links(frame).count() == 0
    assert P.extract_content(frame).select(F.col("title")).first().title is None
