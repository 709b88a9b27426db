import hashlib
import json

import pytest

from webstrata.operators import schema_org as S
from webstrata.session import cut

HTML = """<html><head><script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"H","url":"bad",
"image":{"@type":"ImageObject","url":"/i.png"},"z":["/q",{"u":"/w"}]}</script>
<script type="application/ld+json">[{"@type":"http://schema.org/Product","name":"P","offers":{"price":1.50}},{"@graph":[{"@type":["VideoObject","X"],"name":"v"},{"@type":"WebPage"}]}]</script>
<script type="application/ld+json">{"@context":"https://schema.org","@type": oops}</script><script>var a={"@context":1}</script>
<meta property="x" content="https://schema.org/Thing"></head>
<body><!-- see http://schema.org/Foo --><div itemscope itemtype="https://schema.org/Organization"><span itemprop="name"> N </span>
<a itemprop="url" href="/home">x</a><img itemprop=logo src="/l.png"><img itemprop=logo src="m.png"><time itemprop=d datetime="2020">y</time></div>
<div itemscope>q</div><div vocab="https://schema.org/" typeof="Person"><b property="https://schema.org/name">Bob</b></div><p typeof="Foo"></p></body></html>"""


@pytest.fixture(scope="module")
def items(spark):
    return cut(S.extract_schema(spark.createDataFrame([("https://e.com/a/b", HTML), ("https://e.com/c", HTML)], "url string, html string")))


def first_page(items):
    return {(r.type, r.position): r for r in items.where("url like '%b'").collect()}


def test_sources_types_and_positions(items):
    rows = items.where("url like '%b'").orderBy("ordinal").collect()
    assert [(r.format, r.type, r.position) for r in rows] == [
        ("json-ld", "Article", "0"), ("json-ld", "Product", "100"), ("json-ld", "VideoObject", "101-0"), ("json-ld", "WebPage", "101-1"),
        ("json-ld", "InvalidJSON", "2"), ("microdata", "Organization", "0"), ("rdfa", "Person", "0"), ("rdfa", "Foo", "1"),
        ("json-ld", "BrokenJSON-LD", "2"), ("microdata", "BrokenMicrodata", "1"), ("rdfa", "BrokenRDFa", "1"), ("meta", "BrokenMetaSchema", "0"),
        ("comment", "BrokenCommentSchema", "1"), ("comment", "BrokenCommentSchema", "3"), ("json-ld", "BrokenScriptSchema", "3")]


def test_relative_values_become_absolute_except_strings_in_lists(items):
    data = json.loads(first_page(items)["Article", "0"].parsed_data)
    assert data["image"]["url"] == "https://e.com/i.png" and data["z"] == ["/q", {"u": "https://e.com/w"}]


def test_repeated_properties_become_lists(items):
    data = json.loads(first_page(items)["Organization", "0"].parsed_data)
    assert data == {"@type": "Organization", "name": "N", "url": "https://e.com/home", "logo": ["https://e.com/l.png", "m.png"], "d": "2020"}


def test_validation(items):
    rows = first_page(items)
    assert rows["Article", "0"].severity == "error" and len(rows["Article", "0"].validation_errors) == 2
    assert rows["VideoObject", "101-0"].severity == "critical" and rows["Product", "100"].is_valid


def test_hash_ignores_volatile_keys(items):
    want = hashlib.sha256(json.dumps(
        {"@context": "https://schema.org", "@type": "Article", "headline": "H", "image": {"@type": "ImageObject"},
         "z": ["/q", {"u": "https://e.com/w"}]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert first_page(items)["Article", "0"].content_hash == want


def test_roles_instances_and_references(items):
    roles = {(r.type, r.position): r.role for r in S.schema_roles(items).where("url like '%b'").collect()}
    assert roles["WebPage", "101-1"] == "main" and roles["Organization", "0"] == "property" and roles["Article", "0"] == "related"
    assert S.schema_instances(items).count() == 15
    assert S.schema_instances(items, faithful=True).count() == 8
    refs = S.schema_references(items).where("url like '%b'").collect()
    main = next(r for r in refs if r.is_main_entity)
    assert {r.property_name for r in refs if r.parent_ordinal == main.ordinal} == {"videoobject", "organization"}
    assert all(r.parent_ordinal is not None for r in S.schema_references(items, related_parent=True).collect() if not r.is_main_entity)


def items_from(spark, *blocks):
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    rows = S.extract_schema(spark.createDataFrame([("https://e.com/", html)], "url string, html string"), ["json-ld"]).orderBy("ordinal").collect()
    return [(r.type, r.position, r.parsed_data) for r in rows]


@pytest.mark.parametrize("block,want", [
    ('{"@type":"Product"};', [("InvalidJSON", "0", None)]),
    ('{"@type":"A"}{"@type":"B"}', [("InvalidJSON", "0", None)]),
    ('[{"@type":"A"}] x', [("InvalidJSON", "0", None)]),
    ('{"@type":"A","@type":"B"}', [("B", "0", '{"@type": "B"}')]),
    ('{"@type":"A","n":NaN,"m":[-Infinity]}', [("A", "0", '{"@type": "A", "n": NaN, "m": [-Infinity]}')]),
    ('[{"b":1,"@type":"A","a":"\\ud800"}]', [("A", "0", '{"b": 1, "@type": "A", "a": "\\ud800"}')]),
    ('{"@type":"\\ud800"}', [("?", "0", '{"@type": "\\ud800"}')]),
    ('{"@type":5}', [("ParseError", "0", None)]), ("[" * 100_000, [("ParseError", "0", None)]), ("7", []), ("{}", [("Unknown", "0", None)]),
    ('[{"@type":"A"},{"@type":{}},{"@type":"B"}]', [("A", "0", '{"@type": "A"}'), ("ParseError", "0", None)]),
    ('{"@type":"A","n":' + "1" * 5000 + "}", [("ParseError", "0", None)]),
])
def test_odd_blocks_end_no_job(spark, block, want):
    assert items_from(spark, block) == want


def test_whole_elements_tell_broken_items_apart(spark):
    pages = spark.createDataFrame([("https://e.com/1", "<div itemscope><b>one</b></div>"), ("https://e.com/2", "<div itemscope><b>two</div>"),
                                   ("https://e.com/3", "<p itemscope>left open <i>x")], "url string, html string")
    found = S.schema_instances(S.extract_schema(pages)).collect()
    assert sorted(r.raw_data for r in found) == ["<div itemscope><b>one</b></div>", "<div itemscope><b>two</div>", "<p itemscope>left open <i>x"]
