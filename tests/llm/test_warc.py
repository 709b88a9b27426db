import base64
import gzip
import hashlib
from email import message_from_bytes
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webstrata.llm import warc
from webstrata.llm.shared_files import filesystem
from webstrata.session import scratch_path

SOURCE = {"record_id": "<urn:uuid:1>", "target_uri": "http://a.b/c", "date": "2024-01-02T03:04:05Z", "status_line": "HTTP/1.1 200 OK",
          "headers": [("Content-Type", "text/html"), ("X-Odd", "a\r\nInjected: b")],
          "body": "<html><head><title>T &amp; t</title></head><body><h1>One</h1><p>two <b>three</b></p></body></html>"}


def test_records_lead_back_to_their_source():
    (k1, metadata, m), (k2, conversion, c) = warc.derive(SOURCE)
    (mh, mb), (ch, cb) = warc.parse(m), warc.parse(c)
    assert (k1, k2) == (mh["WARC-Type"], ch["WARC-Type"]) == ("metadata", "conversion")
    assert mh["WARC-Refers-To"] == ch["WARC-Refers-To"] == "<urn:uuid:1>" and metadata == mh["WARC-Record-ID"] and "WARC-Concurrent-To" not in ch
    assert mh["WARC-Target-URI"] == "http://a.b/c" and ch["WARC-Date"] == "2024-01-02T03:04:05Z" and ch["WARC-Record-ID"] == conversion
    about = dict(line.split(": ", 1) for line in mb.decode().split("\r\n") if line)
    assert about["conversion"] == conversion and about["source-payload-digest"] == warc.digest(SOURCE["body"].encode())
    assert about["source-header-x-odd"] == "a Injected: b" and "Injected" not in about and about["title"] == "T & t"
    assert cb == b"One\ntwo three" and about["text-digest"] == ch["WARC-Block-Digest"] == warc.digest(cb)
    assert warc.derive(SOURCE) == warc.derive(dict(SOURCE))
    with pytest.raises(ValueError):
        warc.parse(c.replace(b"three", b"thre3"))


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain & simple", "plain & simple"), ("a<br>b<br/>c", "a\nb\nc"), ("x<script>if (a<b) '</p>'</script>y", "xy"),
    ("a<!-- <p>b</p> -->c", "ac"), ("a<!-- open", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p title='a > b'>t</p>", "t"),
    ("<p title='open>t</p>u", "t\nu"), ("<script>never closed", ""), ("&lt;b&gt; &eacute; &#x1F600;", "<b> é 😀"), ("<![foo[ x ]]>y", "y"),
    ("<style/>a", "a"), ("<td>a</td><td>b</td>", "a\nb"), ("<A HREF=x>Link</A>", "Link"), ("<", "<"), ("a <", "a <"), ("<p", "")])
def test_plain_text(page, text):
    assert warc.plain_text(page) == text


def test_plain_text_takes_linear_time():
    for page in ("<!--" * 50_000, "<script>" * 50_000, "<a " * 100_000, "<a b='" * 60_000, "<" * 200_000, "<p>" * 100_000, "&" * 200_000):
        warc.plain_text(page)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write_derived(warc.responses(pages.repartition(3)), scratch_path(spark, "warc"))
    rows = warc.read_derived(index).collect()
    known = {warc.record_id(str(p.page_id), p.url): p for p in pages.collect()}
    assert len(rows) == 2 * len(known)
    for r in rows:
        page = known[r.refers_to]
        assert r.target_uri == page.url
        if r.type == "conversion":
            assert r.block.decode() == warc.plain_text(page.html)
        else:
            assert f"source-payload-digest: {warc.digest(page.html.encode())}\r\n" in r.block.decode()
    by_id = {r.record_id: r for r in rows}
    for entry in index.limit(20).collect():            # single records, by the index
        files, path = filesystem(entry.path)
        headers, block = warc.parse(gzip.decompress(files.open_input_file(path).read_at(entry.length, entry.offset)))
        assert headers["WARC-Record-ID"] == entry.record_id and block == by_id[entry.record_id].block
    whole = files.open_input_file(path).read()
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


class PlainText(HTMLParser):
    """Words by another route: everything outside of silent elements, blocks apart."""

    def __init__(self):
        super().__init__()
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "head")
        self.out.append("\n" if tag not in ("a", "b", "i", "span") else "")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "head")
        self.out.append("\n" if tag not in ("a", "b", "i", "span") else "")

    def handle_data(self, data):
        self.out.append("" if self.silent else data)


def archive(data):
    """The records of a file by an independent reading: gzip, header lines, length, line ends."""
    data, at = gzip.decompress(data), 0
    while at < len(data):
        head, end = data[at:], data.index(b"\r\n\r\n", at)
        assert head.startswith(b"WARC/1.1\r\n")
        headers = message_from_bytes(data[at + 10:end + 4])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4
        assert data[at - 4:at] == b"\r\n\r\n"


def test_files_keep_the_standard(spark, sf):
    """Read by an independent reader: mandatory fields, unique ids, digests, links, and text by another route."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sources = warc.responses(pages).withColumn("headers", F.array(F.struct(F.lit("X-Page").alias("name"), F.col("target_uri").alias("value")))).withColumn(
        "status_line", F.lit("HTTP/1.1 203 Other")).withColumn("date", F.when(F.length("target_uri") % 2 == 0, "2024-05-06T07:08:09Z"))
    names, records = [], []
    for _ in range(2):
        index = warc.write_derived(sources, scratch_path(spark, "warc"), "2024-01-01T00:00:00Z")
        for path in sorted(r.path for r in index.select("path").distinct().collect()):
            files, place = filesystem(path)
            own = list(archive(files.open_input_file(place).read()))
            assert own[0][0]["WARC-Type"] == "warcinfo" and own[0][0]["WARC-Date"] == "2024-01-01T00:00:00Z"
            names.append(own[0][0]["WARC-Record-ID"])
            records += own[1:]
    assert len(set(names)) == len(names)
    html = {p.url: p.html for p in pages.collect()}
    ids = {h["WARC-Record-ID"] for h, _ in records}
    for headers, block in records:
        kind, url = headers["WARC-Type"], headers["WARC-Target-URI"]
        assert kind in ("metadata", "conversion") and headers["WARC-Concurrent-To"] is None and headers["WARC-Record-ID"] != headers["WARC-Refers-To"]
        assert headers["WARC-Date"] == ("2024-05-06T07:08:09Z" if len(url) % 2 == 0 else warc.NO_DATE)
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if kind == "metadata":
            about = message_from_bytes(block)
            assert about["conversion"] in ids and about["source-status"] == "HTTP/1.1 203 Other" and about["source-header-x-page"] == url
            assert about["source-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html[url].encode()).digest()).decode()
        else:
            parser = PlainText()
            parser.feed(html[url])
            parser.close()
            assert block.decode().split() == "".join(parser.out).split()


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "y"), (2, "", "", "z"), (2, "", "", "z"), (3, "é\nInjected: x", "\x00", "w"),
                                   (4, "v", "<p>long " * 40_000, "q")], "page_id long, url string, html string, record_id string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 12 and len({r.record_id for r in rows}) == 10
    text = [r for r in rows if r.type == "conversion" and r.target_uri == "u"][0]
    assert text.n_bytes == 0 and text.block_sha256 == hashlib.sha256(b"").hexdigest()
    assert warc.derivatives(pages.limit(0)).collect() == []
