"""Page content: what a page says about itself, in one shuffle-free pass over the snapshot.

Input everywhere: a frame with `url` and `html`, optionally `headers` (map of response headers).
All other columns are carried through, `html` is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions.expr import blank_to_null, let, squeeze, strip, word_count
from webstrata.functions.hashing import content_hashes
from webstrata.functions.headers import header
from webstrata.functions.urls import resolve_url

NODES, SOURCE = "_nodes", "_source"


def with_nodes(pages: DataFrame, source: bool = False) -> DataFrame:
    """Replace `html` by its parsed nodes; with `source` the text itself stays, under another name."""
    carried = [c for c in pages.columns if c != "html"]
    return pages.select(*carried, *([F.col("html").alias(SOURCE)] if source else []), H.html_nodes("html").alias(NODES))


def parse_errors(pages: DataFrame) -> DataFrame:
    """Pages that could not be parsed, and why; every other operator takes them as pages without nodes."""
    parsed = with_nodes(pages.select("url", "html"))
    return parsed.select("url", F.col(NODES)["error"].alias("error")).where("error is not null")


def _first(tag: str, test=None) -> Column:
    found = H.elements(NODES, tag)
    return F.get(F.filter(found, test) if test else found, F.lit(0))


def _meta(name: str) -> Column:
    """Stripped content of the first <meta name=...>: null without the tag, blank without content."""
    return let(_first("meta", lambda e: H.attr(e, "name") == name), lambda tag: F.when(
        tag.isNotNull(), F.coalesce(strip(H.attr(tag, "content")), F.lit(""))))


def _headings(tag: str) -> Column:
    texts = F.transform(H.elements(NODES, tag), lambda e: strip(H.text_of(NODES, e)))
    return F.filter(texts, lambda t: t != "")


def _directives(value: Column) -> Column:
    parts = F.transform(F.split(value, ","), lambda d: F.lower(strip(d)))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def _language() -> Column:
    def stated(tag: Column, name: str) -> Column:
        return blank_to_null(strip(H.attr(tag, name)))

    return let(_first("html"), lambda page: F.coalesce(
        stated(page, "lang"), stated(_first("head"), "lang"), stated(page, "xml:lang")))


def _canonical_href() -> Column:
    return let(_first("link", lambda e: H.has_token(H.attr(e, "rel"), "canonical")), lambda tag: F.when(
        tag.isNotNull(), F.coalesce(strip(H.attr(tag, "href")), F.lit(""))))


def _alternates() -> Column:
    tags = F.filter(H.elements(NODES, "link"), lambda e: H.has_token(H.attr(e, "rel"), "alternate"))
    pairs = F.transform(tags, lambda e: F.struct(
        strip(H.attr(e, "href")).alias("url"), strip(H.attr(e, "hreflang")).alias("hreflang")))
    return F.filter(pairs, lambda p: (p["url"] != "") & (p["hreflang"] != ""))


def _clean_text() -> Column:
    return squeeze(H.document_text(NODES, ["noscript", "iframe"], " "))


def content_of(parsed: DataFrame, **more: Column) -> DataFrame:
    """Content columns of parsed pages; `more` adds further expressions over the same nodes."""
    headers = F.col("headers") if "headers" in parsed.columns else F.lit(None).cast("map<string,string>")
    carried = [c for c in parsed.columns if c not in (NODES, SOURCE, "headers")]
    title = let(_first("title"), lambda tag: F.when(tag.isNotNull(), strip(H.text_of(NODES, tag))))
    fields = parsed.select(
        *carried,
        title.alias("title"),
        _meta("description").alias("meta_description"),
        _headings("h1").alias("h1_tags"),
        _headings("h2").alias("h2_tags"),
        word_count(H.document_text(NODES, [], "")).alias("word_count"),
        let(_meta("robots"), _directives).alias("html_meta_directives"),
        let(header(headers, "x-robots-tag"), _directives).alias("http_header_directives"),
        _canonical_href().alias("canonical_url"),
        _language().alias("html_lang"),
        _alternates().alias("hreflang_urls"),
        *[column.alias(name) for name, column in more.items()],
        _clean_text().alias("_clean"),
    )
    kept = [c for c in fields.columns if c != "_clean"]
    return fields.select(*kept, content_hashes(F.col("_clean")).alias("_h")).select(*kept, "_h.*")


def extract_content(pages: DataFrame) -> DataFrame:
    """Title, descriptions, headings, robots directives, canonical, hreflang, language, word
    count and content hashes of every page."""
    return content_of(with_nodes(pages))


def contentful(pages: DataFrame) -> DataFrame:
    """Extracted pages worth keeping: status 200, html, and at least one of title, description, heading."""
    named = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("meta_description", F.lit("")) != "")
    headed = (F.size("h1_tags") > 0) | (F.size("h2_tags") > 0)
    return pages.where((F.col("status") == 200) & (F.col("kind") == "html") & (named | headed))


def page_text(pages: DataFrame) -> DataFrame:
    """Visible text of every page, as `text`."""
    parsed = with_nodes(pages)
    carried = [c for c in parsed.columns if c != NODES]
    return parsed.select(*carried, squeeze(H.document_text(NODES, ["noscript"], " ")).alias("text"))


def clean_text(pages: DataFrame) -> DataFrame:
    """Text used for content hashes, as `clean_text`."""
    parsed = with_nodes(pages)
    carried = [c for c in parsed.columns if c != NODES]
    return parsed.select(*carried, _clean_text().alias("clean_text"))


def content_hash_table(pages: DataFrame) -> DataFrame:
    """SHA-256, SimHash and length of the cleaned text of every page."""
    cleaned = clean_text(pages)
    carried = [c for c in cleaned.columns if c != "clean_text"]
    return cleaned.select(*carried, content_hashes(F.col("clean_text")).alias("_h")).select(*carried, "_h.*")


def canonical_of(pages: DataFrame) -> DataFrame:
    """The canonical link of every page resolved against the page URL, null without one."""
    parsed = with_nodes(pages)
    carried = [c for c in parsed.columns if c != NODES]
    tag = _first("link", lambda e: H.has_token(F.lower(H.attr(e, "rel")), "canonical")
                 & (H.attr(e, "href") != ""))
    return parsed.select(*carried, let(tag, lambda t: resolve_url(
        F.col("url"), strip(H.attr(t, "href")), keep_fragment=True)).alias("canonical_url"))
