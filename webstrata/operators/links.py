"""Links of a page snapshot: extraction, the deduplicated link table and link counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions.expr import any_of, blank_to_null, let, record, strip
from webstrata.functions.urls import normalize_url_hardened, resolve_url, split_url
from webstrata.operators.pages import NODES, with_nodes

# Attributes that may carry a label, in order of preference.
LABEL_ATTRIBUTES = ["data-text", "data-label", "data-name", "data-action", "data-target"]

# Class names that describe what a link does.
CLASS_HINTS = ["skip", "back", "top", "close", "menu", "nav", "button", "link"]

LINK_KEY = ["source_url", "target_url", "anchor_text", "xpath", "href_url", "fragment", "url_parameters"]


def _label(kind: str, text: Column) -> Column:
    """`[KIND: text]`, or null when there is no text."""
    return F.when(blank_to_null(text).isNotNull(), F.concat(F.lit(f"[{kind}: "), text, F.lit("]")))


def _title_case(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _anchor_text(link: Column) -> Column:
    """Text of the link, else the first label its image, attributes or target can give."""
    image = F.get(F.filter(H.inside(NODES, link), lambda e: e["tag"] == "img"), F.lit(0))
    # The own text comes first, so the rest is only looked up where a link has none.
    return F.coalesce(blank_to_null(H.stripped_text_of(NODES, link)), let(image, lambda i: _fallback_text(link, i)))


def _fallback_text(link: Column, image: Column) -> Column:
    href = H.attr(link, "href")
    file_name = F.substring_index(H.attr(image, "src"), "/", -1)
    classes = F.filter(
        F.split(strip(H.attr(link, "class")), r"\s+"),
        lambda c: any_of([F.lower(c).contains(hint) for hint in CLASS_HINTS]))
    last_part = F.substring_index(href, "/", -1)
    readable = _title_case(F.translate(last_part, "-_", "  "))
    return F.coalesce(
        _label("IMG", strip(H.attr(image, "alt"))),
        _label("IMG", file_name),
        _label("TITLE", strip(H.attr(link, "title"))),
        _label("ARIA", strip(H.attr(link, "aria-label"))),
        *[_label("DATA", strip(H.attr(link, name))) for name in LABEL_ATTRIBUTES],
        _label("CLASS", F.array_join(classes, " ")),
        _label("ID", H.attr(link, "id")),
        F.when(href.startswith("#"), F.concat(F.lit("[ANCHOR: "), F.substr(href, F.lit(2)), F.lit("]"))),
        F.when(~href.startswith("javascript:") & ~last_part.startswith("#") & (F.char_length(readable) > 2),
               _label("PATH", readable)),
        F.lit(""),
    )


def found_links() -> Column:
    """Links of a parsed page as an array: href, anchor text, xpath."""
    anchors = F.filter(H.elements(NODES, "a"), lambda e: H.attr(e, "href").isNotNull())
    return F.transform(anchors, lambda e: record(
        href=H.attr(e, "href"), anchor_text=_anchor_text(e), xpath=e["xpath"]))


def links_of(pages: DataFrame, idn: bool = True) -> DataFrame:
    """One row per link of pages (url, links): where it points, normalized and as written, what it
    says, where it stands. Other columns are carried through."""
    carried = [c for c in pages.columns if c not in ("url", "links")]
    rows = pages.select("url", *carried, F.posexplode("links").alias("position", "_link")).select(
        "url", *carried, "position", "_link.*")
    resolved = rows.withColumn("original_href", resolve_url("url", "href", keep_fragment=True))
    parts = split_url("original_href")
    return resolved.select(
        *carried,
        F.col("url").alias("source_url"),
        F.col("position").cast("bigint").alias("position"),
        normalize_url_hardened("original_href", idn=idn).alias("target_url"),
        "original_href", "href", "anchor_text", "xpath",
        parts["fragment"].alias("fragment"),
        parts["query"].alias("url_parameters"),
    )


def extract_links(pages: DataFrame, idn: bool = True) -> DataFrame:
    """One row per <a href> of pages (url, html)."""
    parsed = with_nodes(pages)
    carried = [c for c in parsed.columns if c != NODES]
    return links_of(parsed.select(*carried, found_links().alias("links")), idn)


def link_table(links: DataFrame) -> DataFrame:
    """The link table: blank anchors, fragments and parameters become null, exact repeats collapse
    to their first discovery."""
    blanks = ["anchor_text", "fragment", "url_parameters"]
    tidy = links.withColumns({c: blank_to_null(c) for c in blanks})
    if "href_url" not in tidy.columns:
        tidy = tidy.withColumn("href_url", F.col("target_url"))
    return tidy.groupBy(*LINK_KEY).agg(F.min("discovered_at").alias("discovered_at"))


def link_counts(links: DataFrame, source: str = "source_url", target: str = "target_url",
                relation: str = "classification") -> DataFrame:
    """Per source: internal and external links, total and by distinct target.

    Links are first counted per (source, target), so a source with very many links is spread
    over all tasks and only one small row per distinct target reaches the second step.
    """
    internal = F.col(relation) == "internal"
    per_target = links.groupBy(source, target).agg(
        F.count_if(internal).alias("_in"), F.count_if(F.coalesce(~internal, F.lit(True))).alias("_out"))
    known = F.col(target).isNotNull()
    return per_target.groupBy(source).agg(
        F.sum("_in").alias("internal_links_count"),
        F.sum("_out").alias("external_links_count"),
        F.count_if(known & (F.col("_in") > 0)).alias("internal_links_unique_count"),
        F.count_if(known & (F.col("_out") > 0)).alias("external_links_unique_count"),
    )


def inlink_counts(links: DataFrame, source: str = "source_url", target: str = "target_url") -> DataFrame:
    """Per target: links pointing at it and distinct pages they stand on."""
    per_source = links.where(F.col(target).isNotNull()).groupBy(target, source).agg(F.count("*").alias("_n"))
    return per_source.groupBy(target).agg(
        F.sum("_n").alias("inlinks_count"), F.count("*").alias("inlinks_unique_count"))
