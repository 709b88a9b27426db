"""Everything a page holds, from one parse: content, links and structured data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators.links import found_links
from webstrata.operators.pages import content_of, with_nodes
from webstrata.operators.schema_org import found_items


def extract_pages(pages: DataFrame, links: bool = True, schema: bool = True) -> DataFrame:
    """Content columns of pages (url, html, optionally headers) plus `links` and `items` arrays.

    Write the result, then take rows from it with `links_of` and `items_of`: the HTML is read and
    parsed once however many tables are made of it, and no step shuffles.
    """
    more = {}
    if links:
        more["links"] = found_links()
    if schema:
        more["items"] = found_items()
    return content_of(with_nodes(pages, source=schema), **more)


def extract_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches with their pages parsed. Unchanged answers (304) and other kinds of resources keep
    their row but are not parsed."""
    readable = (F.col("kind") == "html") & (F.col("status") != 304)
    return extract_pages(fetches.select(
        F.col("url").alias("requested_url"), F.col("final_url").alias("url"), "status", "kind", "chain", "fetched_at",
        "headers", F.col("headers").alias("response_headers"), F.when(readable, F.col("html")).alias("html")))
