"""Incremental ingest: a stream of fetched pages becomes the crawl tables.

The stream has url, final_url, status, kind, headers, html, chain and fetched_at. Pages are parsed
inside the streaming query, whose plan is built once; each micro-batch then only distributes what
was extracted, into folders of its own, so a replayed batch replaces its earlier attempt. `read_table`
gives a table as all batches together make it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webstrata.operators.extract import extract_fetches
from webstrata.operators.links import links_of
from webstrata.operators.pages import contentful
from webstrata.operators.schema_org import items_of
from webstrata.operators.tables import canonical_edges, hreflang_edges_html, page_metadata, redirect_table, row_digest
from webstrata.session import cut
from webstrata.streaming.versions import (SNAPSHOT_EVERY, Fold, folded, latest, merged, of_version, snapshot_due, write_batch,
                                          write_snapshot)

#: Tables with one row per key: the last that was written.
KEYED = {"page_metadata": ["url"], "content": ["url"], "redirects": ["source_url"]}
#: Tables with any number of rows per page, by the column of the page: those of its last version.
OF_PAGE = {"internal_links": "source_url", "schema_items": "url", "canonical_urls": "url", "hreflang_html_head": "url"}
TABLES = ["urls", *KEYED, *OF_PAGE]
_VERSIONS = latest(["url"])
_SIGHTINGS = folded(["url"], kind=lambda _: F.max_by("kind", F.struct("last_seen", "kind")), first_seen=F.min, last_seen=F.max)


def _last_version(pages: DataFrame) -> DataFrame:
    """One row per page of a batch: of several fetches the last, of equal times the content decides."""
    plain = [c for c, t in pages.dtypes if t in ("string", "int", "bigint") and c != "url"]
    order = F.struct("fetched_at", row_digest(plain))
    best = pages.select("url", order.alias("_at")).groupBy("url").agg(F.max("_at").alias("_best"))
    return pages.withColumn("_at", order).join(best, "url").where("_at = _best").drop("_at", "_best").dropDuplicates(["url"])


def ingest_batch(extracted: DataFrame, batch_id: int, out: str) -> None:
    """Write what one batch of extracted fetches contributes: pages and urls first, then content,
    links, items and redirects, then edges from page heads.

    An unchanged answer (304) is only a sighting of its URL; the page stays as an earlier batch wrote it.
    """
    seen = cut(extracted)
    batch = seen.where(F.coalesce(F.col("status") != 304, F.lit(True)))
    fetches = batch.select(F.col("requested_url").alias("url"), F.col("url").alias("final_url"), "status", "kind", "chain",
                           "fetched_at", F.col("response_headers").alias("headers"))
    pages = cut(_last_version(batch.drop("requested_url", "chain", "response_headers")))
    content = contentful(pages)
    write_batch(page_metadata(fetches), out, "page_metadata", batch_id)
    write_batch(pages.select("url"), out, "versions", batch_id)
    write_batch(seen.select(F.col("requested_url").alias("url"), "kind", F.col("fetched_at").alias("last_seen")).groupBy("url").agg(
        F.max_by("kind", F.struct("last_seen", "kind")).alias("kind"), F.min("last_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen")), out, "urls", batch_id)
    write_batch(content.drop("links", "items"), out, "content", batch_id)
    write_batch(links_of(pages.select("url", "links", F.col("fetched_at").alias("discovered_at"))),
                out, "internal_links", batch_id)
    write_batch(items_of(content), out, "schema_items", batch_id)
    write_batch(redirect_table(fetches), out, "redirects", batch_id)
    write_batch(canonical_edges(content), out, "canonical_urls", batch_id)
    write_batch(hreflang_edges_html(content), out, "hreflang_html_head", batch_id)


def _fold(spark: SparkSession, out: str, table: str, batch_id: int | None) -> Fold:
    if table == "urls":
        return _SIGHTINGS
    if table in KEYED:
        return latest(KEYED[table], ["fetched_at"] if table != "redirects" else None)
    return of_version(OF_PAGE[table], merged(spark, out, "versions", _VERSIONS, batch_id))


def read_table(spark: SparkSession, out: str, table: str, batch_id: int | None = None) -> DataFrame:
    """A table as the batches up to `batch_id` (default all) make it.

    `urls` has the kind of the last sighting and the first and last time; `page_metadata`, `content` and `redirects` the
    last row of a URL; the others all rows of the last version of a page, none if that has none.
    """
    return merged(spark, out, table, _fold(spark, out, table, batch_id), batch_id).drop("batch")


def write_snapshots(spark: SparkSession, out: str, batch_id: int) -> None:
    """Write all tables as they are after a batch, so that later reads start from there."""
    for table in TABLES:
        write_snapshot(spark, out, table, _fold(spark, out, table, batch_id), batch_id)
    write_snapshot(spark, out, "versions", _VERSIONS, batch_id)


def stream_ingest(pages_stream: DataFrame, out: str, checkpoint: str | None = None,
                  available_now: bool = True, snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Start the ingest. With `available_now` it processes what is there and stops."""
    def ingest(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, out)
        if snapshot_due(batch_id, snapshot_every):
            write_snapshots(batch.sparkSession, out, batch_id)

    place = checkpoint or f"{out.rstrip('/')}/_checkpoint"
    writer = extract_fetches(pages_stream).writeStream.option("checkpointLocation", place).foreachBatch(ingest)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
