"""Throughput of a running crawl, from a stream of fetches (ts, url, status).

`crawl_rate_stream` counts pages per interval with a watermark. `stream_crawl_progress` also says how many URLs were
found and done by then: each micro-batch appends its pages per interval and the first times it saw its URLs and saw them
done. Counts add up and first times are least times, so batches fold in any order: late events change what they should,
and a batch needs nothing of those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webstrata.functions.expr import instant
from webstrata.operators.stats import rate_counts, rates_of
from webstrata.session import cut
from webstrata.streaming.versions import SNAPSHOT_EVERY, folded, merged, snapshot_due, write_batch, write_snapshot

TABLES = {"rate_pages": folded(["interval_start"], pages=F.sum),
          "rate_urls": folded(["url"], seen=F.min, done=F.min)}


def crawl_rate_stream(fetch_log: DataFrame, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """New pages and pages per second per interval. An interval is final once the watermark passes it."""
    timed = fetch_log.select(instant(fetch_log, "ts").alias("ts"), "status").withWatermark("ts", watermark)
    pages = F.count_if(F.col("status") == 200)
    return timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(pages.alias("pages")).select(
        F.unix_seconds("w.start").alias("interval_start"), "pages",
        (F.col("pages") / F.lit(float(seconds))).alias("pages_per_sec"))


def progress_batch(batch: DataFrame, batch_id: int, out: str, seconds: int = 60) -> None:
    """Write what one batch says of intervals and URLs: as many rows as it has intervals and URLs."""
    for table, rows in zip(TABLES, rate_counts(cut(batch.select("ts", "url", "status")), seconds)):
        write_batch(rows, out, table, batch_id)


def stream_crawl_progress(fetch_log: DataFrame, out: str, seconds: int = 60, checkpoint: str | None = None,
                          available_now: bool = True, snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Keep the counts that `crawl_progress` reads up to date."""
    def count(batch: DataFrame, batch_id: int) -> None:
        progress_batch(batch, batch_id, out, seconds)
        if snapshot_due(batch_id, snapshot_every):
            for table, fold in TABLES.items():
                write_snapshot(batch.sparkSession, out, table, fold, batch_id)

    place = checkpoint or f"{out.rstrip('/')}/_checkpoint"
    writer = fetch_log.writeStream.option("checkpointLocation", place).foreachBatch(count)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def crawl_progress(spark: SparkSession, out: str, seconds: int = 60, batch_id: int | None = None) -> DataFrame:
    """Per interval: pages, pages per second, URLs found and done so far, as `stats.crawl_rate` gives them for the log."""
    pages, urls = (merged(spark, out, table, fold, batch_id).drop("batch") for table, fold in TABLES.items())
    return rates_of(pages, urls, seconds)
