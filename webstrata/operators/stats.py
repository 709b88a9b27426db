"""Run statistics of one crawl and of many sites, and throughput over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.functions.expr import instant
from webstrata.functions.urls import site_key

METRICS = ["urls_total", "frontier_done", "frontier_queued", "frontier_pending", "pages_written",
           "status_200", "status_non200", "failures", "retries"]


def _parts(tables: dict[str, DataFrame]) -> list[tuple[str, dict[str, Column]]]:
    """Which metrics each table contributes; every metric is a sum over rows."""
    def one(condition: Column | None = None) -> Column:
        value = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
        return value.cast("bigint")

    status, final = F.col("status"), F.col("final_status_code")
    known = {
        "urls": {"urls_total": one()},
        "frontier": {f"frontier_{s}": one(status == s) for s in ("done", "queued", "pending")},
        "content": {"pages_written": one()},
        "page_metadata": {"status_200": one(final == 200), "status_non200": one(final != 200)},
        "failed_urls": {"failures": one(), "retries": F.col("retry_count").cast("bigint")},
    }
    return [(name, metrics) for name, metrics in known.items() if name in tables]


def _summed(tables: dict[str, DataFrame], keys: list[str], located) -> DataFrame:
    """One partial aggregate per table, added up by key: no join of tables and no cross join."""
    frames = []
    for name, metrics in _parts(tables):
        rows = located(name, tables[name])
        frames.append(rows.groupBy(*keys).agg(*[F.sum(e).alias(m) for m, e in metrics.items()]))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    present = [m for m in METRICS if m in merged.columns]
    return merged.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in present])


def crawl_stats(tables: dict[str, DataFrame], duration_seconds: float | None = None) -> DataFrame:
    """One row of run statistics from urls, frontier, content, page_metadata and failed_urls."""
    out = _summed(tables, [], lambda _, df: df)
    if duration_seconds:
        out = out.withColumn("pages_per_sec", F.col("pages_written") / F.lit(float(duration_seconds)))
    return out


def crawl_stats_by_site(tables: dict[str, DataFrame]) -> DataFrame:
    """Run statistics per site. Satellite tables find their site through the URL table."""
    sites = tables["urls"].select("url_id", site_key("url").alias("site"))

    def located(name: str, rows: DataFrame) -> DataFrame:
        if name == "urls":
            return rows.withColumn("site", site_key("url"))
        if "url" in rows.columns and "url_id" not in rows.columns:
            return rows.withColumn("site", site_key("url"))
        return rows.join(sites, "url_id")

    return _summed(tables, ["site"], located)


def _interval(at: Column, seconds: int) -> Column:
    return (F.floor(at / F.lit(seconds)) * F.lit(seconds)).cast("bigint")


def rate_counts(fetch_log: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(interval_start, pages) and (url, seen, done): the first intervals in which a URL was fetched, and with success."""
    at = F.unix_seconds(instant(fetch_log, "ts"))
    log = fetch_log.select("url", "status", _interval(at, seconds).alias("interval_start"))
    good = F.col("status") == 200
    return (log.groupBy("interval_start").agg(F.count_if(good).alias("pages")),
            log.groupBy("url").agg(F.min("interval_start").alias("seen"), F.min(F.when(good, F.col("interval_start"))).alias("done")))


def rates_of(pages: DataFrame, firsts: DataFrame, seconds: int) -> DataFrame:
    """Rates from both counts of `rate_counts`."""
    seen = firsts.groupBy(F.col("seen").alias("interval_start")).agg(F.count("*").alias("_seen"))
    done = firsts.where("done is not null").groupBy(F.col("done").alias("interval_start")).agg(F.count("*").alias("_done"))
    per_interval = pages.join(seen, "interval_start", "left").join(done, "interval_start", "left")
    # One row per interval, so the ordered running total is over elapsed time, not over the data.
    so_far = Window.orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    totals = per_interval.select(
        "interval_start", "pages", (F.col("pages") / F.lit(float(seconds))).alias("pages_per_sec"),
        F.coalesce(F.sum("_seen").over(so_far), F.lit(0)).alias("urls_found"),
        F.coalesce(F.sum("_done").over(so_far), F.lit(0)).alias("urls_done"))
    return totals.withColumn("done_pct", F.col("urls_done") * 100.0 / F.nullif(F.col("urls_found"), F.lit(0)))


def crawl_rate(fetch_log: DataFrame, seconds: int = 60) -> DataFrame:
    """Per interval: new pages, pages per second, and how many of the URLs seen so far are done."""
    return rates_of(*rate_counts(fetch_log, seconds), seconds)
