"""Failed URLs and their retry schedule, derived from a fetch log (event_id, ts, host, url, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.expr import instant, record
from webstrata.functions.scoring import failure_reason, retryable
from webstrata.operators.skew import join_unique


def failed_urls(fetch_log: DataFrame, retry_delay: float = 1.0, backoff_factor: float = 2.0,
                max_delay: float | None = None) -> DataFrame:
    """URLs that failed since their last success: the first failure has retry_count 0, each further
    one adds 1 and multiplies the waiting time, up to `max_delay` seconds if given. A success (2xx)
    clears the URL. A time beyond what a bigint of seconds can state is null: such a URL is never due."""
    fetch_log = fetch_log.withColumn("ts", instant(fetch_log, "ts"))
    order = F.struct("ts", "event_id")
    ok = fetch_log.where(F.col("status").between(200, 299)).groupBy("url").agg(F.max(order).alias("_ok"))
    failures = fetch_log.where(retryable("status")).select(
        "url", "status", "ts", "event_id", order.alias("_at"))
    open_failures = join_unique(failures, ok, "url", "left").where("_ok is null or _at > _ok")
    ledger = open_failures.groupBy("url").agg(
        F.max_by("status", "_at").alias("status_code"), (F.count("*") - 1).alias("retry_count"),
        F.unix_seconds(F.min("ts")).alias("created_at"), F.unix_seconds(F.max("ts")).alias("last_retry_at"))
    grown = F.lit(retry_delay) * F.pow(F.lit(backoff_factor), F.col("retry_count"))
    wait = grown if max_delay is None else F.least(grown, F.lit(max_delay))
    due = F.when(F.col("last_retry_at") + wait < F.lit(float(1 << 63)), F.col("last_retry_at") + F.floor(wait).cast("bigint"))
    return ledger.select(
        "url", "status_code", failure_reason("status_code").alias("failure_reason"), "retry_count",
        "created_at", "last_retry_at", due.alias("next_retry_at"))


def retry_ready(failed: DataFrame, now: int, max_retries: int = 3) -> DataFrame:
    """Failed URLs that are due and not given up, the longest waiting first."""
    due = (F.col("next_retry_at") <= now) & (F.col("retry_count") < max_retries)
    return failed.where(due).orderBy("next_retry_at", "url")


def retry_stats(failed: DataFrame, now: int) -> DataFrame:
    """Counts as rows (measure, label, n): all failed, by status, by retry count, due now."""
    totals = failed.agg(F.count("*").alias("total_failed"), F.count_if(F.col("next_retry_at") <= now).alias("ready_for_retry"))
    whole = totals.select(F.explode(F.array(*[
        record(measure=F.lit(m), label=F.lit(""), n=F.col(m)) for m in ("total_failed", "ready_for_retry")])).alias("_r")).select("_r.*")
    labels = F.array(record(measure=F.lit("by_status"), label=F.col("status_code").cast("string")),
                     record(measure=F.lit("by_retry_count"), label=F.col("retry_count").cast("string")))
    parts = failed.select(F.explode(labels).alias("_l")).groupBy("_l.measure", "_l.label").agg(F.count("*").alias("n"))
    return whole.unionByName(parts)
