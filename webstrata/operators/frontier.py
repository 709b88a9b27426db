"""The crawl frontier as a snapshot: seeding, batches, state changes, scores, backfill.

A frontier has url_id, depth, parent_id, status (queued, pending, done), enqueued_at,
updated_at, priority_score, sitemap_priority and reset_count, one row per url_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.scoring import priority_score
from webstrata.functions.urls import in_scope
from webstrata.operators.links import inlink_counts

COLUMNS = ["url_id", "depth", "parent_id", "status", "enqueued_at", "updated_at",
           "priority_score", "sitemap_priority", "reset_count"]


def _queued(urls: DataFrame, now: int, depth: Column, parent: Column, sitemap_priority: Column) -> DataFrame:
    at = F.lit(now).cast("bigint")
    return urls.select(
        "url_id", depth.cast("bigint").alias("depth"), parent.cast("bigint").alias("parent_id"),
        F.lit("queued").alias("status"), at.alias("enqueued_at"), at.alias("updated_at"),
        F.coalesce(sitemap_priority, F.lit(0.0)).cast("double").alias("priority_score"),
        sitemap_priority.cast("double").alias("sitemap_priority"), F.lit(0).cast("bigint").alias("reset_count"))


def frontier_seed(frontier: DataFrame, urls: DataFrame, now: int, depth: int = 0) -> DataFrame:
    """The frontier with `urls(url_id, sitemap_priority)` queued unless known in any status."""
    first = urls.groupBy("url_id").agg(F.max("sitemap_priority").alias("sitemap_priority"))
    fresh = first.join(frontier.select("url_id"), "url_id", "left_anti")
    return frontier.select(*COLUMNS).unionByName(
        _queued(fresh, now, F.lit(depth), F.lit(None), F.col("sitemap_priority")))


def frontier_new_children(frontier: DataFrame, children: DataFrame) -> DataFrame:
    """Discovered children (url_id, depth, parent_id, seq) the frontier lacks; the first discovery
    of each counts."""
    first = children.groupBy("url_id").agg(F.min(F.struct("seq", "depth", "parent_id")).alias("_c"))
    return first.select("url_id", "_c.depth", "_c.parent_id").join(frontier.select("url_id"), "url_id", "left_anti")


def frontier_enqueue(frontier: DataFrame, children: DataFrame, now: int) -> DataFrame:
    fresh = frontier_new_children(frontier, children)
    return frontier.select(*COLUMNS).unionByName(
        _queued(fresh, now, F.col("depth"), F.col("parent_id"), F.lit(None).cast("double")))


def frontier_next(frontier: DataFrame, urls: DataFrame, k: int) -> DataFrame:
    """The next k URLs: highest priority, then longest waiting, then lowest id, with their parent's URL.

    The top k is taken from the frontier alone; only its k rows are then looked up. Whether they are
    broadcast is left to their size.
    """
    top = frontier.where("status = 'queued'").orderBy(
        F.desc("priority_score"), F.asc("enqueued_at"), F.asc("url_id")).limit(k).select(
        "url_id", "depth", "parent_id", "priority_score", "enqueued_at")
    named = urls.select("url_id", "url").join(top, "url_id")
    parents = urls.select(F.col("url_id").alias("parent_id"), F.col("url").alias("parent_url")).join(
        top.select("parent_id").distinct(), "parent_id", "left_semi")
    # Both sides now have at most k rows.
    return named.join(parents, "parent_id", "left").select(
        "url_id", "url", "depth", "parent_url", "priority_score", "enqueued_at")


def frontier_mark_done(frontier: DataFrame, finished: DataFrame, now: int) -> DataFrame:
    """Finished URLs become done, unknown ones are added as done at depth 0."""
    hits = finished.select("url_id").distinct().withColumn("_hit", F.lit(True))
    joined = frontier.join(hits, "url_id", "full_outer")
    at, missing = F.lit(now).cast("bigint"), F.col("status").isNull()
    turned = F.col("_hit") & (missing | F.col("status").isin("queued", "pending"))
    changes = {
        "status": F.when(turned, "done").otherwise(F.col("status")),
        "updated_at": F.when(turned, at).otherwise(F.col("updated_at")),
        "reset_count": F.when(turned, F.lit(0).cast("bigint")).otherwise(F.col("reset_count")),
        "depth": F.when(missing, F.lit(0).cast("bigint")).otherwise(F.col("depth")),
        "enqueued_at": F.when(missing, at).otherwise(F.col("enqueued_at")),
        "priority_score": F.when(missing, F.lit(0.0)).otherwise(F.col("priority_score")),
    }
    return joined.withColumns(changes).select(*COLUMNS)


def frontier_clean(frontier: DataFrame, urls: DataFrame, now: int, excludes: list[str] | None = None,
                   restriction: str = "", domains: list[str] | None = None) -> DataFrame:
    """Queued URLs outside the scope rules become done; `cleaned` marks the rows that changed."""
    queued = F.col("status") == "queued"
    outside = ~in_scope("url", excludes, restriction, domains)
    named = frontier.join(urls.select("url_id", "url"), "url_id", "left")
    cleaned = F.coalesce(queued & outside, F.lit(False))
    return named.withColumn("cleaned", cleaned).withColumns({
        "status": F.when(F.col("cleaned"), "done").otherwise(F.col("status")),
        "updated_at": F.when(F.col("cleaned"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    }).select(*COLUMNS, "cleaned")


def frontier_reset_pending(frontier: DataFrame, now: int, max_resets: int = 5, url_id: int | None = None) -> DataFrame:
    """Stuck pending URLs are queued again, or given up after `max_resets` resets."""
    stuck = F.col("status") == "pending"
    if url_id is not None:
        stuck = stuck & (F.col("url_id") == url_id)
    spent = stuck & (F.col("reset_count") >= max_resets)
    again = stuck & (F.col("reset_count") < max_resets)
    return frontier.withColumns({
        "status": F.when(spent, "done").when(again, "queued").otherwise(F.col("status")),
        "reset_count": F.when(again, F.col("reset_count") + 1).otherwise(F.col("reset_count")),
        "updated_at": F.when(stuck, F.lit(now).cast("bigint")).otherwise(F.col("updated_at")),
    }).select(*COLUMNS)


def frontier_stats(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count_if(F.col("status") == "queued").alias("queued"),
                        F.count_if(F.col("status") == "done").alias("done"))


def filter_not_done(urls: DataFrame, frontier: DataFrame) -> DataFrame:
    return urls.join(frontier.where("status = 'done'").select("url_id"), "url_id", "left_anti")


def frontier_inlinks(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Number of links to each queued URL. Links are counted per target before the join."""
    counts = inlink_counts(links, "source_url_id", "target_url_id").select(
        F.col("target_url_id").alias("url_id"), "inlinks_count")
    return frontier.where("status = 'queued'").select("url_id").join(counts, "url_id", "left").select(
        "url_id", F.coalesce("inlinks_count", F.lit(0)).cast("bigint").alias("inlinks_count"))


def frontier_rescore(frontier: DataFrame, urls: DataFrame, links: DataFrame, strict: bool = True) -> DataFrame:
    """Queued URLs with their inlinks and the priority these give."""
    queued = frontier.where("status = 'queued'").select("url_id", "depth", "sitemap_priority")
    known = queued.join(urls.select("url_id", "url"), "url_id").join(frontier_inlinks(frontier, links), "url_id")
    return known.withColumn("priority_score", priority_score(
        "url", "depth", "sitemap_priority", "inlinks_count", strict=strict))


def frontier_scoring_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg("priority_score").alias("avg_priority"), F.max("priority_score").alias("max_priority"),
        F.min("priority_score").alias("min_priority"),
        F.count_if(F.col("sitemap_priority") > 0.5).alias("sitemap_priority_count"),
        F.avg("inlinks_count").alias("avg_inlinks"))


def frontier_missing(urls: DataFrame, frontier: DataFrame, canonicals: DataFrame, hreflang: DataFrame,
                     redirects: DataFrame) -> DataFrame:
    """Internal and network URLs outside the frontier, and how the crawl knows them. They would
    enter at depth 0."""
    absent = urls.where(F.col("classification").isin("internal", "network")).join(
        frontier.select("url_id"), "url_id", "left_anti")
    ways = {
        "is_canonical_target": canonicals.select(F.col("canonical_url_id").alias("url_id")),
        "is_hreflang_target": hreflang.select(F.col("href_url_id").alias("url_id")),
        "is_redirect_source": redirects.select(F.col("source_url_id").alias("url_id")),
        "is_redirect_target": redirects.select(F.col("target_url_id").alias("url_id")),
    }
    out = absent.select("url_id", "url", "classification", "kind")
    for name, ids in ways.items():
        known = ids.where("url_id is not null").distinct().withColumn(name, F.lit(True))
        out = out.join(known, "url_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("depth", F.lit(0).cast("bigint"))


def frontier_from_hreflang(frontier: DataFrame, html: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Targets of alternate-language links the frontier lacks, at depth 0."""
    targets = html.select("href_url_id").unionByName(sitemap.select("href_url_id")).distinct()
    return targets.select(F.col("href_url_id").alias("url_id")).where("url_id is not null").join(
        frontier.select("url_id"), "url_id", "left_anti").withColumn("depth", F.lit(0).cast("bigint"))
