"""Crawl depth: breadth-first search from the seeds over links and redirects."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.operators.skew import hot_keys, repeated, salted
from webstrata.session import cut

REACH = 64      # redirects in a row that are solved before the search


def _hops(redirects: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(at, next): where each URL redirects to; only URLs of `allowed` are passed through."""
    hops = redirects.where("target_url_id is not null and source_url_id <> target_url_id").groupBy(
        F.col("source_url_id").alias("at")).agg(F.min("target_url_id").alias("next"))
    if allowed is not None:
        hops = hops.join(allowed.select(F.col("url_id").alias("next")), "next", "left_semi").select("at", "next")
    return cut(hops)


def _led(hops: DataFrame) -> tuple[DataFrame, bool]:
    """(at, to, prev) for every URL `to` that the redirects from `at` lead to within REACH hops, `prev` being the URL just
    before it; and whether some lead further.

    Pointers double their reach, so rounds grow with the logarithm of the longest chain. A cycle leads to all its URLs
    and is complete when a round adds nothing. Rows are as many as chains have steps from each of their URLs on, which
    is few: clients give up after some twenty hops.
    """
    led, jumps, reach = cut(hops.select("at", F.col("next").alias("to"), F.col("at").alias("prev"))), hops, 1
    size = led.count()
    while size and reach < REACH:
        further = jumps.join(led.select(F.col("at").alias("next"), "to", "prev"), "next").select("at", "to", "prev")
        led = cut(led.unionByName(further).distinct())
        onward = jumps.select(F.col("at").alias("next"), F.col("next").alias("_far"))
        jumps, reach, before, size = cut(jumps.join(onward, "next").select("at", F.col("_far").alias("next"))), 2 * reach, size, led.count()
        if size == before:
            return led, False
    return led, bool(size) and not jumps.isEmpty()


def crawl_depth(seeds: DataFrame, links: DataFrame, redirects: DataFrame | None = None,
                crawlable: DataFrame | None = None, max_depth: int = 3, max_pages: int | None = None,
                url_list: DataFrame | None = None, list_is_seed: bool = False) -> DataFrame:
    """(url_id, depth, parent_id) of every page reached from `seeds(url_id)`.

    A click adds one to the depth, a redirect adds nothing; of several discoverers in a round the
    smallest id is the parent. Only ids in `crawlable` are entered. A `url_list(url_id)` alone
    restricts the crawl to its URLs and follows no links; with `list_is_seed` its URLs are further
    seeds. `max_pages` ends the search after the level that reaches it.

    Where redirects lead is solved once, before the search, and added to the links: a level is one join of the URLs found
    last with all they lead to. Each level is written out, which keeps lineage short.
    """
    allowed = None if crawlable is None else crawlable.select("url_id").distinct()

    def enter(found: DataFrame) -> DataFrame:
        return found if allowed is None else found.join(allowed, "url_id", "left_semi")

    if url_list is not None and not list_is_seed:
        return enter(url_list.select("url_id").distinct()).select(
            "url_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_id"))

    start = seeds.select("url_id")
    if url_list is not None:
        start = start.unionByName(url_list.select("url_id"))
    start = enter(start.distinct()).select("url_id", F.lit(None).cast("bigint").alias("parent_id"))
    pairs = enter(links.where("target_url_id is not null and source_url_id <> target_url_id").select(
        "source_url_id", F.col("target_url_id").alias("url_id")).distinct())
    pairs = pairs.withColumn("parent_id", F.col("source_url_id"))
    led, longer = (None, False) if redirects is None else _led(_hops(redirects, allowed))

    def with_led(found: DataFrame) -> DataFrame:
        """`found` with what its URLs redirect to."""
        if led is None:
            return found
        onward = found.withColumnRenamed("url_id", "at").drop("parent_id").distinct().join(led, "at")
        return found.unionByName(onward.select(*[F.col({"url_id": "to", "parent_id": "prev"}.get(c, c)).alias(c) for c in found.columns]))

    def settle(found: DataFrame, depth: int) -> DataFrame:
        return found.groupBy("url_id").agg(F.min("parent_id").alias("parent_id")).select(
            "url_id", F.lit(depth).cast("bigint").alias("depth"), "parent_id")

    def complete(level: DataFrame, visited: DataFrame | None) -> DataFrame:
        """A level with what lies beyond REACH hops, if anything does."""
        if not longer or level.isEmpty():
            return level
        depth = level.first().depth
        while True:
            known = level.select("url_id") if visited is None else level.select("url_id").unionByName(visited)
            more = cut(settle(with_led(level.select("url_id", "parent_id")).join(known, "url_id", "left_anti"), depth))
            if more.isEmpty():
                break
            level = cut(level.unionByName(more))
        # A smaller URL before one of them may have been found after it.
        before = with_led(level.select("url_id", "parent_id")).groupBy("url_id").agg(F.min("parent_id").alias("_least"))
        return cut(level.join(before, "url_id").select("url_id", "depth", F.when(F.col("parent_id").isNotNull(), F.col("_least")).alias("parent_id")))

    busy = cut(hot_keys(links, "source_url_id"))
    # Kept partitioned by source: each level then moves only itself, not the links. A lost copy is
    # rebuilt from the written table.
    edges = cut(salted(with_led(pairs), "source_url_id", busy)).repartition("source_url_id", "_salt").persist(
        StorageLevel.DISK_ONLY)

    # A seed stays a seed even if another seed redirects to it.
    first = with_led(start).groupBy("url_id").agg(
        F.max(F.col("parent_id").isNull()).alias("_seed"), F.min("parent_id").alias("parent_id"))
    level = complete(cut(first.select("url_id", F.lit(0).cast("bigint").alias("depth"),
                                      F.when(~F.col("_seed"), F.col("parent_id")).alias("parent_id"))), None)
    rounds = [level]
    for depth in range(1, max_depth + 1):
        visited = reduce(DataFrame.unionByName, rounds).select("url_id")
        if max_pages is not None and visited.count() >= max_pages:
            break
        origin = repeated(level.select(F.col("url_id").alias("source_url_id")), "source_url_id", busy)
        # What a known URL leads to is known as well.
        found = settle(edges.join(origin, ["source_url_id", "_salt"]), depth)
        level = complete(cut(found.join(visited, "url_id", "left_anti")), visited)
        if level.isEmpty():
            break
        rounds.append(level)
    edges.unpersist()
    reached = reduce(DataFrame.unionByName, rounds)
    return reached if max_pages is None else reached.orderBy("depth", "url_id").limit(max_pages)
