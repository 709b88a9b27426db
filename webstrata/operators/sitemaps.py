"""Sitemaps: parse files, follow indexes, and the tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.expr import blank_to_null, strip
from webstrata.functions.sitemap_files import sitemap_file
from webstrata.functions.urls import normalize_url_for_storage
from webstrata.session import cut

def read_sitemaps(files: DataFrame) -> DataFrame:
    """(sitemap_url, children, entries, error): sitemap files (sitemap_url, xml), each read once.

    A file is one row of at most 50 MB and 50 000 entries by the sitemap protocol. Write the result where children and
    entries are both wanted: every function below takes files as well as what was read from them.
    """
    if "entries" in files.columns:
        return files
    return files.select("sitemap_url", sitemap_file(F.col("xml")).alias("_x")).select("sitemap_url", "_x.*")


def sitemap_errors(files: DataFrame) -> DataFrame:
    """(sitemap_url, error, entries_read, children_read) of files that break off; what stands before the break is kept."""
    broken = read_sitemaps(files).where("error is not null")
    return broken.select("sitemap_url", "error", F.size("entries").cast("bigint").alias("entries_read"),
                         F.size("children").cast("bigint").alias("children_read"))


def sitemap_kind(xml: Column) -> Column:
    """`sitemap_index` or `sitemap` by the root element."""
    root = F.lower(F.regexp_extract(xml, r"(?s)^(?:\s|\uFEFF|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([\w:.-]+)", 1))
    return F.when(root.endswith("sitemapindex"), "sitemap_index").otherwise("sitemap")


def sitemap_children(files: DataFrame) -> DataFrame:
    """Child sitemaps named by index files, in file order."""
    rows = read_sitemaps(files).select("sitemap_url", F.posexplode("children").alias("position", "_s"))
    child = blank_to_null(strip("_s"))
    return rows.select("sitemap_url", F.col("position").cast("bigint").alias("position"),
                       child.alias("child_url")).where("child_url is not null")


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """URL entries of sitemap files (sitemap_url, xml): position, priority, lastmod, alternates.

    A file that lists child sitemaps contributes none. Of a URL listed twice in a file the last
    entry counts, at the place of the first.
    """
    rows = read_sitemaps(files).where(F.size("children") <= 0).select("sitemap_url", F.posexplode("entries").alias("position", "_u"))
    entries = rows.select(
        "sitemap_url", blank_to_null(strip("_u.loc")).alias("url"), F.col("position").cast("bigint").alias("position"),
        strip("_u.priority").try_cast("double").alias("priority"),
        blank_to_null(strip("_u.lastmod")).alias("lastmod"), "_u.hreflangs", "_u.hrefs",
    ).where("url is not null")
    last = F.max(F.struct("position", "priority", "lastmod", "hreflangs", "hrefs"))
    return entries.groupBy("sitemap_url", "url").agg(F.min("position").alias("first"), last.alias("_l")).select(
        "sitemap_url", "url", F.col("first").alias("position"),
        "_l.priority", "_l.lastmod", "_l.hreflangs", "_l.hrefs")


def expand_sitemaps(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """All sitemap files reached from `seeds(sitemap_url, position)`, in first-in first-out order.

    Every file is visited once. `visit` sorts in visiting order, `depth` counts index hops and
    `parent` is the index that named the file first. One round per nesting level.
    """
    children = cut(sitemap_children(files))
    on_file = files.select("sitemap_url")
    step = seeds.groupBy("sitemap_url").agg(F.array(F.min(F.col("position").cast("bigint"))).alias("visit")).withColumn(
        "parent", F.lit(None).cast("string"))
    level = cut(step.join(on_file, "sitemap_url", "left_semi").withColumn("depth", F.lit(0).cast("bigint")))
    rounds: list[DataFrame] = []
    while not level.isEmpty():
        rounds.append(level)
        visited = reduce(DataFrame.unionByName, rounds).select("sitemap_url")
        named = level.select(F.col("sitemap_url").alias("parent"), "visit", "depth").join(
            children.withColumnRenamed("sitemap_url", "parent"), "parent").select(
            F.col("child_url").alias("sitemap_url"), "parent", (F.col("depth") + 1).alias("depth"),
            F.concat("visit", F.array("position")).alias("visit"))
        # Paths of one level have equal length, so their order is the order of the queue.
        first = named.groupBy("sitemap_url").agg(F.min(F.struct("visit", "parent", "depth")).alias("_f")).select(
            "sitemap_url", "_f.visit", "_f.parent", "_f.depth")
        level = cut(first.join(visited, "sitemap_url", "left_anti").join(on_file, "sitemap_url", "left_semi"))
    reached = reduce(DataFrame.unionByName, rounds) if rounds else level
    return reached.select("sitemap_url", "parent", "depth", "visit")


def sitemap_urls(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """URL entries of all reached files; of a URL in several files the one visited last counts. Every file is read once."""
    files = cut(read_sitemaps(files))
    reached = cut(expand_sitemaps(seeds, files))
    entries = parse_sitemaps(files.join(reached.select("sitemap_url"), "sitemap_url", "left_semi"))
    ordered = entries.join(reached.select("sitemap_url", "depth", "visit"), "sitemap_url")
    last = F.max(F.struct("depth", "visit", "sitemap_url", "position", "priority", "lastmod", "hreflangs", "hrefs"))
    return ordered.groupBy("url").agg(last.alias("_l")).select(
        "url", "_l.sitemap_url", "_l.position", "_l.priority", "_l.lastmod", "_l.hreflangs", "_l.hrefs")


def sitemap_tables(entries: DataFrame, discovered_at: Column | int) -> tuple[DataFrame, DataFrame]:
    """(sitemaps, url_sitemaps) of sitemap entries: totals per sitemap, and which URL stands where."""
    when = F.lit(discovered_at) if isinstance(discovered_at, int) else discovered_at
    rows = entries.select("sitemap_url", normalize_url_for_storage("url").alias("url"), "position",
                          when.cast("bigint").alias("discovered_at"))
    sitemaps = rows.groupBy("sitemap_url").agg(
        F.count("*").alias("total_urls_found"), F.min("discovered_at").alias("discovered_at"))
    places = rows.groupBy("url", "sitemap_url").agg(
        F.min("position").alias("position"), F.min("discovered_at").alias("discovered_at"))
    return sitemaps, places


def sitemap_hreflang(entries: DataFrame, known_urls: DataFrame | None = None) -> DataFrame:
    """Alternates listed in sitemaps, one row per language and target. With `known_urls(url)`
    entries whose page is unknown are left out; without, all are kept."""
    rows = entries.select(
        normalize_url_for_storage("url").alias("url"),
        F.explode(F.arrays_zip(F.col("hreflangs").alias("language_code"), F.col("hrefs").alias("href_url"))).alias("_p"))
    pairs = rows.select("url", "_p.language_code", "_p.href_url").where(
        "language_code <> '' and href_url <> ''").distinct()
    return pairs if known_urls is None else pairs.join(known_urls.select("url").distinct(), "url", "left_semi")
