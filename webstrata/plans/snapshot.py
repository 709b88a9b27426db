"""From recorded fetches to the crawl tables all views read.

Every table is keyed by `url_id`, the 64-bit hash of the stored URL, so ids need no lookup join.
Pages are parsed once; what several tables need is written once to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.headers import header
from webstrata.functions.scoring import priority_score
from webstrata.functions.urls import classify_kind, classify_url, normalize_url_for_storage
from webstrata.operators import schema_org as S
from webstrata.operators import sitemaps as M
from webstrata.operators import tables as E
from webstrata.operators.depth import crawl_depth
from webstrata.operators.extract import extract_fetches
from webstrata.operators.links import inlink_counts, link_counts, link_table, links_of
from webstrata.operators.pages import contentful
from webstrata.operators.robots import parse_robots, robots_verdict, sitemaps_from_robots
from webstrata.operators.skew import hot_keys, join_unique
from webstrata.operators.url_jobs import should_crawl
from webstrata.session import cut


def url_id(url: Column | str) -> Column:
    return F.xxhash64(url)


def _latest(rows: DataFrame, key: str, told: list[str]) -> DataFrame:
    """The row fetched last for each key; among equal times the columns `told` decide."""
    rest = [c for c in rows.columns if c != key]
    last = F.struct(F.col("fetched_at"), E.row_digest(told))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), last).alias("_r")).select(key, "_r.*")


def _known_urls(mentions: list[DataFrame], base_domain: str) -> DataFrame:
    """The URL table: every URL fetched or mentioned, with the best known kind and its class."""
    seen = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mentions).where("url is not null and url <> ''")
    informed = F.when(F.col("kind") != "other", F.col("seen_at"))
    merged = seen.groupBy("url").agg(
        F.coalesce(F.max_by("kind", informed), F.lit("other")).alias("kind"),
        F.coalesce(F.bool_or("from_hreflang"), F.lit(False)).alias("from_hreflang"),
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return merged.select(url_id("url").alias("url_id"), "url", "kind",
                         classify_url("url", base_domain, F.col("from_hreflang")).alias("classification"),
                         "first_seen", "last_seen")


def _mentioned(rows: DataFrame, url: str, at: Column, kind: str | Column = "other", hreflang: bool = False) -> DataFrame:
    return rows.select(F.col(url).alias("url"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                       at.cast("bigint").alias("seen_at"), F.lit(hreflang).alias("from_hreflang"))


def crawl_tables(fetches: DataFrame, base_domain: str, agent: str, robots_files: DataFrame | None = None,
                 sitemap_files: DataFrame | None = None, seeds: DataFrame | None = None,
                 max_depth: int = 3) -> dict[str, DataFrame]:
    """The tables of one crawl from its fetches (url, final_url, status, headers, html, chain,
    fetched_at), robots files (domain, body) and sitemap files (sitemap_url, xml).

    Depth counts from `seeds(url)`, by default the home page, and from sitemap URLs. Of several
    fetches of a URL the last one counts, but an unchanged answer (304) only moves `last_seen`: the
    page keeps the content, links and status of the fetch before.
    """
    spark = fetches.sparkSession
    stored = fetches.withColumns({
        "url": normalize_url_for_storage("url"), "final_url": normalize_url_for_storage("final_url"),
        "kind": classify_kind(header("headers", "content-type"), "final_url")})
    pages = cut(extract_fetches(E.winning_fetches(stored)))
    fetched = pages.select(F.col("requested_url").alias("url"), F.col("url").alias("final_url"), "status", "kind", "chain",
                           "fetched_at", F.col("response_headers").alias("headers"))
    metadata, redirects = E.page_metadata(fetched), E.redirect_table(fetched)
    content = cut(_latest(contentful(pages).drop("chain", "response_headers"), "url", ["requested_url"]).drop("requested_url"))
    links = cut(link_table(links_of(pages.select("url", "links", F.col("fetched_at").alias("discovered_at")))))
    items = cut(S.items_of(content))
    canonicals, alternates = E.canonical_edges(content), E.hreflang_edges_html(content)

    rules = parse_robots(robots_files if robots_files is not None else spark.createDataFrame([], "domain string, body string"))
    files = sitemap_files if sitemap_files is not None else spark.createDataFrame([], "sitemap_url string, xml string")
    if robots_files is not None:
        roots = sitemaps_from_robots(robots_files, files).select("sitemap_url", "position")
    else:
        roots = files.select("sitemap_url", F.lit(0).cast("bigint").alias("position"))
    entries = cut(M.sitemap_urls(roots, files))
    listed, places = M.sitemap_tables(entries, 0)
    sitemap_alternates = M.sitemap_hreflang(entries)

    zero = F.lit(None)
    urls = cut(_known_urls([
        _mentioned(stored, "url", F.col("fetched_at"), F.col("kind")),
        _mentioned(stored, "final_url", F.col("fetched_at"), F.col("kind")),
        _mentioned(metadata, "redirect_destination_url", F.col("fetched_at")),
        _mentioned(links, "target_url", F.col("discovered_at")),
        _mentioned(canonicals, "canonical_url", zero),
        _mentioned(alternates, "href_url", zero, hreflang=True),
        _mentioned(places, "url", zero), _mentioned(sitemap_alternates, "href_url", zero, hreflang=True),
    ], base_domain))

    t: dict[str, DataFrame] = {"urls": urls}
    t["page_metadata"] = metadata.select(
        url_id("url").alias("url_id"), "initial_status_code", "final_status_code", url_id("final_url").alias("final_url_id"),
        F.when(F.col("redirect_destination_url").isNotNull(), url_id("redirect_destination_url")).alias(
            "redirect_destination_url_id"), "fetched_at", "etag", "last_modified")
    t["redirects"] = redirects.select(url_id("source_url").alias("source_url_id"), url_id("target_url").alias("target_url_id"),
                                      "chain_length", "final_status_code")
    t["canonical_urls"] = canonicals.select(url_id("url").alias("url_id"), url_id("canonical_url").alias("canonical_url_id"), "source")
    for name, edges in (("hreflang_html_head", alternates), ("hreflang_sitemap", sitemap_alternates)):
        t[name] = edges.select(url_id("url").alias("url_id"), "language_code", url_id("href_url").alias("href_url_id"))
    t["internal_links"] = links.select(
        url_id("source_url").alias("source_url_id"), url_id("target_url").alias("target_url_id"), url_id("href_url").alias("href_url_id"),
        "anchor_text", "xpath", "fragment", "url_parameters", "discovered_at")
    t["sitemaps"] = listed.select(url_id("sitemap_url").alias("sitemap_id"), "sitemap_url", "total_urls_found",
                                  F.lit(False).alias("is_sitemap_index"), "discovered_at")
    t["url_sitemaps"] = places.select(url_id("url").alias("url_id"), url_id("sitemap_url").alias("sitemap_id"), "position", "discovered_at")

    t["schema_instances"] = S.schema_instances(items)
    seen_at = content.select("url", F.col("fetched_at").alias("discovered_at"))
    t["schema_references"] = join_unique(S.schema_references(items), seen_at, "url", "inner", hot_keys(items, "url")).withColumn(
        "url_id", url_id("url")).drop("url")

    verdicts = robots_verdict(content.select("url", "html_meta_directives", "http_header_directives"), rules, agent).select(
        url_id("url").alias("url_id"), F.col("robots_allows").alias("robots_txt_allows"), "html_meta_directives", "http_header_directives")
    t["indexability"] = E.indexability(verdicts, t["page_metadata"], t["canonical_urls"])

    crawlable = cut(should_crawl(urls.select("url_id", "url", "classification"), rules, agent).where("should_crawl"))
    start = seeds if seeds is not None else spark.createDataFrame(
        [(f"{s}://{base_domain}/",) for s in ("https", "http")], "url string")
    ids = start.select(url_id(normalize_url_for_storage("url")).alias("url_id")).unionByName(t["url_sitemaps"].select("url_id"))
    depths = cut(crawl_depth(ids, t["internal_links"], t["redirects"], crawlable, max_depth=max_depth))

    classes = urls.select(F.col("url_id").alias("target_url_id"), "classification")
    by_class = join_unique(t["internal_links"].select("source_url_id", "target_url_id"), classes, "target_url_id", "inner",
                           hot_keys(links.select(url_id("target_url").alias("target_url_id")), "target_url_id"))
    counts = link_counts(by_class, "source_url_id", "target_url_id").withColumnRenamed("source_url_id", "url_id")
    details = content.drop("links", "items", "status", "kind", "fetched_at").withColumn("url_id", url_id("url")).drop("url")
    t["content"] = E.content_table(details, t["redirects"].where("source_url_id <> target_url_id")).join(
        counts, "url_id", "left").join(depths.select("url_id", F.col("depth").alias("crawl_depth")), "url_id", "left")

    done = t["page_metadata"].select("url_id", "fetched_at", F.lit(True).alias("_done"))
    inlinks = inlink_counts(t["internal_links"], "source_url_id", "target_url_id").withColumnRenamed("target_url_id", "url_id")
    listed_at = entries.groupBy(url_id(normalize_url_for_storage("url")).alias("url_id")).agg(F.max("priority").alias("sitemap_priority"))
    reached = depths.join(done, "url_id", "full_outer").join(urls.select("url_id", "url", "first_seen"), "url_id").join(
        inlinks, "url_id", "left").join(listed_at, "url_id", "left")
    none = F.lit(0).cast("bigint")
    t["frontier"] = reached.select(
        "url_id", F.coalesce("depth", none).alias("depth"), "parent_id",
        F.when(F.col("_done"), "done").otherwise("queued").alias("status"), F.col("first_seen").alias("enqueued_at"),
        F.coalesce("fetched_at", "first_seen").alias("updated_at"),
        priority_score("url", F.coalesce("depth", none), "sitemap_priority", F.coalesce("inlinks_count", none)).alias("priority_score"),
        "sitemap_priority", none.alias("reset_count"))
    return t
