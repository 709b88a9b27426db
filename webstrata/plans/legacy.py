"""Older forms of views that compute something different under the same name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators import duplicates
from webstrata.operators.skew import hottest, join_unique
from webstrata.plans.views import Tables, _link_join, _link_rows, _listed, _named, _with_url, overview


OVERVIEW_COLUMNS = [
    "url", "crawl_status", "status_code", "indexable", "indexability_reason", "type", "classification", "title",
    "meta_description", "h1_1", "h1_2", "h1_count", "h2_tags", "h2_count", "word_count", "html_lang",
    "internal_links_count", "external_links_count", "internal_links_unique_count", "external_links_unique_count",
    "crawl_depth", "inlinks_count", "inlinks_unique_count", "robots_txt_allows", "html_meta_allows",
    "http_header_allows", "robots_txt_directives", "html_meta_directives", "http_header_directives",
    "canonical_urls", "canonical_sources", "redirect_destination_url", "self_hreflang"]


def view_crawl_overview_legacy(t: Tables) -> DataFrame:
    """The overview with URLs that carry fragments, every recorded redirect, and the page's own
    language found even if the two URLs differ by a trailing slash."""
    edges = t["hreflang_sitemap"].where("language_code <> 'x-default'").select("url_id", "href_url_id", "language_code")
    named = join_unique(edges, _named(t["urls"], "href_url_id", "_href"), "href_url_id", "inner").join(
        _named(t["urls"], "url_id", "_own"), "url_id")
    own = F.regexp_replace("_own", "/$", "") == F.regexp_replace("_href", "/$", "")
    languages = named.where(own).groupBy("url_id").agg(F.min("language_code").alias("self_hreflang_language"))
    none = {"hreflang_count": F.lit(None).cast("bigint"), "x_default_hreflang_url": F.lit(None).cast("string")}
    full = overview(t, languages.withColumns(none), with_fragments=True, any_redirect=True)
    return full.withColumnRenamed("self_hreflang_language", "self_hreflang").select(*OVERVIEW_COLUMNS)


def _links_legacy(t: Tables, classification: str) -> DataFrame:
    """Links on pages of the frontier to targets of one class, whatever the class of the page."""
    rows = _link_rows(t).select("source_url_id", "target_url_id", "href_url_id", "anchor_text", "xpath",
                                "fragment", "url_parameters", "discovered_at")
    targets = t["urls"].where(F.col("classification") == classification).select(
        F.col("url_id").alias("target_url_id"), F.col("url").alias("target_url"),
        F.col("classification").alias("target_classification"))
    hrefs = t["urls"].select(F.col("url_id").alias("href_url_id"), F.col("url").alias("href"),
                             F.col("classification").alias("href_classification"))
    crawled = t["urls"].join(t["frontier"].select("url_id"), "url_id", "left_semi")
    to_target = _link_join(t, rows, targets, "target_url_id")
    on_page = _link_join(t, to_target, _named(crawled, "source_url_id", "source_url"), "source_url_id")
    return _link_join(t, on_page, hrefs, "href_url_id", "left").select(
        "source_url", "target_url", "target_classification", "anchor_text",
        F.coalesce(F.col("anchor_text").startswith("[IMG:"), F.lit(False)).cast("int").alias("is_image"),
        "xpath", "href", "href_classification", F.col("fragment").alias("url_fragment"), "url_parameters",
        "discovered_at")


def view_links_internal_legacy(t: Tables) -> DataFrame:
    return _links_legacy(t, "internal")


def view_links_network_legacy(t: Tables) -> DataFrame:
    return _links_legacy(t, "network")


def view_links_external_legacy(t: Tables) -> DataFrame:
    return _links_legacy(t, "external")


def view_links_subdomain_legacy(t: Tables) -> DataFrame:
    return _links_legacy(t, "subdomain").drop("href", "href_classification")


def view_sitemap_statistics_legacy(t: Tables) -> DataFrame:
    """Per sitemap: URLs, first and last discovery, and where they stand in the frontier. A sitemap
    without URLs counts as one URL outside the frontier.

    Places are counted per sitemap before they meet the sitemaps, so a sitemap that lists most
    URLs is one row there.
    """
    stated = t["url_sitemaps"].select("sitemap_id", "url_id", "discovered_at").join(
        t["frontier"].select("url_id", "status"), "url_id", "left")
    counts = stated.groupBy("sitemap_id").agg(
        F.count("*").alias("total_urls"), F.count_distinct("url_id").alias("unique_urls"),
        F.min("discovered_at").alias("first_discovered"), F.max("discovered_at").alias("last_discovered"),
        F.count_if(F.col("status") == "done").alias("crawled_urls"),
        F.count_if(F.col("status") == "queued").alias("queued_urls"),
        F.count_if(F.col("status").isNull()).alias("not_in_frontier"))
    whole = {"total_urls": 1, "unique_urls": 0, "crawled_urls": 0, "queued_urls": 0, "not_in_frontier": 1}
    return t["sitemaps"].select("sitemap_id", "sitemap_url").join(counts, "sitemap_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(n).cast("bigint")) for c, n in whole.items()}).drop("sitemap_id")


def view_schema_analysis_legacy(t: Tables) -> DataFrame:
    """The main item of every page with items, and totals over all its items."""
    typed = join_unique(t["schema_references"], t["schema_instances"], "content_hash", "inner")
    main = F.col("is_main_entity")
    # Counted per type and property first, so the lists below have one entry per distinct value.
    totals = typed.groupBy("url_id", "type", "property_name").agg(
        F.count("*").alias("_n"), F.count_if(main).alias("_main")).groupBy("url_id").agg(
        F.sum("_n").alias("total_schema_count"), F.sum("_main").alias("main_entity_count"),
        (F.sum("_n") - F.sum("_main")).alias("related_entity_count"),
        _listed("type").alias("all_schema_types"), _listed("property_name").alias("property_names"))
    mains = typed.where(main).select(
        "url_id", F.col("type").alias("main_entity_type"), F.col("raw_data").alias("main_entity_data"),
        F.col("is_valid").alias("main_entity_valid"), F.col("validation_errors").alias("main_entity_errors"),
        F.col("severity").alias("main_entity_severity"), F.col("position").alias("main_entity_position"),
        F.col("discovered_at").alias("main_entity_discovered_at"))
    return t["urls"].select("url_id", "url").join(totals, "url_id").join(mains, "url_id", "left").drop("url_id")


def view_schema_hierarchy_legacy(t: Tables) -> DataFrame:
    """Every item with its parent's type and data, its number of children and of siblings."""
    typed = join_unique(t["schema_references"], t["schema_instances"], "content_hash", "inner").join(
        t["urls"].select("url_id", "url"), "url_id")
    children = t["schema_references"].where("parent_ordinal is not null").groupBy("url_id", "parent_ordinal").agg(
        F.count("*").alias("_children"))
    own = children.select("url_id", F.col("parent_ordinal").alias("ordinal"), F.col("_children").alias("child_count"))
    parents = typed.where("is_main_entity").select(
        "url_id", F.col("ordinal").alias("parent_ordinal"), F.col("type").alias("parent_entity_type"),
        F.col("raw_data").alias("parent_entity_data"))
    joined = (typed.join(own, ["url_id", "ordinal"], "left").join(children, ["url_id", "parent_ordinal"], "left")
              .join(parents, ["url_id", "parent_ordinal"], "left"))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "url", F.col("type").alias("schema_type"), F.col("raw_data").alias("schema_data"), "is_valid",
        "validation_errors", "severity", "position", "is_main_entity", "property_name", "parent_ordinal",
        "parent_entity_type", "parent_entity_data", F.coalesce("child_count", zero).alias("child_count"),
        F.coalesce(F.col("_children") - 1, zero).alias("sibling_count"))


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Columns of several one-row frames side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def view_crawl_status_legacy(t: Tables) -> DataFrame:
    """One row: sitemaps, URLs by class, crawl progress, canonicals, indexability, sitemap coverage."""
    def count_if(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    places = t["url_sitemaps"].select("url_id", "sitemap_id")
    listed = places.select("url_id").distinct()
    in_scope = t["urls"].where(F.col("classification").isin("internal", "network")).select("url_id").distinct()
    crawled = t["content"].select("url_id").distinct().withColumn("_crawled", F.lit(True))
    covered = in_scope.join(listed.withColumn("_listed", F.lit(True)), "url_id", "left")
    declared = t["content"].select("url_id").join(t["canonical_urls"].select("url_id", "canonical_url_id"), "url_id", "left")
    has = F.col("canonical_url_id").isNotNull()
    frames = [
        places.join(t["sitemaps"].select("sitemap_id"), "sitemap_id", "left_semi").agg(
            F.count_distinct("sitemap_id").alias("sitemaps_scraped"), F.count("*").alias("urls_in_sitemaps")),
        t["urls"].agg(*[count_if(F.col("classification") == c, f"{c}_urls")
                        for c in ("internal", "network", "external", "social")]),
        t["content"].agg(F.count("*").alias("total_crawled"), F.count("*").alias("status_200"),
                         F.lit(0).cast("bigint").alias("non_200")),
        declared.agg(F.count("*").alias("_declared"), count_if(has, "has_canonical"), count_if(~has, "no_canonical")),
        t["indexability"].agg(F.count("*").alias("_checked"), count_if(F.col("overall_indexable"), "indexable"),
                              count_if(~F.col("overall_indexable"), "non_indexable")),
        covered.agg(F.count("*").alias("_in_scope"), F.count("_listed").alias("_covered")),
        listed.join(crawled, "url_id", "left").agg(F.count("*").alias("_listed"), F.count("_crawled").alias("_reached")),
    ]
    row = _one_row(frames)

    def percent(part: str, whole: str) -> Column:
        return F.round(F.col(part) * 100.0 / F.nullif(F.col(whole), F.lit(0)), 2).cast("double")

    return row.select(
        "sitemaps_scraped", "urls_in_sitemaps", "internal_urls", "network_urls", "external_urls", "social_urls",
        "total_crawled", "status_200", "non_200", "has_canonical", "no_canonical", "indexable", "non_indexable",
        (F.col("_in_scope") - F.col("_covered")).alias("internal_urls_not_in_sitemap"),
        (F.col("_listed") - F.col("_reached")).alias("sitemap_urls_not_crawled"),
        percent("status_200", "total_crawled").alias("success_rate_percent"),
        percent("has_canonical", "_declared").alias("canonical_coverage_percent"),
        percent("indexable", "_checked").alias("indexability_rate_percent"),
        percent("_covered", "_in_scope").alias("sitemap_coverage_percent"))


def view_utm_links_legacy(t: Tables) -> DataFrame:
    """Tagged links on pages of the frontier, with the href's URL."""
    rows = _link_rows(t).where(F.col("url_parameters").like("%utm_%")).select(
        "source_url_id", "href_url_id", "anchor_text", "url_parameters", "discovered_at")
    crawled = t["urls"].join(t["frontier"].select("url_id"), "url_id", "left_semi")
    named = _link_join(t, rows, _named(crawled, "source_url_id", "source_url"), "source_url_id")
    return _link_join(t, named, _named(t["urls"], "href_url_id", "target_url_original"), "href_url_id", "left").select(
        "source_url", "target_url_original", "anchor_text", "url_parameters", "discovered_at")


def view_hubs_legacy(t: Tables) -> DataFrame:
    """Pages with more than one known child: number of child links and classes of children.

    The children themselves are rows of view_hub_children_legacy, since a hub has no upper bound.
    """
    per_child = t["internal_links"].groupBy("source_url_id", "target_url_id").agg(F.count("*").alias("_n"))
    children = t["urls"].select(F.col("url_id").alias("target_url_id"), F.col("classification").alias("_class"))
    known = _link_join(t, per_child, children, "target_url_id")
    per_class = known.groupBy("source_url_id", "_class").agg(F.sum("_n").alias("_n"))
    hubs = per_class.groupBy("source_url_id").agg(
        F.sum("_n").alias("child_count"), _listed("_class").alias("child_classifications")).where("child_count > 1")
    pages = t["urls"].select(F.col("url_id").alias("source_url_id"), F.col("url").alias("hub_url"),
                             F.col("classification").alias("hub_classification"))
    return pages.join(hubs, "source_url_id").select(
        "hub_url", "hub_classification", "child_count", "child_classifications").orderBy(
        F.desc("child_count"), "hub_url")


def view_hub_children_legacy(t: Tables) -> DataFrame:
    """Distinct children of every hub, one row each."""
    pairs = t["internal_links"].groupBy("source_url_id", "target_url_id").agg(F.count("*").alias("_n"))
    children = _named(t["urls"], "target_url_id", "child_url")
    known = _link_join(t, pairs, children, "target_url_id")
    counts = known.groupBy("source_url_id").agg(F.sum("_n").alias("child_count")).where("child_count > 1")
    hubs = _named(t["urls"], "source_url_id", "hub_url").join(counts, "source_url_id")
    hot = hottest(counts, "source_url_id", "child_count")
    return join_unique(known.drop("_n"), hubs.drop("child_count"), "source_url_id", "inner", hot).select(
        "hub_url", "child_url")


def view_exact_duplicates_legacy(t: Tables) -> DataFrame:
    return duplicates.exact_duplicate_pairs(_with_url(t["content"], t["urls"]))


def view_near_duplicates_legacy(t: Tables) -> DataFrame:
    return duplicates.equal_simhash_pairs_legacy(_with_url(t["content"], t["urls"]))


def view_content_hash_stats_legacy(t: Tables) -> DataFrame:
    return duplicates.content_hash_stats(t["content"], "content_length")


LEGACY_VIEWS = {f.__name__: f for f in (
    view_crawl_overview_legacy, view_links_internal_legacy, view_links_network_legacy, view_links_external_legacy,
    view_links_subdomain_legacy, view_sitemap_statistics_legacy, view_schema_analysis_legacy,
    view_schema_hierarchy_legacy, view_crawl_status_legacy, view_utm_links_legacy, view_hubs_legacy,
    view_hub_children_legacy, view_exact_duplicates_legacy, view_near_duplicates_legacy,
    view_content_hash_stats_legacy)}
