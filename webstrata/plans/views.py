"""The analysis views: functions from a dict of tables to a frame.

Per-page lookups that a row store would do as correlated subqueries are grouped once per key and
joined. Links are grouped by ids before any text is attached, and meet their target through a
join that spreads popular targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.expr import blank_to_null, strip
from webstrata.operators import duplicates
from webstrata.operators.links import inlink_counts
from webstrata.operators.skew import hot_keys, join_unique
from webstrata.operators.tables import REDIRECT_STATUSES

Tables = dict[str, DataFrame]

CONTENT = ["url_id", "title", "meta_description", "h1_tags", "h2_tags", "word_count", "html_lang", "internal_links_count",
           "external_links_count", "internal_links_unique_count", "external_links_unique_count", "crawl_depth",
           "content_hash_sha256", "content_hash_simhash", "content_length"]

LINK_IDS = ["source_url_id", "target_url_id", "anchor_text", "xpath", "fragment", "url_parameters"]


def _named(urls: DataFrame, key: str, name: str) -> DataFrame:
    return urls.select(F.col("url_id").alias(key), F.col("url").alias(name))


def _listed(column: Column | str) -> Column:
    """Distinct values of a group as one sorted, comma-separated string."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(column)), ","), F.lit(""))


# ---- pages --------------------------------------------------------------------------------

def _canonicals(t: Tables) -> DataFrame:
    """Per page: its declared canonicals, which a page head bounds to a handful."""
    edges = t["canonical_urls"].select("url_id", "canonical_url_id", "source")
    # Most pages may name one canonical.
    named = join_unique(edges, _named(t["urls"], "canonical_url_id", "canonical"), "canonical_url_id", "left")
    return named.groupBy("url_id").agg(
        _listed("canonical").alias("canonical_urls"), _listed("source").alias("canonical_sources"),
        F.bool_or(F.col("canonical_url_id") != F.col("url_id")).alias("_foreign_canonical"))


def _alternates(t: Tables, source: str) -> DataFrame:
    """Per page: its own language, number of alternates, default alternate."""
    edges = t["hreflang_html_head" if source == "html" else "hreflang_sitemap"]
    counts = edges.groupBy("url_id").agg(
        F.count("*").alias("hreflang_count"),
        F.min(F.when((F.col("href_url_id") == F.col("url_id")) & (F.col("language_code") != "x-default"),
                     F.col("language_code"))).alias("self_hreflang_language"))
    # The default alternate is usually the home page.
    chosen = edges.where("language_code = 'x-default'").select("url_id", "href_url_id")
    defaults = join_unique(chosen, _named(t["urls"], "href_url_id", "_default"), "href_url_id", "inner").groupBy("url_id").agg(
        F.min("_default").alias("x_default_hreflang_url"))
    return counts.join(defaults, "url_id", "left")


def _schema_summary(t: Tables) -> DataFrame:
    types = t["schema_instances"].select("content_hash", F.col("type").alias("_type"))
    refs = t["schema_references"].select("url_id", "content_hash", "is_main_entity")
    # A boilerplate item can stand on most pages, so its hash may be a hot key.
    typed = join_unique(refs, types, "content_hash", "left")
    main = F.col("is_main_entity")
    return typed.groupBy("url_id").agg(
        _listed(F.when(main, F.col("_type"))).alias("main_schema_types"),
        F.count_if(main).alias("main_schema_count"), F.count("*").alias("total_schema_count"))


def overview(t: Tables, alternates: DataFrame, with_fragments: bool = False, any_redirect: bool = False) -> DataFrame:
    """Internal and network pages joined with everything known about them. All satellites meet on
    url_id, so the URL table is shuffled once."""
    urls = t["urls"].where(F.col("classification").isin("internal", "network"))
    if not with_fragments:
        urls = urls.where(~F.col("url").like("%#%"))
    redirected = F.lit(True) if any_redirect else F.col("initial_status_code").isin(REDIRECT_STATUSES)
    frontier = t["frontier"].select("url_id", F.col("status").alias("_status"), "enqueued_at", "updated_at")
    metadata = t["page_metadata"].select(
        "url_id", F.col("initial_status_code").alias("status_code"), "fetched_at")
    # Few pages redirect, and those mostly to a few others.
    moved = t["page_metadata"].where(redirected & F.col("redirect_destination_url_id").isNotNull()).select(
        "url_id", F.col("redirect_destination_url_id").alias("_destination"))
    destinations = join_unique(moved, _named(t["urls"], "_destination", "redirect_destination_url"), "_destination", "inner").drop("_destination")
    inlinks = inlink_counts(t["internal_links"], "source_url_id", "target_url_id").withColumnRenamed(
        "target_url_id", "url_id")
    joined = urls.select("url_id", "url", "kind", "classification", "first_seen", "last_seen")
    for satellite in (frontier, t["content"].select(*CONTENT), metadata, t["indexability"], _canonicals(t),
                      alternates, _schema_summary(t), inlinks, destinations):
        joined = joined.join(satellite, "url_id", "left")

    def headings(column: str) -> Column:
        return F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), strip), lambda h: h != "")

    zero = F.lit(0).cast("bigint")
    reason = (
        F.when(~F.col("robots_txt_allows"), "blocked by robots.txt")
        .when(~F.col("html_meta_allows"), "blocked by meta robots")
        .when(~F.col("http_header_allows"), "blocked by HTTP headers")
        .when(F.col("status_code") != 200, "not 200 status")
        .when(F.col("_foreign_canonical"), "not self canonical")
        .otherwise("unknown reason"))
    return joined.select(
        "url", F.coalesce("_status", F.lit("unknown")).alias("crawl_status"), "status_code",
        F.col("overall_indexable").alias("indexable"),
        F.when(~F.col("overall_indexable"), reason).alias("indexability_reason"),
        F.col("kind").alias("type"), "classification", "title", "meta_description",
        F.get(headings("h1_tags"), F.lit(0)).alias("h1_1"), F.get(headings("h1_tags"), F.lit(1)).alias("h1_2"),
        F.size(headings("h1_tags")).cast("bigint").alias("h1_count"),
        F.nullif(F.array_join(headings("h2_tags"), ", "), F.lit("")).alias("h2_tags"),
        F.size(headings("h2_tags")).cast("bigint").alias("h2_count"),
        "word_count", "html_lang", "internal_links_count", "external_links_count",
        "internal_links_unique_count", "external_links_unique_count", "crawl_depth",
        F.coalesce("inlinks_count", zero).alias("inlinks_count"),
        F.coalesce("inlinks_unique_count", zero).alias("inlinks_unique_count"),
        "robots_txt_allows", "html_meta_allows", "http_header_allows",
        *[F.coalesce(c, F.lit("")).alias(c) for c in (
            "robots_txt_directives", "html_meta_directives", "http_header_directives")],
        "canonical_urls", "canonical_sources", "redirect_destination_url",
        "self_hreflang_language", F.coalesce("hreflang_count", zero).alias("hreflang_count"),
        "x_default_hreflang_url", "main_schema_types",
        F.coalesce("main_schema_count", zero).alias("main_schema_count"),
        F.coalesce("total_schema_count", zero).alias("total_schema_count"),
        "content_hash_sha256", "content_hash_simhash", "content_length",
        "first_seen", "last_seen", "fetched_at", "enqueued_at", "updated_at")


def view_crawl_overview(t: Tables, hreflang_source: str = "sitemap") -> DataFrame:
    """Everything known about each internal or network page; alternates from sitemaps or from page
    heads (`html`)."""
    return overview(t, _alternates(t, hreflang_source))


def view_hubs(t: Tables) -> DataFrame:
    """Pages with more than 50 outgoing links, largest first."""
    total = F.col("internal_links_count") + F.col("external_links_count")
    hubs = t["content"].withColumn("total_links", total).where("total_links > 50")
    return t["urls"].select("url_id", "url").join(hubs, "url_id").select(
        "url", "title", "internal_links_count", "external_links_count", "total_links", "word_count",
        "crawl_depth").orderBy(F.desc("total_links"), "url")


def _with_url(content: DataFrame, urls: DataFrame) -> DataFrame:
    return content.join(urls.select("url_id", "url"), "url_id")


def view_exact_duplicates(t: Tables) -> DataFrame:
    """Groups of identical pages: hash, size, first URL. The URLs of a group are rows of
    view_exact_duplicate_members, since a group has no upper bound."""
    return duplicates.exact_duplicate_groups(_with_url(t["content"], t["urls"]))


def view_exact_duplicate_members(t: Tables) -> DataFrame:
    return duplicates.exact_duplicate_members(_with_url(t["content"], t["urls"]))


def view_near_duplicates(t: Tables) -> DataFrame:
    """Pages that share a SimHash, each next to the first page of its group."""
    return duplicates.equal_simhash_pairs(_with_url(t["content"], t["urls"]))


def view_content_hash_stats(t: Tables) -> DataFrame:
    return duplicates.content_hash_stats(t["content"])


# ---- links --------------------------------------------------------------------------------

def _flags() -> list[Column]:
    return [
        F.col("anchor_text").isNull().cast("int").alias("is_image"),
        F.col("fragment").isNotNull().cast("int").alias("has_fragment"),
        F.col("url_parameters").isNotNull().cast("int").alias("has_parameters"),
    ]


def _link_rows(t: Tables) -> DataFrame:
    """Links with blank texts as null."""
    return t["internal_links"].withColumns(
        {c: blank_to_null(c) for c in ("anchor_text", "fragment", "url_parameters")})


def _link_join(t: Tables, links: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows made of the link table with a frame unique by one of its ids; popular ids are
    looked up in the stored table."""
    return join_unique(links, dim, key, how, hot_keys(t["internal_links"], key))


def _from_internal(t: Tables, links: DataFrame) -> DataFrame:
    """Links that stand on internal pages, with the page's URL."""
    sources = t["urls"].where("classification = 'internal'").select(
        F.col("url_id").alias("source_url_id"), F.col("url").alias("source_url"))
    return _link_join(t, links, sources, "source_url_id")


def _links_to(t: Tables, classification: str) -> DataFrame:
    """Links from internal pages to pages of a class, every occurrence."""
    targets = t["urls"].where(F.col("classification") == classification).select(
        F.col("url_id").alias("target_url_id"), F.col("url").alias("target_url"))
    rows = _link_join(t, _link_rows(t).select(*LINK_IDS, "discovered_at"), targets, "target_url_id")
    return _from_internal(t, rows).select(
        "source_url", "target_url", "anchor_text", "xpath", "fragment", "url_parameters", "discovered_at", *_flags())


def view_links_network(t: Tables) -> DataFrame:
    return _links_to(t, "network")


def view_links_subdomain(t: Tables) -> DataFrame:
    return _links_to(t, "subdomain")


def _targets(t: Tables, wanted: Column) -> DataFrame:
    """Per possible link target: its answer, whether it resolves, whether it is its own canonical.

    All inputs meet on url_id, so they share one shuffle.
    """
    own = t["page_metadata"].select("url_id", "initial_status_code", "final_url_id", F.lit(True).alias("_fetched"))
    arriving = t["page_metadata"].where("final_url_id is not null").groupBy(F.col("final_url_id").alias("url_id")).agg(
        F.min("initial_status_code").alias("_redirect_status"), F.lit(True).alias("_arrives"))
    canonical = t["canonical_urls"].where("canonical_url_id = url_id").select("url_id").distinct().withColumn(
        "_self", F.lit(True))
    known = (t["urls"].where(wanted).select("url_id", "url").join(own, "url_id", "left")
             .join(arriving, "url_id", "left").join(canonical, "url_id", "left"))
    stays = F.col("_fetched") & (F.col("final_url_id").isNull() | (F.col("final_url_id") == F.col("url_id")))
    return known.select(
        F.col("url_id").alias("target_url_id"), F.col("url").alias("target_url"),
        F.coalesce("initial_status_code", "_redirect_status").alias("target_status_code"),
        F.coalesce("_self", F.lit(False)).cast("int").alias("target_is_self_canonical"),
        F.coalesce(stays | F.col("_arrives"), F.col("_arrives"), F.lit(False)).cast("int").alias("target_resolves"),
        F.coalesce(F.col("_fetched") | F.col("_arrives"), F.col("_fetched"), F.col("_arrives"), F.lit(False)).alias("_crawled"))


def _judged_links(t: Tables, targets: DataFrame) -> DataFrame:
    """Distinct links from internal pages to `targets`, at their earliest discovery."""
    distinct = _link_rows(t).groupBy(*LINK_IDS).agg(F.min("discovered_at").alias("discovered_at"))
    return _from_internal(t, _link_join(t, distinct, targets, "target_url_id")).select(
        "source_url", "target_url", "anchor_text", "xpath", "fragment", "url_parameters", "discovered_at",
        *_flags(), "target_status_code", "target_is_self_canonical", "target_resolves")


def view_links_internal(t: Tables) -> DataFrame:
    """Links between internal pages whose target was crawled."""
    internal = F.col("classification").isNull() | (F.col("classification") == "internal")
    return _judged_links(t, _targets(t, internal).where("_crawled"))


def view_links_external(t: Tables) -> DataFrame:
    """Links from internal to external pages, crawled or not."""
    return _judged_links(t, _targets(t, F.col("classification") == "external"))


def view_links_invalid_content(t: Tables) -> DataFrame:
    """Internal and external links whose target redirects, is not its own canonical or is not 200.

    The invalid targets are found first, so only links to them are joined.
    """
    wanted = F.col("classification").isNull() | F.col("classification").isin("internal", "external")
    broken = ((F.col("target_resolves") == 0) | (F.col("target_is_self_canonical") == 0)
              | (F.col("target_status_code") != 200))
    targets = _targets(t, wanted).where(F.col("target_status_code").isNotNull() & broken)
    return _judged_links(t, targets).withColumn(
        "invalid_reason",
        F.when(F.col("target_resolves") == 0, "redirects")
        .when(F.col("target_is_self_canonical") == 0, "not self-canonical")
        .when(F.col("target_status_code") != 200, "non-200 status").otherwise("unknown issue"))


def view_utm_links(t: Tables) -> DataFrame:
    """Links whose parameters mention `utm` followed by any character."""
    rows = _link_rows(t).where(F.col("url_parameters").like("%utm_%")).select(
        "source_url_id", "target_url_id", "anchor_text", "url_parameters", "discovered_at")
    named = _link_join(t, rows, _named(t["urls"], "source_url_id", "source_url"), "source_url_id")
    return _link_join(t, named, _named(t["urls"], "target_url_id", "target_url"), "target_url_id", "left").select(
        "source_url", "target_url", "anchor_text", "url_parameters", "discovered_at")


# ---- sitemaps, frontier -------------------------------------------------------------------

def view_sitemap_statistics(t: Tables) -> DataFrame:
    """Per sitemap: URLs found, URLs processed, and the classes of URLs in it."""
    classes = t["urls"].select("url_id", "classification")
    places = t["url_sitemaps"].select("sitemap_id", "url_id").join(classes, "url_id", "left")
    # Count per class first: a sitemap then has at most one row per class.
    per_class = places.groupBy("sitemap_id", "classification").agg(F.count("url_id").alias("_n"))
    counts = per_class.groupBy("sitemap_id").agg(
        F.sum("_n").alias("urls_processed"), F.count("classification").alias("classification_count"),
        _listed("classification").alias("classifications"))
    zero = F.lit(0).cast("bigint")
    kept = [c for c in t["sitemaps"].columns if c != "sitemap_id"]
    return t["sitemaps"].join(counts, "sitemap_id", "left").select(
        *kept, F.coalesce("urls_processed", zero).alias("urls_processed"),
        F.coalesce("classification_count", zero).alias("classification_count"), "classifications")


def view_crawl_status(t: Tables) -> DataFrame:
    return t["frontier"].groupBy("status").agg(
        F.count("*").alias("count"), F.avg("priority_score").alias("avg_priority"),
        F.min("enqueued_at").alias("oldest_enqueued"), F.max("updated_at").alias("last_updated"))


# ---- structured data ----------------------------------------------------------------------

def _typed_references(t: Tables) -> DataFrame:
    instances = t["schema_instances"].withColumnRenamed("type", "schema_type")
    named = t["schema_references"].join(t["urls"].select("url_id", "url"), "url_id")
    return join_unique(named, instances, "content_hash", "inner", hot_keys(t["schema_references"], "content_hash"))


def view_schema_analysis(t: Tables) -> DataFrame:
    """One row per page and item."""
    return _typed_references(t).select(
        "url", "schema_type", "format", "is_valid", "severity", "validation_errors", "position",
        "property_name", "is_main_entity", "parent_ordinal", "discovered_at")


def view_schema_hierarchy(t: Tables) -> DataFrame:
    """Every item with the position and type of the item it hangs below."""
    typed = _typed_references(t).select("url_id", "url", "ordinal", "schema_type", "position", "property_name",
                                        "is_main_entity", "parent_ordinal", "discovered_at")
    parents = typed.where("is_main_entity").select(
        "url_id", F.col("ordinal").alias("parent_ordinal"), F.col("position").alias("parent_position"),
        F.col("schema_type").alias("parent_schema_type"))
    return typed.join(parents, ["url_id", "parent_ordinal"], "left").select(
        "url", "schema_type", "position", "property_name", "is_main_entity", "parent_position",
        "parent_schema_type", "discovered_at")


# ---- site checks --------------------------------------------------------------------------

def view_hsts_preload_checks(t: Tables) -> DataFrame:
    return t["hsts_preload_checks"].select(
        "base_domain", "checked_at", "https_url", "https_status", "hsts_header", "hsts_max_age",
        "hsts_include_subdomains", "hsts_preload", "hsts_max_age_ok", "http_url", "http_status",
        "http_redirects_to_https", "http_redirect_target", "eligible", "notes")


def view_spa_checks(t: Tables) -> DataFrame:
    return t["spa_checks"].select(
        "base_domain", "checked_at", "random_404_url", "random_404_status", "random_404_final_url", "random_404_ok",
        "case_url", "case_status", "case_final_url", "case_redirects", "case_canonical_url", "case_expected_url",
        "case_ok", "notes")


def _latest(checks: DataFrame, columns: list[str]) -> DataFrame:
    """The latest check of every domain."""
    last = F.max(F.struct("checked_at", *columns))
    return checks.groupBy("base_domain").agg(last.alias("_c")).select("base_domain", "_c.*")


def view_crawl_general_checks(t: Tables) -> DataFrame:
    """The latest HSTS and probe check of every domain side by side."""
    hsts_columns = ["eligible", "https_status", "http_status", "hsts_header", "hsts_max_age", "hsts_include_subdomains",
                    "hsts_preload", "hsts_max_age_ok", "http_redirects_to_https", "http_redirect_target", "notes"]
    spa_columns = ["random_404_status", "random_404_ok", "random_404_final_url", "case_status", "case_ok",
                   "case_final_url", "case_canonical_url", "notes"]
    hsts_names = {"checked_at": "hsts_checked_at", "eligible": "hsts_preload_eligible", "notes": "hsts_notes",
                  "https_status": "hsts_https_status", "http_status": "hsts_http_status"}
    hsts = _latest(t["hsts_preload_checks"], hsts_columns).withColumnsRenamed(hsts_names)
    spa = _latest(t["spa_checks"], spa_columns).withColumnsRenamed(
        {"checked_at": "spa_checked_at", "notes": "spa_notes"})
    return hsts.join(spa, "base_domain", "full_outer")


VIEWS = {f.__name__: f for f in (
    view_crawl_overview, view_links_internal, view_links_network, view_links_external,
    view_links_invalid_content, view_links_subdomain, view_sitemap_statistics, view_schema_analysis,
    view_schema_hierarchy, view_crawl_status, view_utm_links, view_hubs, view_exact_duplicates,
    view_exact_duplicate_members, view_near_duplicates, view_content_hash_stats,
    view_hsts_preload_checks, view_spa_checks, view_crawl_general_checks)}
