"""Comparison of two crawls of the same site: origin and staging, matched by URL path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import path_or_root, to_staging
from webstrata.operators.skew import join_unique

FIELDS = ["title", "h1", "meta_description", "word_count"]


def staging_seeds(urls: DataFrame, frontier: DataFrame, origin: str, staging: str) -> DataFrame:
    """Crawled internal URLs of the origin, rewritten to the staging host."""
    done = frontier.where("status = 'done'").select("url_id")
    return urls.where("classification = 'internal'").join(done, "url_id", "left_semi").select(
        "url", to_staging("url", origin, staging).alias("staging_url"))


def crawl_side(urls: DataFrame, frontier: DataFrame, content: DataFrame) -> DataFrame:
    """What one crawl knows of each crawled URL: title, first h1, description, word count."""
    done = urls.join(frontier.where("status = 'done'").select("url_id"), "url_id", "left_semi")
    details = content.select("url_id", "title", F.get("h1_tags", F.lit(0)).alias("h1"), "meta_description", "word_count")
    return done.select("url_id", "url", "classification").join(details, "url_id", "left").withColumn(
        "word_count", F.coalesce("word_count", F.lit(0)))


def _by_path(side: DataFrame, prefix: str) -> DataFrame:
    """One row per path: that of the smallest url_id."""
    first = F.min(F.struct("url_id", *FIELDS))
    paths = side.groupBy(path_or_root("url").alias("path")).agg(first.alias("_f"))
    return paths.select("path", F.col("_f.url_id").alias(f"{prefix}_url_id"),
                        *[F.col(f"_f.{c}").alias(f"{prefix}_{c}") for c in FIELDS])


def url_moves(origin: DataFrame, redirects: DataFrame, staging: DataFrame) -> DataFrame:
    """Origin paths whose redirect leads to a path that exists on staging. `redirects` has
    source_url and target_url."""
    paths = staging.select(path_or_root("url").alias("to_path")).distinct()
    moved = origin.select("url_id", F.col("url").alias("source_url")).join(
        redirects.select("source_url", "target_url"), "source_url")
    hops = moved.select(path_or_root("source_url").alias("path"), "url_id", path_or_root("target_url").alias("to_path"))
    # Many pages may move to one.
    return join_unique(hops, paths, "to_path", "inner").groupBy("path").agg(
        F.max_by("to_path", F.struct("url_id", "to_path")).alias("moved_to_path"))


def compare_paths(origin: DataFrame, staging: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """All paths of both sides with what each side knows, existence flags and moves.

    Paths are unique on both sides before the full outer join, so no path can be a hot key.
    """
    both = _by_path(origin, "origin").join(_by_path(staging, "staging"), "path", "full_outer")
    flagged = both.withColumns({
        "exists_on_origin": F.col("origin_url_id").isNotNull().cast("int"),
        "exists_on_staging": F.col("staging_url_id").isNotNull().cast("int"),
        "origin_word_count": F.coalesce("origin_word_count", F.lit(0)),
        "staging_word_count": F.coalesce("staging_word_count", F.lit(0))})
    if redirects is None:
        moved = flagged.withColumn("moved_to_path", F.lit(None).cast("string"))
    else:
        moved = flagged.join(url_moves(origin, redirects, staging), "path", "left")
    is_moved = F.col("moved_to_path").isNotNull()
    return moved.withColumns({
        "is_moved_content": is_moved.cast("int"),
        "moved_from_path": F.when(is_moved, F.col("path")),
        "redirect_chain": F.when(is_moved, F.concat("path", F.lit(" -> "), "moved_to_path"))})


def match_label(origin: Column, staging: Column) -> Column:
    return (F.when(origin == staging, "Match")
            .when(origin.isNull() & staging.isNull(), "Both Missing")
            .when(origin.isNull(), "Missing in Origin")
            .when(staging.isNull(), "Missing in Staging")
            .otherwise("Different"))


def view_sitemap_changes(cmp: DataFrame) -> DataFrame:
    on_origin, on_staging = F.col("exists_on_origin") == 1, F.col("exists_on_staging") == 1
    return cmp.select("path", "exists_on_origin", "exists_on_staging",
                      F.when(on_origin & ~on_staging, "Missing in staging")
                      .when(~on_origin & on_staging, "New in staging")
                      .when(on_origin & on_staging, "Present in both").otherwise("Unknown").alias("change_type"))


def view_urls_missing(cmp: DataFrame) -> DataFrame:
    return cmp.where("exists_on_origin = 1 and exists_on_staging = 0").select(
        "path", F.lit("Missing in staging").alias("issue_type"))


def view_urls_new(cmp: DataFrame) -> DataFrame:
    return cmp.where("exists_on_origin = 0 and exists_on_staging = 1").select(
        "path", F.lit("New in staging").alias("issue_type"))


def view_crawl_overview_comparison(cmp: DataFrame) -> DataFrame:
    """Both sides of every field with a label for how they compare."""
    fields = [x for f in FIELDS for x in (
        F.col(f"origin_{f}"), F.col(f"staging_{f}"),
        match_label(F.col(f"origin_{f}"), F.col(f"staging_{f}")).alias(f"{f}_match"))]
    return cmp.select("path", "exists_on_origin", "exists_on_staging", *fields,
                      "is_moved_content", "moved_from_path", "moved_to_path", "redirect_chain")


def view_content_differences(cmp: DataFrame) -> DataFrame:
    """Paths on both sides, and whether any field differs; what both sides lack does not."""
    overview = view_crawl_overview_comparison(cmp.where("exists_on_origin = 1 and exists_on_staging = 1"))
    differs = F.lit(False)
    for f in FIELDS:
        differs = differs | ~F.col(f"{f}_match").isin("Match", "Both Missing")
    kept = [x for f in FIELDS for x in (f"origin_{f}", f"staging_{f}", f"{f}_match")]
    return overview.select("path", *kept, F.when(differs, "Content differences detected").otherwise(
        "No content differences").alias("overall_content_status"))


def view_url_moves(cmp: DataFrame) -> DataFrame:
    return cmp.where("is_moved_content = 1").select(
        "path", "moved_from_path", "moved_to_path", "redirect_chain",
        F.lit("Content moved via redirect").alias("move_type"))


def _side_by_side(cmp: DataFrame, origin: DataFrame, staging: DataFrame, value: str, name: str,
                  missing: str | None = None) -> DataFrame:
    """Each path with the value its page has on either side, and the match label."""
    out = cmp.select("path", "exists_on_origin", "exists_on_staging", "origin_url_id", "staging_url_id")
    for side, values in (("origin", origin), ("staging", staging)):
        named = values.select(F.col("url_id").alias(f"{side}_url_id"), F.col(value).alias(f"{side}_{name}"))
        out = out.join(named, f"{side}_url_id", "left")
        if missing is not None:
            out = out.withColumn(f"{side}_{name}", F.when(
                F.col(f"exists_on_{side}") == 1, F.coalesce(f"{side}_{name}", F.lit(missing))))
    return out.select("path", "exists_on_origin", "exists_on_staging", f"origin_{name}", f"staging_{name}",
                      match_label(F.col(f"origin_{name}"), F.col(f"staging_{name}")).alias(f"{name}_match"))


def view_indexability_comparison(cmp: DataFrame, origin: DataFrame, staging: DataFrame) -> DataFrame:
    """`origin` and `staging` are the indexability tables (url_id, overall_indexable) of both sides."""
    def worded(table: DataFrame) -> DataFrame:
        verdict = F.when(F.col("overall_indexable"), "Indexable").when(~F.col("overall_indexable"), "Not indexable")
        return table.select("url_id", verdict.alias("verdict"))
    return _side_by_side(cmp, worded(origin), worded(staging), "verdict", "indexability")


def view_schema_comparison(cmp: DataFrame, origin: DataFrame, staging: DataFrame) -> DataFrame:
    """`origin` and `staging` list items as (url_id, type); pages without items say so."""
    def listed(items: DataFrame) -> DataFrame:
        # Distinct types of one page, a list the page itself bounds.
        return items.select("url_id", "type").distinct().groupBy("url_id").agg(
            F.array_join(F.array_sort(F.collect_list("type")), ", ").alias("types"))
    return _side_by_side(cmp, listed(origin), listed(staging), "types", "schema", missing="No schema")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(path_or_root("source_url").alias("source_path"),
                        path_or_root("target_url").alias("target_path")).distinct()


def view_internal_links_added(origin_links: DataFrame, staging_links: DataFrame) -> DataFrame:
    """Links (by source and target path) that only staging has; links have source_url and target_url."""
    return _edges(staging_links).join(_edges(origin_links), ["source_path", "target_path"], "left_anti").withColumn(
        "link_change_type", F.lit("Links added in staging"))


def view_internal_links_lost(origin_links: DataFrame, staging_links: DataFrame) -> DataFrame:
    return _edges(origin_links).join(_edges(staging_links), ["source_path", "target_path"], "left_anti").withColumn(
        "link_change_type", F.lit("Links lost in staging"))


def commercial_issues(commercial: DataFrame, staging: DataFrame) -> DataFrame:
    """Commercial pages (commercial_url, expected_staging_url) and whether staging has them."""
    known = staging.select(F.col("url").alias("expected_staging_url")).distinct().withColumn("_known", F.lit(True))
    return commercial.join(known, "expected_staging_url", "left").select(
        "commercial_url", "expected_staging_url",
        F.when(F.col("_known"), "No issues").otherwise("Missing from staging").alias("issue_type"))


def commercial_summary(issues: DataFrame) -> DataFrame:
    found = F.col("issue_type") == "No issues"
    return issues.agg(F.count("*").alias("total_commercial_pages"), F.count_if(found).alias("found_in_staging"),
                      F.count_if(~found).alias("missing_in_staging"))


def comparison_summary(cmp: DataFrame) -> DataFrame:
    on_origin, on_staging = F.col("exists_on_origin"), F.col("exists_on_staging")
    return cmp.agg(
        F.count("*").alias("total_paths"), F.sum(on_origin).alias("origin_paths"),
        F.sum(on_staging).alias("staging_paths"),
        F.count_if((on_origin == 1) & (on_staging == 0)).alias("missing_in_staging"),
        F.count_if((on_origin == 0) & (on_staging == 1)).alias("new_in_staging"))
