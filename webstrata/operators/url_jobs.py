"""Jobs over a URL table: canonical forms, classes, scope and the decision to crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.urls import (classify_kind, classify_url, host, in_scope, normalize_url_hardened, on_domains, path,
                                      site_key, under_prefix)
from webstrata.operators.robots import robots_verdict


def canonicalize_urls(urls: DataFrame, normalized: Column | None = None) -> DataFrame:
    """Collapse spelling variants: one row per canonical URL with the number of variants and rows
    and the first and last time any of them was seen. `urls` has url and seen_at.

    Variants are counted first, so a URL seen very often reaches the second step as few rows.
    """
    canonical = normalize_url_hardened("url") if normalized is None else normalized
    spelled = urls.select(canonical.alias("canonical_url"), "url", "seen_at")
    variants = spelled.groupBy("canonical_url", "url").agg(
        F.count("*").alias("_n"), F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"))
    return variants.groupBy("canonical_url").agg(
        F.count("*").alias("variants"), F.sum("_n").alias("occurrences"),
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"))


def classify_urls(urls: DataFrame, base_domain: str) -> DataFrame:
    """URLs (url, optionally content_type and from_hreflang) with their kind, class and site."""
    content_type = F.col("content_type") if "content_type" in urls.columns else F.lit(None).cast("string")
    linked = F.col("from_hreflang") if "from_hreflang" in urls.columns else False
    return urls.withColumns({
        "kind": classify_kind(content_type, "url"),
        "classification": classify_url("url", base_domain, linked),
        "site": site_key("url")})


def should_crawl(urls: DataFrame, rules: DataFrame, agent: str, allow_external: bool = False,
                 excludes: list[str] | None = None, restriction: str = "", domains: list[str] | None = None,
                 url_list: DataFrame | None = None) -> DataFrame:
    """`should_crawl` for every URL (url, classification). With a `url_list`, only its URLs are crawled.

    Rules in order: excluded paths, allowed domains, path restriction of internal URLs, robots
    for internal and network URLs; social and subdomain URLs never, external ones if allowed.
    """
    if url_list is not None:
        listed = url_list.select("url").distinct().withColumn("_listed", F.lit(True))
        return urls.join(listed, "url", "left").select(
            *urls.columns, F.coalesce("_listed", F.lit(False)).alias("should_crawl"))
    verdicts = robots_verdict(urls, rules, agent)
    internal, external = F.col("classification") == "internal", F.lit(allow_external)
    decision = F.when(F.lit(False), F.lit(False))
    if excludes:
        decision = decision.when(under_prefix("url", excludes), F.lit(False))
    if domains:
        decision = decision.when(~on_domains("url", domains), external)
    if restriction:
        decision = decision.when(internal & ~path("url").contains(restriction), external)
    decision = (decision.when(F.col("classification").isin("internal", "network"), F.col("robots_allows"))
                .when(F.col("classification") == "external", external).otherwise(F.lit(False)))
    return verdicts.select(*urls.columns, decision.alias("should_crawl"))


def scope_urls(urls: DataFrame, base_host: str, excludes: list[str] | None = None, restriction: str = "",
               domains: list[str] | None = None) -> DataFrame:
    """Every URL with its scope verdicts."""
    return urls.select(
        *urls.columns, (host("url") == base_host).alias("same_host"),
        in_scope("url", excludes, restriction, domains).alias("in_scope"))
