"""Checks on recorded responses: HSTS preload, soft 404, path case, staleness, re-fetch validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.headers import cache_ttl, header, parse_hsts
from webstrata.functions.urls import normalize_url_for_storage, scheme

NO_LETTERS = "case check skipped: start URL path has no alphabetic characters"


def _probe(name: str, field: Column | str) -> Column:
    """The field of the probe called `name`, as an aggregate over the probes of a domain."""
    return F.max(F.when(F.col("probe") == name, field))


def hsts_checks(responses: DataFrame) -> DataFrame:
    """HSTS preload eligibility per domain and check time, from the responses to the probes
    `https` and `http` (base_domain, checked_at, probe, url, status, final_url, headers)."""
    policy = header("headers", "strict-transport-security")
    probes = responses.select("base_domain", "checked_at", "probe", "url", "status", "final_url",
                              policy.alias("policy"))
    wide = probes.groupBy("base_domain", "checked_at").agg(
        _probe("https", F.col("url")).alias("https_url"),
        _probe("https", F.col("status")).alias("https_status"),
        _probe("https", F.col("policy")).alias("hsts_header"),
        _probe("http", F.col("url")).alias("http_url"),
        _probe("http", F.col("status")).alias("http_status"),
        _probe("http", F.col("final_url")).alias("_final"),
    ).withColumn("_h", parse_hsts("hsts_header"))
    secure = F.coalesce(scheme("_final") == "https", F.lit(False))
    return wide.select(
        "base_domain", "checked_at", "https_url", "https_status", "hsts_header",
        F.col("_h.max_age").alias("hsts_max_age"),
        F.col("_h.include_subdomains").alias("hsts_include_subdomains"),
        F.col("_h.preload").alias("hsts_preload"),
        F.col("_h.max_age_ok").alias("hsts_max_age_ok"),
        "http_url", "http_status",
        secure.alias("http_redirects_to_https"),
        F.when(secure, F.col("_final")).alias("http_redirect_target"),
        (F.col("_h.present") & F.col("_h.max_age_ok") & F.col("_h.include_subdomains") & F.col("_h.preload")
         & secure).alias("eligible"),
        F.lit(None).cast("string").alias("notes"),
    )


def site_probe_checks(responses: DataFrame) -> DataFrame:
    """Soft-404 and path-case verdicts per domain and check time, from the probes `random` and
    `case`. `start_url` is the page whose path was re-cased; `canonical_url` is what the answer
    to the case probe declares; `redirects` is the number of hops it took."""
    wide = responses.groupBy("base_domain", "checked_at").agg(
        F.max("start_url").alias("_start"),
        *[_probe("random", F.col(c)).alias(f"random_404_{c}") for c in ("url", "status", "final_url")],
        *[_probe("case", F.col(c)).alias(f"case_{c}") for c in ("url", "status", "final_url", "canonical_url")],
        _probe("case", F.col("redirects")).alias("_hops"),
    )
    expected = normalize_url_for_storage("_start")
    lettered = F.regexp_extract("_start", r"^[^:]+://[^/?#]*([^?#]*)", 1).rlike(r"\p{L}")
    reached = normalize_url_for_storage(F.coalesce("case_final_url", "case_url"))
    declared = F.coalesce(normalize_url_for_storage("case_canonical_url") == expected, F.lit(False))
    return wide.select(
        "base_domain", "checked_at", "random_404_url", "random_404_status", "random_404_final_url",
        F.coalesce(F.col("random_404_status") == 404, F.lit(False)).alias("random_404_ok"),
        *[F.when(lettered, F.col(c)).alias(c) for c in ("case_url", "case_status", "case_final_url")],
        F.when(lettered, F.coalesce(F.col("_hops") > 0, F.lit(False))).alias("case_redirects"),
        F.when(lettered, F.col("case_canonical_url")).alias("case_canonical_url"),
        expected.alias("case_expected_url"),
        F.when(lettered, (reached == expected) | declared).alias("case_ok"),
        F.when(~lettered, NO_LETTERS).alias("notes"),
    )


def stale_resources(fetches: DataFrame, now: int, default_ttl: int = 3600) -> DataFrame:
    """Resources (url, fetched_at, headers) whose cached copy has outlived its lifetime at `now`."""
    aged = fetches.withColumn("ttl", cache_ttl("headers", now, default_ttl))
    return aged.where(F.lit(now) - F.col("fetched_at") > F.col("ttl")).drop("headers")


def conditional_headers(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Validators to send when a URL is fetched again: the latest entity tag and modification date."""
    latest = metadata.groupBy("url_id").agg(F.max(F.struct("fetched_at", "etag", "last_modified")).alias("_m"))
    return urls.join(latest, "url_id", "left").select(
        *urls.columns,
        F.regexp_replace("_m.etag", r'^"+|"+$', "").alias("if_none_match"),
        F.col("_m.last_modified").alias("if_modified_since"))
