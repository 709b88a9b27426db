"""Data checks: value domains, references, uniqueness, duplicate URLs of a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the enumerated columns of the tables may hold.
DOMAINS = {
    ("urls", "kind"): ["html", "sitemap", "sitemap_index", "image", "asset", "other"],
    ("urls", "classification"): ["internal", "subdomain", "network", "external", "social"],
    ("frontier", "status"): ["queued", "pending", "done"],
    ("robots_directives", "source"): ["robots_txt", "html_meta", "http_header"],
    ("canonical_urls", "source"): ["html_head", "http_header"],
    ("schema_instances", "format"): ["json-ld", "microdata", "rdfa"],
    ("schema_instances", "severity"): ["info", "warning", "error", "critical"],
}

# Which columns refer to which table's key.
REFERENCES = [
    ("content", "url_id", "urls", "url_id"),
    ("page_metadata", "url_id", "urls", "url_id"),
    ("frontier", "url_id", "urls", "url_id"),
    ("internal_links", "source_url_id", "urls", "url_id"),
    ("internal_links", "target_url_id", "urls", "url_id"),
    ("canonical_urls", "url_id", "urls", "url_id"),
    ("canonical_urls", "canonical_url_id", "urls", "url_id"),
    ("redirects", "source_url_id", "urls", "url_id"),
    ("redirects", "target_url_id", "urls", "url_id"),
    ("hreflang_sitemap", "href_url_id", "urls", "url_id"),
    ("url_sitemaps", "url_id", "urls", "url_id"),
    ("url_sitemaps", "sitemap_id", "sitemaps", "sitemap_id"),
]

# Which columns identify a row.
KEYS = [
    ("urls", ["url"]), ("urls", ["url_id"]), ("content", ["url_id"]), ("page_metadata", ["url_id"]),
    ("frontier", ["url_id"]), ("url_sitemaps", ["url_id", "sitemap_id"]), ("redirects", ["source_url_id"]),
    ("sitemaps", ["sitemap_url"]),
]


def check_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside their domain: (table_name, column_name, value, n). One pass per table."""
    frames = []
    for name in sorted({t for t, _ in DOMAINS if t in tables}):
        columns = {c: allowed for (t, c), allowed in DOMAINS.items() if t == name and c in tables[name].columns}
        bad = [F.when(~F.col(c).isin(allowed), F.named_struct(F.lit("column_name"), F.lit(c), F.lit("value"), F.col(c)))
               for c, allowed in columns.items()]
        frames.append(tables[name].select(F.lit(name).alias("table_name"), F.explode(F.array_compact(F.array(*bad))).alias("_b")))
    found = reduce(DataFrame.unionByName, frames)
    return found.groupBy("table_name", "_b.column_name", "_b.value").agg(F.count("*").alias("n"))


def check_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Broken references and repeated keys: (check_name, table_name, column_name, violations)."""
    frames = []
    for name, column, target, key in REFERENCES:
        if name in tables and target in tables and column in tables[name].columns:
            # Count per value first: a dangling id that fills the table is one row in the join.
            used = tables[name].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(
                F.count("*").alias("_n"))
            known = tables[target].select(F.col(key).alias("_k"))
            frames.append(used.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"))
                          .select(F.lit("reference").alias("check_name"), F.lit(name).alias("table_name"),
                                  F.lit(column).alias("column_name"), "violations"))
    for name, columns in KEYS:
        if name in tables:
            repeated = tables[name].groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
            frames.append(repeated.agg(F.count("*").alias("violations")).select(
                F.lit("unique").alias("check_name"), F.lit(name).alias("table_name"),
                F.lit(",".join(columns)).alias("column_name"), "violations"))
    return reduce(DataFrame.unionByName, frames)


def batch_duplicates(batch: DataFrame, column: str = "url") -> DataFrame:
    """Values that occur more than once in a batch."""
    return batch.groupBy(column).agg(F.count("*").alias("occurrences")).where("occurrences > 1")
