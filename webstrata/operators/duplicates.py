"""Exact duplicates and equal SimHashes.

Copies are reported as groups and their members, never as all pairs of a group: a group of
n copies is n rows. Hashes that are only near each other: `near_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators.skew import hottest, join_unique


def _present(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def exact_duplicate_groups(content: DataFrame) -> DataFrame:
    """Hashes found on more than one page, with the number of pages and the first URL; largest first."""
    return (content.where(_present("content_hash_sha256")).groupBy("content_hash_sha256")
            .agg(F.count("*").alias("duplicate_count"), F.min("url").alias("first_url"))
            .where("duplicate_count > 1").orderBy(F.desc("duplicate_count"), "content_hash_sha256"))


def _members(content: DataFrame, hash_column: str, per_member: list[str], summary: list[Column]) -> DataFrame:
    """Pages in groups of equal hash, each with the size of its group and the group summary."""
    rows = content.where(_present(hash_column)).select(hash_column, *per_member)
    groups = rows.groupBy(hash_column).agg(F.count("*").alias("duplicate_count"), *summary).where(
        "duplicate_count > 1")
    hot = hottest(groups, hash_column, "duplicate_count")
    return join_unique(rows, groups, hash_column, "inner", hot)


def exact_duplicate_members(content: DataFrame) -> DataFrame:
    """The URLs of every exact-duplicate group, one row each."""
    return _members(content, "content_hash_sha256", ["url"], [])


def exact_duplicate_pairs(content: DataFrame) -> DataFrame:
    """Every copy next to the first page of its group: n - 1 rows for n copies."""
    first = [F.min(F.struct("url_id", "url")).alias("_first")]
    members = _members(content, "content_hash_sha256", ["url_id", "url", "content_length"], first)
    return members.where(F.col("url_id") > F.col("_first.url_id")).select(
        F.col("_first.url_id").alias("url1_id"), F.col("url_id").alias("url2_id"),
        F.col("_first.url").alias("url1"), F.col("url").alias("url2"),
        "content_hash_sha256", "content_length", F.lit("Exact duplicate").alias("duplicate_type"))


def equal_simhash_pairs(content: DataFrame) -> DataFrame:
    """Pages with the SimHash of an earlier page, each next to the first page of the group."""
    first = [F.min(F.struct("url_id", "url", "word_count")).alias("_first")]
    members = _members(content, "content_hash_simhash", ["url_id", "url", "word_count"], first)
    return members.where(F.col("url_id") > F.col("_first.url_id")).select(
        F.col("_first.url_id").alias("url1_id"), F.col("_first.url").alias("url1"),
        F.col("url_id").alias("url2_id"), F.col("url").alias("url2"), "content_hash_simhash",
        F.col("_first.word_count").alias("word_count1"), F.col("word_count").alias("word_count2"))


def equal_simhash_pairs_legacy(content: DataFrame) -> DataFrame:
    """As above without exact duplicates: one page per distinct content of a SimHash group, next
    to the first page of that group."""
    rows = content.where(_present("content_hash_simhash") & F.col("content_hash_sha256").isNotNull())
    variants = rows.groupBy("content_hash_simhash", "content_hash_sha256").agg(
        F.min(F.struct("url_id", "url", "content_length")).alias("_v"))
    distinct = variants.select("content_hash_simhash", "content_hash_sha256", "_v.*")
    first = [F.min(F.struct("url_id", "url", "content_length")).alias("_first")]
    members = _members(distinct, "content_hash_simhash", ["url_id", "url", "content_length"], first)
    return members.where(F.col("url_id") > F.col("_first.url_id")).select(
        F.col("_first.url_id").alias("url1_id"), F.col("url_id").alias("url2_id"),
        F.col("_first.url").alias("url1"), F.col("url").alias("url2"), "content_hash_simhash",
        F.col("_first.content_length").alias("url1_length"), F.col("content_length").alias("url2_length"),
        F.lit("Near duplicate").alias("duplicate_type"))


def content_hash_stats(content: DataFrame, measure: str = "word_count") -> DataFrame:
    """How many pages carry hashes, how many different ones, and the spread of `measure`."""
    sha = F.nullif(F.col("content_hash_sha256"), F.lit(""))
    sim = F.nullif(F.col("content_hash_simhash"), F.lit(""))
    return content.agg(
        F.count("*").alias("total_pages"),
        F.count(sha).alias("pages_with_sha256"),
        F.count(sim).alias("pages_with_simhash"),
        F.count_distinct(sha).alias("unique_sha256_hashes"),
        F.count_distinct(sim).alias("unique_simhash_hashes"),
        F.avg(measure).alias(f"avg_{measure}"),
        F.min(measure).alias(f"min_{measure}"),
        F.max(measure).alias(f"max_{measure}"),
    )
