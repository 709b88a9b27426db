"""Reading page snapshots and URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.expr import strip
from webstrata.functions.urls import to_staging


def read_pages(spark: SparkSession, path: str, urls: list[str] | DataFrame | None = None) -> DataFrame:
    """The page snapshot without pages that have no HTML; only `urls` if given.

    A list becomes a pushed-down filter; a long one should be given as a frame (column url), which
    is a semi join.
    """
    pages = spark.read.parquet(path).where("html is not null and html <> ''")
    if urls is None:
        return pages
    if isinstance(urls, list):
        return pages.where(F.col("url").isin(urls))
    return pages.join(urls.select("url").distinct(), "url", "left_semi")


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Spread a frame read from few files over `partitions`, ahead of CPU-bound work such as parsing."""
    return df.repartition(partitions)


def read_url_list(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """URLs from a CSV with a header, or from a text file with one URL per line.

    The file counts as CSV if its first line has a comma and letters. Blank lines and `#`
    comments are skipped.
    """
    lines = spark.read.text(path)
    first = lines.limit(1).select("value").head()
    if first is not None and "," in first[0] and any(c.isalpha() for c in first[0]):
        urls = spark.read.option("header", True).csv(path).select(strip(column).alias("url"))
    else:
        urls = lines.select(strip("value").alias("url"))
    return urls.where("url is not null and url <> '' and not startswith(url, '#')")


def read_commercial_pages(spark: SparkSession, path: str, origin: str, staging: str) -> DataFrame:
    """Commercial URLs from a CSV (column url) with the URL each should have on staging."""
    urls = spark.read.option("header", True).csv(path).select(strip("url").alias("commercial_url"))
    return urls.where("commercial_url is not null and commercial_url <> ''").withColumn(
        "expected_staging_url", to_staging("commercial_url", origin, staging))
