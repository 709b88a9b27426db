"""Weighted rendezvous hashing: each record goes to the shard that draws the best score for its key.

A shard's score for a key depends on that key and shard alone, so a shard that is added only takes records into itself
and one that is removed only hands its own records on. Native DataFrame functions throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.frames import name, whole_row, with_results
from webstrata.session import cut

#: Rows that are numbered together; the number of groups follows the number of rows.
ROWS_PER_BUCKET = 10_000


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """(score, shard): an exponential draw from the hash of key and shard, scaled by the weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among len(weights) shards; a shard's share follows its weight."""
    assert weights and all(w > 0 for w in weights), "weights must be positive"
    draws = [draw(key, j, w) for j, w in enumerate(weights)]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text",
               grown_weight: float = 1.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    The law is `key`: id and weights alone decide, so equal ids share a shard; a null id is a key of its own.
    `grown_shard` is the shard with one more of `grown_weight`. `size` is the UTF-8 length plus 8, null text counting as
    empty. `slot` numbers the rows of a shard from 0 without gaps: rows are numbered in buckets of about
    `rows_per_bucket`, spread by row rather than by id so that a frequent id fills no bucket alone, and buckets follow
    each other. Only these narrow columns are shuffled, never the text.
    """
    text, key = F.coalesce(name(text_col), F.lit("")), name(id_col)
    narrow = cut(docs.select(
        key.alias("id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("rid")))
    buckets = max(1, -(-narrow.count() // (len(weights) * rows_per_bucket)))
    placed = narrow.withColumn("bucket", F.pmod(F.xxhash64("id", "rid"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "rid")) - 1)
    return numbered.join(before, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place")).alias("slot"), "grown_shard")


def shard_column(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """`docs` with the shard of every row, without a shuffle; a column named `shard_col` is replaced."""
    return with_results(docs.select(whole_row(docs).alias("row"), rendezvous(name(id_col), weights).alias("shard")),
                        "row", {shard_col: F.col("shard")})
