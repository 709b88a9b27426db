"""Exact deduplication with two passes over a Bloom filter.

The first pass counts, for every text, the bits its hash sets in a blocked Bloom filter; words and bits seen at least
twice make up the filter of possibly repeated hashes. The second pass probes it: rows it clears are unique and pass
straight through, only the others are shuffled and compared by SHA-256.

Native DataFrame functions throughout. Counting combines before its shuffle, so a text that fills a third of the table
costs one row per task; the join of possible repeats with their groups is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import bloom
from webstrata.llm.frames import ascii_lower, name, whole_row, with_results
from webstrata.session import cut


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                words: int = bloom.WORDS) -> DataFrame:
    """All rows of `docs` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts form one group. Of
    equal texts the row with the largest id stays (`kept`), keep_id names it; a null id sorts below all others. Among
    repeated rows with that same id exactly one stays. `carry` limits the input columns that are returned (default
    all); input columns named like a result are replaced. `words` bounds the broadcast filter.
    """
    rows = (docs.select(whole_row(docs, carry).alias("row"), name(id_col).alias("id"),
                        F.sha2(ascii_lower(name(text_col)), 256).alias("key"),
                        F.monotonically_increasing_id().alias("rid"))
            .withColumn("hashed", F.xxhash64("key")))
    # First pass. Equal texts share word and mask, so every repeated text is found.
    marks = (rows.select(bloom.word_of(F.col("hashed"), words).alias("word"), bloom.mask_of(F.col("hashed")).alias("mask"))
             .groupBy("word", "mask").count().where("count > 1"))
    repeated_filter = cut(marks.groupBy("word").agg(F.bit_or("mask").alias("bits")))
    # Second pass.
    probed = bloom.probe(rows, "hashed", repeated_filter, words)
    unique = probed.where(~F.col("maybe")).select("row", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                                  F.lit(True).alias("kept"), "key")
    possible = cut(probed.where("maybe").select("row", "id", "key", "rid"))     # pins the row numbers
    # Written, so that the join below deals out both sides anew and a group's rows can be split.
    groups = cut(possible.groupBy("key").agg(F.max(F.struct("id", "rid")).alias("best"), F.count("*").alias("group_size")))
    repeated = possible.join(groups, "key").select(
        "row", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"), "key")
    results = ("keep_id", "group_size", "kept")
    return with_results(unique.unionByName(repeated), "row",
                        {**{r: F.col(r) for r in results}, "text_sha256": F.col("key")})
