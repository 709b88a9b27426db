"""Joins and running aggregates that hold when one key carries a large share of all rows.

Plain fact-to-dimension joins rely on adaptive skew handling. It cannot act where the
dimension is itself an aggregate on the join key, in windows and in ordered folds; those
cases use the helpers below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.session import cut

HOT_KEYS = 4096          # a key outside the 4096 largest holds less than 1/4096 of the rows
ROWS_PER_SALT = 250_000  # rows of one key that may stay together
MAX_SALTS = 16_384       # parts one key is cut into at most


def hottest(counts: DataFrame, key: str, count: str, n: int = HOT_KEYS) -> DataFrame:
    """The `n` most frequent keys, a top-n and so at most `n` rows whatever the input, and the
    number of salts each needs for its rows."""
    salts = F.least(F.ceil(F.col(count) / F.lit(ROWS_PER_SALT)), F.lit(MAX_SALTS)).cast("int")
    return (counts.where(F.col(key).isNotNull()).orderBy(F.col(count).desc(), key).limit(n)
            .select(F.col(key).alias("_hot_key"), salts.alias("_salts")))


def hot_keys(table: DataFrame, key: str) -> DataFrame:
    """The most frequent values of a column, found by one pre-aggregated count. Taken from a stored
    table this reads a single column; a frame derived from that table has the same hot keys."""
    return hottest(table.groupBy(key).agg(F.count("*").alias("_n")), key, "_n")


def salted(facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Facts with a `_salt` that spreads rows of hot keys, and rows without a key."""
    hot = F.broadcast(hot)
    row_hash = F.xxhash64(*[c for c, t in facts.dtypes if "map<" not in t and "variant" not in t])
    salts = F.when(F.col(key).isNull(), F.lit(MAX_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    return facts.join(hot, facts[key] == hot["_hot_key"], "left").withColumn(
        "_salt", F.when(salts > 1, F.pmod(row_hash, salts)).otherwise(0).cast("int")).drop("_hot_key", "_salts")


def repeated(dim: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Dimension rows once per `_salt` their facts may have."""
    hot = F.broadcast(hot)
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return dim.join(hot, dim[key] == hot["_hot_key"], "left").withColumn("_salt", F.explode(salts)).drop("_hot_key", "_salts")


def join_unique(facts: DataFrame, dim: DataFrame, key: str, how: str = "left",
                hot: DataFrame | None = None) -> DataFrame:
    """Join `facts` with `dim`, which has at most one row per `key`.

    The most frequent keys are broadcast (at most HOT_KEYS values): `hot` if given, else counted
    from `facts`, which then should be a stored table and not a long computation. The fact rows of
    a hot key are cut into as many parts as its count asks for and only its dim row is repeated;
    every other key goes through the ordinary shuffle once. Rows without a key are spread as well.
    """
    if hot is None:
        hot = hot_keys(facts, key)
    return salted(facts, key, hot).join(repeated(dim, key, hot), [key, "_salt"], how).drop("_salt")


def chunked(rows: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """`rows` cut into ordered chunks of bounded size, as column `chunk`.

    Range partitioning on (key, order) splits even a single hot key evenly, because `order` is
    unique. The frame is written once, so chunk numbers stay the same when a task is retried.
    """
    keys = [key, *order]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return cut(ranged.withColumn("chunk", F.spark_partition_id()))


def dense_index(distinct_rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Number distinct rows 0, 1, 2, … in the order of `columns` without a global window."""
    ranged = distinct_rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition, so this window and the broadcast are bounded by the partition count.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + within).drop(
        "_part", "_id", "_offset")
