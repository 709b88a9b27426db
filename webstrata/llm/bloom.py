"""A blocked Bloom filter as a frame: one row per 64-bit word that has bits set.

A key sets three bits of one word, so a probe is one lookup. The filter has at most `words` rows, whatever the
size of the input, which bounds what is broadcast; a full filter only lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^22 words are 268 million bits: at most about 200 MB as a broadcast relation, far less while few bits are set.
WORDS = 1 << 22
_BITS = 6


def word_of(hashed: Column, words: int = WORDS) -> Column:
    """The word of a 64-bit hash; `words` is a power of two."""
    assert words & (words - 1) == 0, "words must be a power of two"
    return hashed.bitwiseAND(F.lit(words - 1))


def mask_of(hashed: Column) -> Column:
    """The three bits of a 64-bit hash within its word, from the hash's upper half."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned(hashed, 32 + _BITS * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def build(keys: DataFrame, hashed: Column, words: int = WORDS) -> DataFrame:
    """The filter (word, bits) over all keys."""
    return (keys.select(word_of(hashed, words).alias("word"), mask_of(hashed).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("bits")))


def probe(df: DataFrame, hashed: str, filter_: DataFrame, words: int = WORDS, maybe: str = "maybe") -> DataFrame:
    """`df` with the column `maybe`: false only where the key of column `hashed` is surely not in the filter.

    No row is shuffled: the filter, bounded by `words`, is broadcast.
    """
    mask = mask_of(F.col(hashed))
    out = df.join(F.broadcast(filter_.withColumnsRenamed({"word": "_word", "bits": "_bits"})),
                  word_of(F.col(hashed), words) == F.col("_word"), "left")
    return out.withColumn(maybe, F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))).drop("_word", "_bits")


def split_off(df: DataFrame, key: Column, keys: DataFrame, key_name: str, words: int = WORDS) -> DataFrame:
    """The rows of `df` whose `key` is not among the column `key_name` of `keys`.

    Rows the filter clears pass without a shuffle; only the others meet the keys in a join.
    """
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    hashed = df.select(row.alias("row"), key.alias("key")).withColumn("hashed", F.xxhash64("key"))
    found = probe(hashed, "hashed", build(keys, F.xxhash64(F.col(key_name)), words), words)
    clear = found.where(~F.col("maybe")).select("row.*")
    rest = found.where("maybe").join(keys.select(F.col(key_name).alias("key")).distinct(), "key", "left_anti")
    return clear.unionByName(rest.select("row.*"))
