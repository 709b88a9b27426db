"""Benchmark decontamination by winnowing.

A window of L words has L - k + 1 hashes of k words; its fingerprint is the least of them. A window that occurs in both
texts has the same fingerprint in both, which guarantees that every shared span of L words or more is found. The
fingerprints of a document's sliding windows meet those of the benchmark in a Bloom filter of bounded size, in the stage
that computes them, and only windows that it lets through are shuffled; hits are then extended: the windows behind a
shared fingerprint are compared word by word.

Native DataFrame functions throughout, and one pass over the texts, whatever the size of the benchmark: windows of all
lengths (one, unless the benchmark has items shorter than a window) are looked up together.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm import bloom
from webstrata.llm.frames import name
from webstrata.session import cut

#: Words of a window.
WINDOW = 10
#: Everything in ASCII that is neither a letter nor a digit parts words.
SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)


def words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SEPARATORS + string.ascii_uppercase,
                        " " * len(SEPARATORS) + string.ascii_lowercase)
    return F.array_remove(F.split(plain, " "), "")


def _gram(length: int) -> int:
    """Words per hash for windows of `length` words."""
    return (length + 1) // 2


def _fingerprints(df: DataFrame, length: int, out: str) -> DataFrame:
    """Column `out`: the fingerprint of every window of `length` words of `w`."""
    def sliding(column: str, width: int, of) -> Column:
        return F.transform(F.slice(column, 1, F.greatest(F.size(column) - (width - 1), F.lit(0))),
                           lambda x, i: of(x, *[F.get(column, i + j) for j in range(1, width)]))

    k = _gram(length)
    df = df.withColumn("_h", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_grams", sliding("_h", k, F.xxhash64)).drop("_h")
    least = F.col("_grams") if length == k else sliding("_grams", length - k + 1, F.least)
    return df.withColumn(out, least).drop("_grams")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame | None:
    """(length, print, window, item): every window of every item; an item of fewer words is one window."""
    items = cut(benchmark.select(name(id_col).cast("string").alias("item"), words(name(text_col)).alias("w"))
                .withColumn("length", F.least(F.size("w"), F.lit(window))).where("length > 0"))
    # At most `window` numbers.
    lengths = [r[0] for r in items.select("length").distinct().orderBy("length").collect()]
    out = None
    for length in lengths:
        one = _fingerprints(items.where(F.col("length") == length), length, "f").select(
            "length", "item", "w", F.posexplode(F.concat("f", F.array().cast("array<bigint>"))).alias("at", "print")).select(
            "length", "print", F.array_join(F.slice("w", F.col("at") + 1, length), " ").alias("window"), "item")
        out = one if out is None else out.unionByName(one)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, filter_words: int = bloom.WORDS,
                  key: Column | None = None) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of `docs`.

    A word is hit inside any occurrence of a benchmark window. `n_items` counts the items with occurring windows,
    `items_sha256` is the digest of their ids, sorted as strings and joined by commas. Null and wordless texts have no
    words and no hits, as has every text against an empty benchmark; items without words match nothing, and items
    without an id are hits that are not listed. Rows that share an id are reported row by row. `key` adds a column
    `key` to carry along. `filter_words` bounds the broadcast filter; a full one only lets more windows through.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), name(id_col).alias("id"),
                        (F.lit(None).cast("string") if key is None else key).alias("key"), words(name(text_col)).alias("w"))
    prepared = benchmark_windows(benchmark, item_col, item_text, window)
    if prepared is None:
        base = texts.select("id", "key", F.size("w").alias("n"))
        return _report(base.withColumns({"n_hit": F.lit(0), "items": F.array().cast("array<string>")}), id_col, key)
    windows = cut(prepared.distinct())
    prints = cut(windows.select("length", "print").distinct())
    lengths = [r[0] for r in prints.select("length").distinct().orderBy("length").collect()]         # at most `window` numbers
    known = cut(bloom.build(prints, F.col("print"), filter_words))
    exact = cut(windows.select(F.col("window").alias("known"), F.col("length").alias("known_length")).distinct())

    hashed = texts
    for length in lengths:
        hashed = _fingerprints(hashed, length, f"f{length}")
    # Fingerprints of all lengths one after the other, then one row of the document's own. It joins nothing, and a key of
    # its own, which no window has, keeps such rows from meeting in one task.
    sizes = [F.size(f"f{length}") for length in lengths]
    ends = [sum(sizes[1:i + 1], sizes[0]) for i in range(len(lengths))]
    placed = hashed.select(
        "rid", "id", "key", F.size("w").alias("n"), "w", F.array(*ends).alias("ends"),
        F.posexplode(F.concat(*[F.col(f"f{length}") for length in lengths], F.array(F.lit(0).cast("bigint")))).alias("place", "print"))
    own_row = F.col("place") == F.element_at("ends", -1)
    met = bloom.probe(placed, "print", known, filter_words).where(F.col("maybe") | own_row)
    length, at = F.lit(None).cast("int"), F.lit(-1)
    for i, own in reversed(list(enumerate(lengths))):
        first = F.get("ends", F.lit(i - 1)) if i else F.lit(0)
        within = F.col("place") < F.get("ends", F.lit(i))
        length, at = F.when(within, F.lit(own)).otherwise(length), F.when(within, F.col("place") - first).otherwise(at)
    told = met.select("rid", "id", "key", "n", "w", length.alias("length"), at.alias("at"))
    found = cut(told.select("rid", "id", "key", "n", F.coalesce("length", F.lit(0)).alias("length"), "at",
                            F.when(F.col("at") >= 0, F.array_join(F.slice("w", F.col("at") + 1, F.coalesce("length", F.lit(0))), " "))
                            .otherwise(F.concat(F.lit(" "), F.col("rid").cast("string"))).alias("window"))
                .join(exact, (F.col("window") == F.col("known")) & (F.col("length") == F.col("known_length")), "left")
                .where("known is not null or at < 0").drop("known", "known_length"))

    order = Window.partitionBy("rid").orderBy("at", "length")
    reach = F.max(F.col("at") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (found.where("at >= 0").withColumn("reach", reach)
               .withColumn("fresh", F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest("at", F.coalesce("reach", F.lit(0)))))
               .groupBy("rid").agg(F.sum("fresh").alias("n_hit")))
    listed = (found.where("at >= 0").select("rid", "window").distinct()
              .join(windows.where("item is not null").select("window", "item").distinct(), "window")
              .groupBy("rid").agg(F.collect_set("item").alias("items")))
    base = found.where("at < 0").select("rid", "id", "key", "n")
    joined = base.join(covered, "rid", "left").join(listed, "rid", "left")
    return _report(joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)),
                                       "items": F.coalesce("items", F.array().cast("array<string>"))}), id_col, key)


def _report(df: DataFrame, id_col: str, key: Column | None) -> DataFrame:
    out = df.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), F.col("n_hit").cast("bigint").alias("n_hit"),
                    F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "key")
    return out.drop("key") if key is None else out
