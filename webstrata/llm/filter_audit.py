"""Interaction of text filters: what each removes alone, after others, and on average over all orders.

Every document is reduced to a mask of the filters it fails; whether its text repeats an earlier document's comes from
tries over the texts. Documents then count only by part and mask, at most 2^filters rows per part, and every order of the
filters is read off those counts.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.frames import name
from webstrata.llm.text_tries import REMEMBERED_BYTES, TRIE_BYTES, repeated_flags
from webstrata.session import cut

#: Conditions of failure, as bits in this order: few words, few different words, many capitals, markup, repeated text.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 50, 65, 5
_CAPITALS, _MARKUP = bytes(range(ord("A"), ord("Z") + 1)), re.compile(rb"[#$%&*|]")
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D for a text in UTF-8. Words lie between the white space of ASCII."""
    words = text.split()
    n, capitals = len(words), len(text) - len(text.translate(None, _CAPITALS))
    fails = n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DIFFERENT * n, \
        capitals > 0 and 100 * capitals > MOST_CAPITALS * len(text.translate(None, _CONTINUATION)), _MARKUP.search(text) is not None
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                trie_bytes: int = TRIE_BYTES, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters, and how many of them are labelled
    quality = 1 and toxic = 1.

    A document that has several labels counts once, as what any of them says.
    """
    rows = docs.select(name(id_col).cast("bigint").alias("id"), F.coalesce(name(part_col).cast("string"), F.lit("")).alias("part"), name(text_col).alias("text"))
    flagged = repeated_flags(rows, text_mask, trie_bytes, remembered)
    repeat = 1 << FILTERS.index("E")
    masks = cut(flagged.select("id", "part", F.col("mask").bitwiseOR(F.when(F.col("repeated"), repeat).otherwise(0)).alias("mask")))
    told = cut(labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .where("good = 1 or toxic = 1"))
    zero = F.lit(0).cast("bigint")
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": zero, "toxic": zero})
    # Only rows with an id can have labels, so rows without one, however many, take no part in the join.
    marked = masks.join(told, "id").groupBy("part", "mask").agg(
        zero.alias("n"), F.sum(F.coalesce("good", zero)).alias("good"), F.sum(F.coalesce("toxic", zero)).alias("toxic"))
    return counts.unionByName(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _at(values: str, position: Column) -> Column:
    return F.element_at(F.col(values), position.cast("int") + 1)


def every_order(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    (part, mask, n, good, toxic), for every order of the filters and every step, zeros included."""
    k = len(filters)
    passing = {f"kept_{c}": F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in range(1 << k)])
               for c in ("n", "good", "toxic")}
    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(0)) for f in range(k)])
    parts = counts.groupBy("part").agg(*[v.alias(c) for c, v in passing.items()], alone.alias("alone"))

    def share(f: int) -> Column:
        """What filter f removes, summed over all orders: over the sets that may stand before it, times their orders."""
        before = [s for s in range(1 << k) if not s >> f & 1]
        return sum((F.col("kept_n")[s] - F.col("kept_n")[s | 1 << f]) * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in before)

    parts = parts.withColumn("shares", F.array(*[share(f) for f in range(k)]))
    orders = ["".join(p) for p in permutations(filters)]
    listed = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn(
        "step", F.explode(F.array(*[F.lit(i) for i in range(1, k + 1)])))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    number = F.instr(F.lit(filters), letter) - 1
    before = sum(F.when(F.instr(F.col("filter_order"), F.lit(x)) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(filters))
    after = sum(F.when(F.instr(F.col("filter_order"), F.lit(x)) <= F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(filters))
    own = F.call_function("shiftleft", F.lit(1), number)
    steps = listed.select("*", letter.alias("filter"), number.alias("number"), before.alias("before"), after.alias("after"), own.alias("own"))
    lost = {c: _at(f"kept_{c}", F.col("before")) - _at(f"kept_{c}", F.col("after")) for c in ("n", "good", "toxic")}
    fails = _at("kept_n", F.lit(0)) - _at("kept_n", F.col("own"))
    return steps.select("part", "filter_order", "step", "filter", _at("kept_n", F.col("after")).alias("kept"), lost["n"].alias("removed"),
                        (fails - lost["n"]).alias("redundant"), _at("alone", F.col("number")).alias("unique_fails"),
                        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), _at("shares", F.col("number")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of the five filters over `docs`, as `every_order` states it, per part.

    Parts are the values of `part_col`, null as the empty string; only values that occur have rows, so an empty table
    has none. Repeated rows, null ids and null texts: see `repeated_flags`.
    """
    return every_order(cut(mask_counts(docs, labels, **columns)))
