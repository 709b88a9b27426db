"""Best-fit packing of documents into sequences of a fixed number of tokens, by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is decided on their histogram, whatever the number of
documents: pieces above one third of the capacity are matched, the longest with the longest partner that fits, at most
two to a sequence; shorter ones, longest first, go to the tightest gap that holds them. The result is a short list of
rules ("the 5,000 pieces of length 300 from rank 200 on go three each to the sequences from 7,000 on"), and every piece
finds its place by its length and its rank among pieces of that length. Ranks are counted per task, then offset by the
counts of the tasks before, so no length is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.frames import name
from webstrata.llm.tokens import public_path, release, slices, small_batches, word_tokens
from webstrata.session import cut

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, rank): documents cut at the capacity, ranked by length within a task."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("piece", T.IntegerType())] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "rank")])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part, seen = word_tokens(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = int(end).to_bytes(4, "little")
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, ends = tokens.encode(texts)
                raw, rows, out = memoryview(ids.astype("<u4").tobytes()), [], []
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    total = b - a + 1
                    for piece, start in enumerate(range(0, total, capacity)):
                        length = min(capacity, total - start)
                        crc = zlib.crc32(raw[4 * (a + start):4 * min(b, a + start + length)])
                        if start + length == total:
                            crc = zlib.crc32(tail, crc)
                        rows.append(first + i)
                        out.append((piece, start, length, crc, part, seen[length]))
                        seen[length] += 1
                table = np.array(out, np.int64).reshape(-1, 6)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(table[:, 0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(table[:, k]) for k in range(1, 6)], names=schema.names)
        release()

    return docs.select(name(id_col).alias("id"), name(text_col).alias("text")).mapInArrow(cut_up, schema)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rules (length, first rank, pieces, pieces per sequence, first sequence, offset) that place all pieces.

    Large pieces are matched optimally: giving the longest piece the longest partner that fits never costs a sequence.
    """
    rules: list[tuple[int, ...]] = []
    left = {length: n for length, n in counts.items() if n}
    ranked = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}     # free tokens: (first sequence, sequences)
    sizes: list[int] = []                           # the free sizes, ascending
    opened = 0

    def place(length: int, pieces: int, each: int, sequence: int, offset: int) -> None:
        rules.append((length, ranked[length], pieces, each, sequence, offset))
        ranked[length] += pieces
        left[length] -= pieces

    def free(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((sequence, n))

    large = sorted(x for x in left if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            partner = bisect_left(large, min(a, capacity - a) + 1) - 1
            while partner >= 0 and (not left[large[partner]] or large[partner] == a and left[a] == 1):
                partner -= 1
            if partner < 0:
                n = left[a]
                place(a, n, 1, opened, 0)
                free(capacity - a, opened, n)
            elif large[partner] == a:
                n = left[a] // 2
                place(a, 2 * n, 2, opened, 0)
                free(capacity - 2 * a, opened, n)
            else:
                b = large[partner]
                n = min(left[a], left[b])
                place(a, n, 1, opened, 0)
                place(b, n, 1, opened, a)
                free(capacity - a - b, opened, n)
            opened += n

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at < len(sizes):
                gap = sizes[at]
                sequence, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, sequence, n = capacity, opened, -(-left[s] // (capacity // s))
                opened += n
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                place(s, full * each, each, sequence, capacity - gap)
                free(gap - each * s, sequence, full)
            rest = 0
            if full < n and left[s]:
                rest = left[s]
                place(s, rest, rest, sequence + full, capacity - gap)
                free(gap - rest * s, sequence + full, 1)
            free(gap, sequence + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(rules), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): the place of every piece of every document.

    A document is its ids and one `end`; null and empty texts are the end alone. Documents above the capacity are cut
    into pieces of that length, the last one shorter. Rows that share an id are documents of their own. Only the
    histogram of lengths, at most `capacity` rows, reaches the driver, and only the rules go back to the tasks: a few
    per length and gap.
    """
    with small_batches(docs.sparkSession):
        pieces = cut(token_pieces(docs, vocabulary or public_path(VOCABULARY), capacity, end, id_col, text_col))
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    rules = plan(histogram, capacity)
    # A rule is found by length and rank: both in one number, ascending.
    span = int(max(histogram.values(), default=0)) + 1
    keys = rules[:, 0] * span + rules[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        rule = rules[np.searchsorted(keys, size * span + at, side="right") - 1]
        nth = at - rule[:, 1]
        return pd.DataFrame({"sequence_id": rule[:, 4] + nth // rule[:, 3], "offset": rule[:, 5] + nth % rule[:, 3] * size})

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    placed = pieces.join(before, ["length", "part"]).withColumn("place", place("length", F.col("before") + F.col("rank")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))
