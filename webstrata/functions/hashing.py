"""Content fingerprints: SHA-256 for exact copies, 64-bit SimHash for near copies."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.expr import blank_to_null, col
from webstrata.functions.portions import portions

SHINGLE = 4
BITS = 64
TEXTS_AT_ONCE, LETTERS_AT_ONCE = 1000, 1 << 21
#: Numbers up to which distinct ones are found by a table instead of a sort.
LISTED_AT_MOST = 1 << 23


def _md5_tails(shingles: list[str]) -> np.ndarray:
    """The low half of every shingle's md5 as a number."""
    return np.frombuffer(b"".join(md5(s.encode()).digest()[8:] for s in shingles), ">u8").astype(np.uint64)


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (from 0, below `bound`) in order, and the place of every value among them."""
    if bound > LISTED_AT_MOST:
        return np.unique(values, return_inverse=True)
    place = np.zeros(bound, np.int32)
    place[values] = 1
    distinct = np.flatnonzero(place)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values].astype(np.int64)


def _shingle_hashes(texts: list[str]) -> np.ndarray:
    """The hash of every shingle of every text, text after text; a distinct shingle is hashed once."""
    letters, codes = _numbered(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), 0x110000)
    pairs, codes = _numbered(codes[:-1] * len(letters) + codes[1:], len(letters) ** 2)
    shingles = codes[:-2] * len(pairs) + codes[2:]
    ends = np.cumsum([len(t) for t in texts])[:-1]
    within = np.ones(len(shingles), bool)
    within[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    distinct, places = _numbered(shingles[within], len(pairs) ** 2)
    spelled = np.stack([half for pair in np.divmod(distinct, len(pairs)) for half in np.divmod(pairs[pair], len(letters))], axis=1)
    joined = letters[spelled].astype("<u4").tobytes().decode("utf-32-le")
    return _md5_tails([joined[i:i + SHINGLE] for i in range(0, len(joined), SHINGLE)])[places]


def _majorities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits that more than half of the hashes of every run have; runs follow each other.

    Eight bits, one of every byte, are added up at once, over 255 hashes at most so that no byte overflows.
    """
    parts = -(-lengths // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(lengths) - lengths, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ones = np.empty((len(starts), BITS), np.uint8)
    for at in range(0, len(starts), 1024):
        here = starts[at:at + 1024]
        end = starts[at + 1024] if at + 1024 < len(starts) else len(hashes)
        some = hashes[here[0]:end]
        for bit in range(8):
            sums = np.add.reduceat((some >> np.uint64(bit)) & np.uint64(0x0101010101010101), here - here[0])
            ones[at:at + 1024, bit::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > lengths[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64).view(np.int64)


def _portions(words: pd.Series) -> Iterator[list[tuple[int, str]]]:
    """Whole texts long enough to have shingles, with their places, about LETTERS_AT_ONCE at a time."""
    portion, letters = [], 0
    for i, w in enumerate(words):
        if w is not None and len(w) >= SHINGLE:
            portion.append((i, w))
            letters += len(w)
            if letters >= LETTERS_AT_ONCE:
                yield portion
                portion, letters = [], 0
    if portion:
        yield portion


def _simhash_batch(words: pd.Series) -> pd.Series:
    """Each distinct shingle of a portion is hashed once; a text adds up its shingles' bits."""
    out: list[int | None] = [
        int(_md5_tails([w]).view(np.int64)[0]) if w is not None and len(w) < SHINGLE else None for w in words]
    for portion in _portions(words):
        lengths = np.array([len(w) - SHINGLE + 1 for _, w in portion])
        for (i, _), value in zip(portion, _majorities(_shingle_hashes([w for _, w in portion]), lengths).tolist()):
            out[i] = value
    return pd.Series(out, dtype="Int64")


def _simhash_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A bounded part of a batch at a time is Python strings."""
    for words in batches:
        for at in portions(words, TEXTS_AT_ONCE, LETTERS_AT_ONCE):
            yield pa.array(_simhash_batch(pd.Series(words[at].to_pylist(), dtype=object)), type=pa.int64(), from_pandas=True)


# Declared non-deterministic so that the optimizer evaluates it once per row.
_simhash = F.arrow_udf(_simhash_batches, T.LongType()).asNondeterministic()


def simhash(text: Column | str) -> Column:
    """64-bit SimHash as a signed bigint: md5 of 4-character shingles of the lower-cased word
    characters, weighted by count; a bit is set when more than half of the weight sets it."""
    words = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_]", "")
    return _simhash(words)


def simhash_decimal(simhash_bits: Column | str) -> Column:
    """The hash as the decimal string of an unsigned integer."""
    return F.conv(F.hex(col(simhash_bits)), 16, 10)


def simhash_bits(decimal: Column | str) -> Column:
    """Back from the decimal string to the signed bigint; blank strings give null."""
    return F.conv(blank_to_null(decimal), 10, -10).cast("bigint")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def simhash_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - differing bits / 64; 0 when a hash is missing."""
    return F.coalesce(1 - hamming(a, b) / F.lit(float(BITS)), F.lit(0.0))


def is_exact_duplicate(a: Column | str, b: Column | str) -> Column:
    return F.coalesce((col(a) != "") & (col(a) == col(b)), F.lit(False))


def is_near_duplicate(a: Column | str, b: Column | str, threshold: float = 0.8) -> Column:
    present = col(a).isNotNull() & col(b).isNotNull()
    return present & (simhash_similarity(a, b) >= threshold)


def content_hashes(text: Column) -> Column:
    """struct(content_hash_sha256, content_hash_simhash, content_length) of cleaned text."""
    empty = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(empty, F.lit("")).otherwise(F.sha2(text, 256)).alias("content_hash_sha256"),
        F.when(empty, F.lit("")).otherwise(simhash_decimal(simhash(text))).alias("content_hash_simhash"),
        F.when(empty, F.lit(0)).otherwise(F.char_length(text)).cast("bigint").alias("content_length"),
    )
