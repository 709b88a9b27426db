"""Jaccard join of word n-gram sets by universe partition.

Two sets of sizes up to r whose similarity reaches the threshold differ in at most H elements. Elements are hashed into
m segments; if m exceeds H, a pair agrees in one whole segment, and if 2 m exceeds H, it differs by at most one element
in some segment. Sizes are banded, so that H and m follow the size. Per band the cheaper of two allocations is taken:

* segment subsets: each segment is one key. Segments of fewer than two elements, which unrelated sets share by chance,
  cost the most candidates; m is raised so that up to `skipped` of them need no key.
* one-deletion neighbourhoods: half as many segments, each with a key for itself and one for every element left out.
  Short sets, for which chance would rule above, take this one.

A set probes its own band and the one below, where smaller partners lie. Sets that share a key are candidates; every
candidate is verified on the full sets.

Scale. Equal sets are one class before anything else, so copies are never paired. Of the sets under one key each is
tied to the least only, and the components of these ties bound where links can be: classes are verified within their
component. Small components are compared as one block. In a large one every class first meets a few pivots; most then
hang together, and only classes outside the largest part are compared with all others, block by block. A pair that is
connected already need not be compared, so no link that matters to the classes is lost, and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm import bloom
from webstrata.llm.frames import name, text_key
from webstrata.llm.graph import components
from webstrata.llm.tokens import per_worker, release, slices
from webstrata.session import cut

PERCENT, WORDS = 90, 3
#: Classes compared in one block, and pivots of a larger component.
BLOCK, PIVOTS = 256, 8
#: N-grams of a block's sets: 32 MB of them, whatever the number of classes.
BLOCK_SHINGLES = 4 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SPACES = "[\x09-\x0D]"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


# --- Sets -------------------------------------------------------------------------------------------------------------

def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of distinct word n-grams of each text, as sorted 64-bit hashes.

    Words are runs without ASCII white space after lower-casing A-Z. A text of fewer words is one n-gram as a whole; a
    text without words, or null, has an empty set.
    """
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _SPACES, " ")
    parts = pc.split_pattern(plain, " ")
    told = parts.flatten().dictionary_encode()
    spelled = told.dictionary.to_pylist()
    hashes = _word_hashes(spelled)[told.indices.to_numpy()]
    blank = spelled.index("") if "" in spelled else -1
    keep = told.indices.to_numpy() != blank
    ends = np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy()]
    hashes = hashes[keep]
    # All n-grams of the slice at once; those across two texts are left out below.
    n = len(hashes)
    grams = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        grams = _mix(grams * _ODD[0] + hashes[k:n - words + 1 + k] * _ODD[1] + np.uint64(k + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= words:
            own = grams[a:b - words + 1]
            own = np.sort(own)
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:      # the whole sequence; its length keeps it apart from longer n-grams
            h = np.array([b - a], np.uint64) * _ODD[2]
            for k in range(a, b):
                h = _mix(h * _ODD[1] + hashes[k:k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- Keys -------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Band:
    """Sizes `low` to `high`, cut into `segments`; `skipped` light segments need no key; or neighbourhoods of one deletion."""
    low: int
    high: int
    segments: int
    skipped: int
    deletions: bool


def allocate(low: int, high: int, percent: int) -> Band:
    """The cheaper allocation for a band: in keys per set, with no key that unrelated sets share by chance.

    Two sets, the smaller one of size s, are alike only if they differ in at most s (100 - percent) / percent elements.
    """
    most = high * (100 - percent) // percent
    deletions = Band(low, high, most // 2 + 1, 0, True)
    if most == 0:
        return Band(low, high, 1, 0, False)
    skipped = 0
    while skipped <= most // 2 + 1:
        segments = most + 1 + skipped
        mean = low / segments
        light = segments * (1 + mean) * np.exp(-mean)          # expected segments of fewer than two elements
        needed = int(np.ceil(light + 3 * np.sqrt(light)))
        if needed <= skipped:
            full = Band(low, high, segments, skipped, False)
            return min(full, deletions, key=lambda b: b.segments + (high if b.deletions else 0))
        skipped = needed
    return deletions


def bands(limit: int, percent: int) -> list[Band]:
    """Bands up to sizes of `limit`: each reaches 1 / threshold^2 times its least size, so a set's smaller partners
    lie in its band or the one below."""
    out, low = [], 1
    while low <= limit:
        high = max(low, low * 100 * 100 // (percent * percent))
        out.append(allocate(low, high, percent))
        low = high + 1
    return out


def band_keys(own: np.ndarray, band: Band, number: int) -> np.ndarray:
    """The keys of one set in one band."""
    m = band.segments
    spread = _mix(own ^ _ODD[2])
    segment = ((spread >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    sums, sizes = np.zeros(m, np.uint64), np.bincount(segment, minlength=m)
    np.add.at(sums, segment, _mix(own + _ODD[1]))
    base = _mix(np.arange(m, dtype=np.uint64) * _ODD[0] + np.full(m, number + 1, np.uint64) * _ODD[1])
    if not band.deletions:
        light = sizes < 2
        kept = ~light if light.sum() <= band.skipped else np.ones(m, bool)
        return _mix(sums + base)[kept]
    without = sums[segment] - _mix(own + _ODD[1])
    return np.concatenate([_mix(sums + base), _mix(without + base[segment])])


def set_keys(own: np.ndarray, all_bands: list[Band], highs: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the set's own band, and of the band below if a smaller partner may lie there."""
    if not len(own):
        return np.zeros(0, np.uint64)
    at = int(np.searchsorted(highs, len(own)))
    keys = [band_keys(own, all_bands[at], at)]
    if at and -(-len(own) * percent // 100) <= all_bands[at - 1].high:
        keys.append(band_keys(own, all_bands[at - 1], at - 1))
    return np.unique(np.concatenate(keys))


def _signatures(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(rid, id, text_key, n_shingles, high, low, keys) for every row."""
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", docs.schema["id"].dataType),
                           T.StructField("text_key", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_shingles", "high", "low")],
                           T.StructField("keys", T.ArrayType(T.LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker("sets", dict)                # drops what an earlier operator remembered
        known = bands(1 << 12, percent)
        highs = np.array([b.high for b in known])
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                sets = shingle_sets(texts, words)
                largest = max(map(len, sets))
                if largest > highs[-1]:
                    known = bands(2 * largest, percent)
                    highs = np.array([b.high for b in known])
                keys = [set_keys(s, known, highs, percent) for s in sets]
                with np.errstate(over="ignore"):
                    high = np.array([_mix(s + _ODD[0]).sum(dtype=np.uint64) for s in sets], np.uint64)
                    low = np.array([_mix(s + _ODD[2]).sum(dtype=np.uint64) for s in sets], np.uint64)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, len(texts)) for c in ("rid", "id", "text_key")]
                    + [pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                       pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))], names=schema.names)
        release()

    return docs.mapInArrow(sign, schema)


# --- Verification -----------------------------------------------------------------------------------------------------

def _links(sets: list[np.ndarray], seekers: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join parts: seekers against all sets of the block, leaving out what is connected already."""
    parent = {p: p for p in set(part.tolist())}

    def root(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    if len(parent) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    out = []
    if len(sets) > 2:
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark = np.zeros(len(values), bool)
    for i in seekers.tolist():
        mine = root(part[i])
        roots = np.array([root(p) for p in part.tolist()])
        least, most = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        open_ = np.flatnonzero((roots != mine) & (least * 100 >= most * percent))
        if not len(open_):
            continue
        if len(sets) == 2:
            j = int(open_[0])
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))])
        else:
            own = flat[starts[i]:starts[i] + sizes[i]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts)[open_]
            mark[own] = False
        union = sizes[i] + sizes[open_] - both
        for j in open_[100 * both >= percent * union].tolist():
            a, b = root(part[i]), root(part[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _verify(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups of `blocks`: (group, rid, part, seeks, set). A group is bounded by its maker."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
            rid, part = rows.column("rid").to_numpy(), rows.column("part").to_numpy()
            seekers = np.flatnonzero(rows.column("seeks").to_numpy(zero_copy_only=False))
            links = np.array(_links(sets, seekers, part, percent), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rid[links[:, 0]]), pa.array(rid[links[:, 1]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("group").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and held[-1].column("group")[-1].as_py() != names[a]:
                    yield done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield done(pa.Table.from_batches(held))
        held = []
        release()

    ordered = blocks.repartition("group").sortWithinPartitions("group", "rid")
    return ordered.select("group", "rid", "part", "seeks", "set").mapInArrow(check, "a bigint, b bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rid, set) for the classes in `wanted` (rid, text_key): their texts are read again, found by text.

    Only texts a broadcast Bloom filter of bounded size lets through are shuffled.
    """
    hashed = docs.select("text", "text_key").withColumn("hashed", F.xxhash64("text_key"))
    found = bloom.probe(hashed, "hashed", cut(bloom.build(wanted, F.xxhash64("text_key"))))
    texts = found.where("maybe").groupBy("text_key").agg(F.any_value("text").alias("text")).join(wanted, "text_key").select("rid", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                sets = pa.array([s.tobytes() for s in shingle_sets(part, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(first, len(part)), sets], names=["rid", "set"])

    return texts.mapInArrow(shingle, "rid bigint, set binary")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    words: int = WORDS, block: int = BLOCK, pivots: int = PIVOTS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, text_key, class_number) for every row of `docs`.

    Two rows link when 100 * intersection >= percent * union of their sets of word n-grams; component_id is the least id
    reachable by links, the row's own included. Rows without words, null texts among them, have an empty set and link
    with nothing; a null id counts as the largest. Rows with equal sets are one class whatever their number, so repeated
    rows and repeated ids need no care. `class_number` tells classes apart where ids repeat; it is null for empty sets. An
    empty table gives no rows. At most about `block` classes and `shingles` n-grams are compared in one place, or two classes.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("rid"), name(id_col).alias("id"), name(text_col).alias("text"),
                        text_key(name(text_col)).alias("text_key"))
    signed = cut(_signatures(plain, percent, words))
    told = ["n_shingles", "high", "low"]
    classes = cut(signed.where("n_shingles > 0").groupBy(*told).agg(F.min("rid").alias("rid"), F.min("id").alias("least_id")))
    keyed = signed.join(classes.select("rid"), "rid").select("rid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last")
    ties = cut(keyed.join(shared.select("key", "first"), "key").where("rid <> first")
               .select(F.col("rid").alias("a"), F.col("first").alias("b")).distinct())
    # Both sides of a join on a component are written, so that a large component's rows can be split.
    groups = components(ties).withColumnRenamed("node", "rid")           # rid, component
    sized = cut(groups.join(signed.select("rid", "text_key", "n_shingles"), "rid"))
    blocks = cut(sized.groupBy("component").agg(_blocks(block, shingles).alias("blocks")))
    wanted = cut(sized.join(blocks, "component"))
    held = cut(_sets_of(plain.select("text", "text_key"), wanted.select("rid", "text_key"), words)
               .join(wanted.select("rid", "component", "blocks", "n_shingles"), "rid"))

    small = held.where("blocks = 1").select(
        F.col("component").cast("string").alias("group"), "rid", F.col("rid").alias("part"), F.lit(True).alias("seeks"), "set")
    links = cut(_verify(small, percent))
    large = held.where("blocks > 1")
    if large.select("rid").limit(1).count():
        links = links.unionByName(_large_links(large, percent, block, pivots, shingles))
    joined = components(links).select(F.col("node").alias("rid"), F.col("component").alias("joined"))

    part = cut(classes.join(joined, "rid", "left").withColumn("joined", F.coalesce("joined", "rid")))
    least = cut(part.groupBy("joined").agg(F.min("least_id").alias("component_id")))
    named = part.join(least, "joined").select(*told, "component_id", F.col("joined").alias("class_number"))
    return signed.select("id", "text_key", *told).join(named, told, "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "text_key", "class_number")


def _blocks(block: int, shingles: int) -> Column:
    """Blocks that a group's classes are compared in, by their number and by the size of their sets."""
    return F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(shingles))).cast("bigint")


def _large_links(large: DataFrame, percent: int, block: int, pivots: int, shingles: int) -> DataFrame:
    """Links within components of several blocks: pivots first, then what they left apart, block by block."""
    spread = large.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    # The pivots: in each of so many parts, dealt by hash, the class whose hash is least.
    chosen = cut(large.select("component", F.xxhash64("rid").alias("h"), "rid").groupBy("component", F.pmod("h", F.lit(pivots)))
                 .agg(F.min(F.struct("h", "rid"))["rid"].alias("rid")).select("rid"))
    pivot = large.join(chosen, "rid").select(
        "component", "rid", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    own = spread.join(chosen, "rid", "left_anti")
    met = own.select("component", "salt", "rid", "set").withColumn("seeks", F.lit(False)).unionByName(
        pivot.withColumn("seeks", F.lit(True)))
    first = cut(_verify(met.select(F.concat_ws(":", "component", "salt").alias("group"), "rid", F.col("rid").alias("part"), "seeks", "set"), percent))

    parts = components(first).select(F.col("node").alias("rid"), F.col("component").alias("part"))
    state = cut(large.select("rid", "component", "blocks", "n_shingles").join(parts, "rid", "left").withColumn("part", F.coalesce("part", "rid")))
    sizes = state.groupBy("component", "part").agg(F.count("*").alias("n"))
    main = cut(sizes.groupBy("component").agg(F.max(F.struct("n", "part")).alias("main")))
    apart = cut(state.join(main, "component").withColumn("apart", F.col("part") != F.col("main.part"))
                .select("rid", "component", "part", "blocks", "n_shingles", "apart"))
    seekers = cut(apart.where("apart").groupBy("component").agg(_blocks(block, shingles).alias("seekers")))
    marked = large.select("rid", "set").join(apart.drop("n_shingles"), "rid").join(seekers, "component")
    # Every block of seekers meets every block of the component.
    seeker_blocks, all_blocks = F.col("seekers"), F.col("blocks")
    everyone = marked.select("component", "rid", "part", "set", F.lit(False).alias("seeks"),
                             F.pmod(F.xxhash64("rid"), all_blocks).alias("j"),
                             F.explode(F.sequence(F.lit(0), seeker_blocks - 1)).alias("i"))
    seeking = marked.where("apart").select("component", "rid", "part", "set", F.lit(True).alias("seeks"),
                                           F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("j"),
                                           F.pmod(F.xxhash64("rid"), seeker_blocks).alias("i"))
    blocks = everyone.unionByName(seeking.select(everyone.columns))
    second = _verify(blocks.select(F.concat_ws(":", "component", "i", "j").alias("group"), "rid", "part", "seeks", "set"), percent)
    return first.unionByName(second)
