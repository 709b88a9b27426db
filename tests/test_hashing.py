from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webstrata.functions import hashing as H
from webstrata.operators import duplicates as D
from webstrata.operators import near_duplicates as N


def plain_simhash(text):
    counts = Counter(text[i:i + 4] for i in range(max(len(text) - 3, 1)))
    total, value = sum(counts.values()), 0
    tails = {s: int.from_bytes(md5(s.encode()).digest()[8:], "big") for s in counts}
    for bit in range(64):
        if 2 * sum(w for s, w in counts.items() if tails[s] >> bit & 1) > total:
            value |= 1 << bit
    return value - (1 << 64) if value >> 63 else value


def test_batch_simhash_equals_the_plain_form():
    texts = ["", "a", "abc", "abcd", "hello world hello", "ééé😀😀😀x", "q" * 50, "zażółć gęślą jaźń" * 3]
    assert [int(v) for v in H._simhash_batch(pd.Series(texts))] == [plain_simhash(t) for t in texts]


def test_sums_of_many_hashes_are_exact():
    """Bits are added up in bytes, 255 at a time, whatever table or sort numbers the shingles."""
    rng = np.random.default_rng(2)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz_0123456789", "".join(map(chr, range(0x4E00, 0x9000)))):
        texts = ["".join(rng.choice(list(letters), n)) for n in (4, 257, 258, 259, 513, 514, 3000)] + ["q" * 2000]
        lengths = np.array([len(t) - 3 for t in texts])
        assert H._majorities(H._shingle_hashes(texts), lengths).tolist() == [plain_simhash(t) for t in texts]


def test_many_different_letters_take_the_counting_path():
    texts = ["".join(map(chr, range(0x10000, 0x10000 + 66000))), "abcdabcd"]
    assert [int(v) for v in H._simhash_batch(pd.Series(texts))][1] == plain_simhash(texts[1])


def test_predicates(spark):
    row = spark.range(1).select(
        H.simhash_bits(F.lit("1234567890")).alias("a"), H.simhash_bits(F.lit("")).alias("none")).select(
        H.is_near_duplicate("a", "a").alias("same"), H.is_near_duplicate("a", "none").alias("missing"),
        H.simhash_similarity("a", "none").alias("zero"),
        H.is_exact_duplicate(F.lit("x"), F.lit("x")).alias("exact"),
        H.is_exact_duplicate(F.lit(""), F.lit("")).alias("blank")).first()
    assert tuple(row) == (True, False, 0.0, True, False)


def clustered_hashes():
    """Hashes around few centres, so that buckets overflow and must be split."""
    centres, out, state = [0x0123456789ABCDEF, 0x0123FFFF89ABCDEF, 0xF0F0F0F0F0F0F0F0], set(), 12345
    for centre in centres:
        for _ in range(150):
            value = centre
            for _ in range(4):
                state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
                value ^= 1 << (state >> 58)
            out.add(value - 2**64 if value >> 63 else value)
    return sorted(out)


def random_hashes(n):
    rng = np.random.default_rng(n)
    return sorted({int(h) for h in rng.integers(-2**63, 2**63 - 1, n)})


def near(a, b, distance):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= distance


def near_pairs(hashes, distance):
    return {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1:] if near(a, b, distance)}


@pytest.mark.parametrize("threshold, distance, block", [
    (0.95, 3, 32), (0.95, 3, 4096), (0.9, 6, 64), (0.8, 12, 16), (0.8, 12, 100), (0.8, 12, 4096), (0.7, 19, 50), (1.0, 0, 8)])
def test_near_duplicate_pairs_are_exact(spark, threshold, distance, block):
    """Small blocks make every bucket split as often as it can and be cut into blocks after that."""
    hashes = sorted({*clustered_hashes(), *random_hashes(300), 0, -1, 1, -2**63, 2**63 - 1})
    want = near_pairs(hashes, distance)
    copied = min(want)[0] if want else hashes[0]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)] + [(1000, copied), (1001, None)], "id long, simhash long")
    found = N.near_duplicate_pairs(rows, threshold, block).collect()
    got = [(r.simhash1, r.simhash2) for r in found]
    assert len(got) == len(set(got)) and set(got) == want
    for r in found:
        assert r.copies1 == 1 + (r.simhash1 == copied) and r.id1 == hashes.index(r.simhash1) and r.distance == ((r.simhash1 ^ r.simhash2) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("threshold, distance, block", [(0.8, 12, 4096), (0.8, 12, 20), (0.95, 3, 50)])
def test_near_duplicate_classes_are_exact(spark, threshold, distance, block):
    hashes = sorted({*clustered_hashes(), *random_hashes(100)})
    pairs = near_pairs(hashes, distance)
    least, links = {h: i for i, h in enumerate(hashes)}, Counter(h for p in pairs for h in p)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    rows = list(enumerate(hashes)) + [(2000, hashes[5]), (2001, hashes[5]), (2002, None)]
    got = {r.id: (r.class_id, r.links, r.copies) for r in N.near_duplicate_classes(
        spark.createDataFrame(rows, "id long, simhash long"), threshold, block).collect()}
    assert got == {i: (least[h], links[h], 3 if h == hashes[5] else 1) if h is not None else (i, 0, 1) for i, h in rows}


@pytest.mark.parametrize("distance, width", [(12, 4), (6, 4), (3, 8), (0, 8)])
def test_every_near_pair_has_one_bucket_per_level(distance, width):
    """Whatever bands a pair differs on, exactly one set of bands of each level is the one it meets on."""
    bands = 64 // width
    rng = np.random.default_rng(distance)
    for _ in range(200):
        differs = set(rng.choice(bands, rng.integers(0, min(distance, bands) + 1), replace=False).tolist())
        for depth in range(N._deepest(distance, width) + 1):
            met = [s for s in N.band_sets(depth, distance, width)
                   if not differs & set(s) and all(b in differs for b in range(s[-1] if s else 0) if b not in s)]
            assert len(met) == 1
    finer = {f for s in N.band_sets(2, distance, width) for f in N.next_bands(s, distance, width)}
    assert finer == set(N.band_sets(3, distance, width))


def test_a_dense_part_is_many_rows_of_bounded_size(spark):
    hashes = [(i << 1) | 0x55AA << 40 for i in range(3000)]
    members = N.buckets(spark.createDataFrame([(h,) for h in hashes], "h long"), 12, 256)
    rows = N.block_pairs(members, 256)
    largest = rows.selectExpr("max(size(blocks)) as n", "max(size(blocks[0].hs)) as m").first()
    assert largest.n == 2 and largest.m < 2 * 256 and rows.count() > 60


def test_buckets_are_split_only_where_that_pays(spark):
    """Splitting by bands at 12 bits would write every hash up to 1820 times; comparing a few hundred thousand takes less."""
    hashes = spark.createDataFrame([(h,) for h in random_hashes(20_000)], "h long")
    assert N.buckets(hashes, 12, 4096).count() == hashes.distinct().count()
    assert N.buckets(hashes, 3, 64).count() > 20_000


@pytest.mark.parametrize("distance", [3, 6, 12])
def test_split_buckets_lose_no_pair(spark, distance):
    hashes = sorted({*clustered_hashes(), *random_hashes(300)})
    split = N.buckets(spark.createDataFrame([(h,) for h in hashes], "h long"), distance, 1)
    assert split.where("mask <> 0").count() > 0
    width = N._width(distance)
    rows = N.block_pairs(split, 16)
    links = rows.mapInArrow(N._links(distance, width), "h bigint, links bigint, connected bigint").groupBy("h").sum("links").collect()
    assert {r[0]: r[1] for r in links} == Counter(h for p in near_pairs(hashes, distance) for h in p)


@pytest.mark.parametrize("distance, mask, width", [
    (0, 0, 4), (3, N.band_mask(2, 8), 8), (12, 0, 4), (12, N.band_mask(1, 4) | N.band_mask(4, 4), 4), (15, 0, 4), (16, 0, 4), (40, N.band_mask(2, 4), 4)])
def test_planes_find_the_same_pairs_as_numbers(monkeypatch, distance, mask, width):
    """Links and classes of two blocks, and of one with itself, when 64 columns are compared at once."""
    monkeypatch.setattr(N, "_DIRECT", 0)
    monkeypatch.setattr(N, "_TILE", (32, 192))
    hashes = np.random.default_rng(0).permutation(np.array([*clustered_hashes(), *random_hashes(150)])).view(np.uint64)
    for x, y in ((hashes[:210], hashes[210:]), (hashes[:330], None)):
        other = x if y is None else y
        apart = x[:, None] ^ other
        near_ = np.bitwise_count(apart) <= distance
        for band in N._skipped(mask, width):
            near_ &= (apart & band) != 0
        want = {tuple(sorted((int(x[i]), int(other[j])))) for i, j in zip(*np.nonzero(near_)) if y is not None or i != j}
        got = [tuple(sorted((int(x[i]), int(other[j])))) for a, b in N.near_in_blocks(mask, x, y, distance, width) for i, j in zip(a, b)]
        assert len(got) == len(set(got)) and set(got) == want
        both, count, root = N._linked(mask, x, y, distance, width)
        links = Counter(h for pair in want for h in pair)
        assert {int(h): int(n) for h, n in zip(both, count) if n} == links
        place = {int(h): i for i, h in enumerate(both)}
        least = np.arange(len(both))
        for _ in range(len(both)):
            before = least.copy()
            for a, b in want:
                least[place[a]] = least[place[b]] = min(least[place[a]], least[place[b]])
            if (before == least).all():
                break
        assert len(set(zip(least.tolist(), root.tolist()))) == len(set(least.tolist())) == len(set(root.tolist()))


def test_pairs_are_listed_a_bounded_number_at_a_time(monkeypatch):
    """Where all hashes are near each other too: no tile is listed whole."""
    monkeypatch.setattr(N, "_LISTED", 4096)
    hashes = np.arange(3000, dtype=np.uint64)
    names = [np.arange(3000, dtype=np.int32) * 2]
    found = list(N.near_in_blocks(0, hashes, None, 12, 4, names))
    assert max(len(i) for i, _ in found) < 2 * 4096
    pairs = np.sort(np.stack([np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])]), axis=0)
    assert pairs.shape[1] == 3000 * 2999 // 2 == len(np.unique(pairs[0].astype(np.int64) * 6000 + pairs[1])) and not (pairs % 2).any()


def test_hashes_that_mostly_agree_are_not_split(spark):
    """Bands that most hashes agree on save no comparison: buckets by them would be compared again and again."""
    rng = np.random.default_rng(4)
    flips = (rng.random((3000, 64)) < 0.1) @ (1 << np.arange(64, dtype=np.uint64)).astype(object)
    hashes = spark.createDataFrame([(h,) for h in sorted({int(f) - (1 << 64) if f >> 63 else int(f) for f in map(int, flips)})], "h long")
    agreeing = N._agreeing(hashes, 4)
    assert min(agreeing) > 0.2
    whole = N.buckets(hashes, 12, 16, agreeing)
    assert whole.count() == hashes.count() and whole.where("mask <> 0").count() == 0
    assert N.buckets(hashes, 12, 16).where("mask <> 0").count() > 0


def test_blocks_far_from_each_other_are_not_compared(spark):
    """Hashes around far centres come into blocks of their own, and no tile of two such blocks is compared."""
    hashes = [h for h in clustered_hashes() if near(h, 0x0123456789ABCDEF, 12) or near(h, 0xF0F0F0F0F0F0F0F0 - 2**64, 12)]
    table = spark.createDataFrame([(h,) for h in hashes], "h long")
    around = N.centres(table)
    rows = N.block_pairs(N.buckets(table, 12, 4096), 64, around).collect()
    blocks = [[np.array([m.h for m in b.hs], np.int64).view(np.uint64) for b in r.blocks] for r in rows]
    assert sorted(int(h) for b in blocks if len(b) == 1 for h in b[0].view(np.int64)) == hashes
    # The places of all pairs are there, though not all are compared.
    n = len([b for b in blocks if len(b) == 1])
    assert len(blocks) == n * (n + 1) // 2
    compared = sum((r.stop - r.start) * (c.stop - c.start) for b in blocks if len(b) == 2 for r, c, _ in N._Sides(0, *b, 12, 4).near_bits())
    assert 0 < compared < 0.8 * sum(len(b[0]) * len(b[1]) for b in blocks if len(b) == 2)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "id long, simhash long")
    assert N.near_duplicate_pairs(rows).collect() == [] and N.near_duplicate_classes(rows).collect() == []


def test_copies_are_listed_once_per_member(spark):
    rows = spark.createDataFrame([(i, f"u{i:03d}", "same" if i % 3 == 0 else f"h{i}", "s", i) for i in range(90)],
                                 "url_id long, url string, content_hash_sha256 string, content_hash_simhash string, word_count long")
    assert D.exact_duplicate_members(rows).count() == 30
    assert [tuple(r) for r in D.exact_duplicate_groups(rows).collect()] == [("same", 30, "u000")]
    pairs = D.equal_simhash_pairs(rows).collect()
    assert len(pairs) == 89 and {p.url1 for p in pairs} == {"u000"}
