import re
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webstrata.llm.graph import components
from webstrata.llm.jaccard import allocate, band_keys, bands, jaccard_classes, set_keys, shingle_sets
from .conftest import prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain(rows, percent=90):
    """(size, least id of the component) of every row, by comparing all pairs that share an n-gram."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for own in by.values():
        for k, i in enumerate(own):
            for j in own[k + 1:]:
                shared[i, j] += 1
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


def classes(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(tuple(r)[:3] for r in jaccard_classes(df, **more).collect())


def edited(text, seed, n):
    rng, w = np.random.default_rng(seed), text.split()
    for at in rng.choice(len(w), n, replace=False):
        w[at] = f"w{rng.integers(1000)}"
    return " ".join(w)


def near_copies():
    rows = []
    for base in range(12):
        words = [5, 9, 14, 20, 33, 60, 100, 150, 300, 600, 900, 1500][base]
        text = prose(100 + base, words)
        for k in range(14):
            changed = edited(text, 1000 * base + k, min(words // 3, k * words // 200 + k % 2))
            rows.append(changed if k % 3 else " ".join(changed.split()[k // 3:]) if k % 2 else changed + " " + prose(k, 1 + words // 40))
    return [(3 * i + 5, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = near_copies() + [(10_000 + i, t) for i, t in docs]
    want = plain(rows)
    assert len({c for _, _, c in want}) < len(rows) - 30
    assert classes(spark, rows) == want


@pytest.mark.parametrize("percent", [70, 80, 97])
def test_other_thresholds(spark, percent):
    rows = near_copies()
    assert classes(spark, rows, percent=percent) == plain(rows, percent)


def test_large_components(spark):
    """Chains and stars above the block size: pivots, then blocks."""
    base = prose(5, 200)
    rows = [(i, edited(base, i, 1 + i % 7)) for i in range(60)]
    chain = base.split()
    for i in range(60, 90):           # each like its neighbours, ends far apart
        chain = chain[3:] + prose(i, 3).split()
        rows.append((i, " ".join(chain)))
    assert classes(spark, rows, block=8, pivots=2) == plain(rows)
    assert classes(spark, rows, block=500) == plain(rows)
    assert classes(spark, rows, block=500, shingles=1000, pivots=3) == plain(rows)


def test_blocks_are_bounded_by_the_size_of_their_sets(spark, monkeypatch):
    """Long texts are compared few at a time."""
    from webstrata.llm import jaccard

    seen = []
    monkeypatch.setattr(jaccard, "_verify", lambda blocks, percent, real=jaccard._verify: seen.append(
        blocks.groupBy("group").agg(F.sum(F.length("set") / 8).alias("n"), F.count("*").alias("k"), F.sum(F.col("seeks").cast("int")).alias("s")).collect()) or real(blocks, percent))
    base = prose(6, 400)
    rows = [(i, edited(base, i, 1 + i % 5)) for i in range(40)]
    assert classes(spark, rows, shingles=1200, pivots=1) == plain(rows)
    groups = [g for part in seen for g in part]
    # Blocks are dealt by hash: some hold a few more than their share, beside the pivot.
    assert len(groups) > 10 and max(g.n for g in groups) < 12 * 400


def test_odd_rows(spark, odd, odd_texts, nothing):
    rows = [(i, t) for i, t in enumerate(odd_texts)]
    assert classes(spark, rows) == plain(rows)
    assert len(jaccard_classes(odd).collect()) == len(odd_texts)
    assert jaccard_classes(nothing).collect() == []


def test_many_copies(spark):
    rows = [(i, "the same few words again") for i in range(3000)] + [(5000, "the same few words"), (4000, None)]
    got = classes(spark, rows)
    assert {c for i, _, c in got if i < 3000} == {0} and got[-1] == (5000, 2, 5000) and got[-2] == (4000, 0, 4000)


def test_similar_sets_share_a_key():
    """At the very limit of the threshold, and whatever differs."""
    rng = np.random.default_rng(3)
    for size in [1, 2, 5, 8, 9, 10, 11, 17, 18, 19, 26, 27, 28, 40, 70, 100, 250, 600, 1000]:
        known = bands(4096, 90)
        highs = np.array([b.high for b in known])
        for _ in range(60):
            smaller = int(rng.integers(-(-size * 90 // 100), size + 1))
            both = -(-90 * (size + smaller) // 190)
            if both > smaller:
                continue
            pool = rng.integers(0, 1 << 63, size + smaller - both, dtype=np.uint64) | np.uint64(1)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:both], pool[size:]]))
            assert len(b) == smaller
            assert np.isin(set_keys(a, known, highs, 90), set_keys(b, known, highs, 90)).any()


def test_allocation():
    assert allocate(1, 1, 90) .segments == 1
    kinds = {b.deletions for b in bands(5000, 90)}
    assert kinds == {True, False}
    for b in bands(5000, 90):
        most = b.high * 10 // 90
        assert 2 * b.segments > most if b.deletions else b.segments - b.skipped > most
    unrelated = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, 100, dtype=np.uint64)) for i in range(200)]
    band = next(b for b in bands(5000, 90) if b.low <= 100 <= b.high)
    keys = np.concatenate([band_keys(s, band, 3) for s in unrelated])
    assert len(np.unique(keys)) > len(keys) - 5


def test_shingles():
    sets = shingle_sets(pa.array(["a b c d a b c", "A  b\tC", "a b", "a", "", None, "a b c"], pa.string()))
    assert [len(s) for s in sets] == [4, 1, 1, 1, 0, 0, 1] and sets[1] == sets[6] and len({s[0] for s in sets[1:4]}) == 3


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 3), (20, 20)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)} | {300 + i: 300 for i in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
