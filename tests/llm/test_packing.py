import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from webstrata.llm.packing import VOCABULARY, pack, plan
from webstrata.llm.tokens import public_path


def ids_of(texts, end):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_path(VOCABULARY))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, ids, capacity):
    """Pieces cover their documents, carry their ids and fill their sequences without gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for key, own in ids.items():
        want = [(k, s, min(capacity, len(own) - s), crc(own[s:s + capacity])) for k, s in enumerate(range(0, len(own), capacity))]
        assert sorted(pieces[key]) == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """Sequences of plain best-fit decreasing, piece by piece."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    return len(free)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs.repartition(5)).collect()
    known = docs.collect()
    n = check(rows, dict(zip([r.doc_id for r in known], ids_of([r.text for r in known], 0))), 2048)
    assert n <= best_fit([r.length for r in rows], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    rules, free, ranks = plan(counts, capacity), defaultdict(list), defaultdict(list)
    for length, first, n, each, sequence, offset in rules.tolist():
        ranks[length].append((first, n))
        for k in range(n):
            free[sequence + k // each].append((offset + k % each * length, length))
    for length, own in ranks.items():
        at = 0
        for first, n in sorted(own):
            assert first == at
            at += n
        assert at == counts[length]
    for own in free.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(free) <= best_fit([x for x, n in counts.items() for _ in range(n)], capacity)


def test_matching_is_optimal():
    # Above one third of 30: pairs are all that fits, and 14 pairs are possible.
    counts = {20: 4, 19: 3, 16: 5, 14: 6, 11: 9, 10 + 1: 9}
    lengths = [x for x, n in counts.items() for _ in range(n)]
    assert len({s for r in plan(counts, 30).tolist() for s in range(r[4], r[4] + -(-r[2] // r[3]))}) == best_fit(lengths, 30)


def test_odd_rows(spark, odd_texts, nothing):
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    for capacity in (2048, 16):
        check(pack(docs, capacity=capacity, end=5).collect(), dict(enumerate(ids_of(odd_texts, 5))), capacity)
    assert pack(nothing).collect() == []


def test_null_and_repeated_ids(odd, odd_texts):
    rows = pack(odd).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids_of(odd_texts, 0)))
