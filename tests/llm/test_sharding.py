import math
import struct
import zlib

import xxhash

from webstrata.llm.sharding import shard_column, shard_rows


def draw(key, shard, weight=1.0):
    h = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
    return -weight / math.log(((h >> 11) + 0.5) / (1 << 53))


def best(key, weights):
    return max((draw(key, j, w), j) for j, w in enumerate(weights))[1]


def test_against_plain_hashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shard_rows(docs, [1.0] * 24).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert r.shard == best(r.doc_id, [1.0] * 24) and r.grown_shard in (r.shard, 24)
        assert r.grown_shard == best(r.doc_id, [1.0] * 25)


def check_slots(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))


def test_slots_have_no_gaps(odd, spark, sf):
    check_slots(shard_rows(odd, [1.0] * 3).collect())
    check_slots(shard_rows(spark.read.parquet(f"{sf}/documents.parquet"), [1.0] * 5, rows_per_bucket=7).collect())


def test_one_id_for_all_rows(spark):
    rows = shard_rows(spark.range(500).selectExpr("1L AS doc_id", "cast(id AS string) AS text"), [1.0] * 4, rows_per_bucket=10).collect()
    assert len({r.shard for r in rows}) == 1
    check_slots(rows)


def test_weights_and_removal(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in shard_column(keys, [1.0, 1.0, 2.0]).collect()}
    share = sum(s == 2 for s in before.values()) / len(before)
    assert 0.48 < share < 0.52
    after = {r.doc_id: r.shard for r in shard_column(keys, [1.0, 1.0]).collect()}
    assert all(after[k] == s for k, s in before.items() if s < 2)


def test_odd_and_empty(odd, odd_texts, nothing):
    rows = shard_rows(odd, [1.0] * 24).collect()
    assert len(rows) == len(odd_texts) and min(r.size for r in rows) == 8
    assert shard_column(odd, [1.0], shard_col="rid").columns.count("rid") == 1
    assert shard_rows(nothing, [1.0] * 24).collect() == []
