import zlib

import numpy as np
import pytest

from webstrata.llm import records
from webstrata.llm.records import crc32c, encode_to_records, frame, masked, read_records, read_shuffled, unframe, write_records
from webstrata.session import scratch_path
from .test_packing import crc, ids_of


def slow_crc32c(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 6000, np.uint8)
    starts = rng.integers(0, 3000, 60)
    lengths = np.concatenate([[0, 1, 2, 3, 4, 5, 255, 256, 257, 512, 3000], rng.integers(0, 3000, 49)])
    assert crc32c(data, starts, lengths).tolist() == [slow_crc32c(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def test_framing():
    data = np.arange(100, dtype=np.uint8)
    out, offsets = frame(data, np.array([0, 0, 10, 100]))
    assert offsets.tolist() == [0, 16, 42] and int.from_bytes(out[16:24], "little") == 10
    starts, lengths, used = unframe(out)
    assert starts.tolist() == [12, 28, 54] and lengths.tolist() == [0, 10, 90] and used == len(out)
    assert unframe(out[:-1])[2] == 42
    for at in (16, 20, 30, 41):
        broken = bytearray(out)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(broken) + bytes(400))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = sorted(docs.collect())
    ids = ids_of([r.text for r in known], 2)
    rows = sorted(encode_to_records(docs.repartition(3)).collect())
    start = 0
    for r, doc, own in zip(rows, known, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, start, len(own), crc(own))
        start += len(own)


def test_odd_rows(spark, odd, odd_texts, nothing):
    folder = scratch_path(spark, "records")
    files = write_records(odd, folder)
    rows = read_records(files, with_ids=True).collect()
    assert sorted(crc(r.ids) for r in rows) == sorted(map(crc, ids_of(odd_texts, 2)))
    ordered = sorted(rows, key=lambda r: r.start)
    keys = [-1 if r.id is None else r.id for r in ordered]
    assert keys == sorted(keys) and ordered[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    mixed = read_shuffled(files, 5).collect()
    assert sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mixed) == sorted(r.ids_crc32 for r in rows)
    assert [r.place for r in mixed] != [r.place for r in read_shuffled(files, 6).collect()]
    assert encode_to_records(nothing).collect() == []


def test_long_records_are_joined_once(spark, monkeypatch):
    """A record far longer than a read is fetched by one more read, not by one read after the other."""
    monkeypatch.setattr(records, "READ_BYTES", 1000)
    docs = spark.createDataFrame([(1, "a b"), (2, "c " * 40_000), (3, "d"), (4, "")], "doc_id long, text string")
    files = write_records(docs, scratch_path(spark, "records"))
    assert sorted(r.n_tokens for r in read_records(files).collect()) == [1, 2, 3, 40_001]


def test_one_id_for_all_rows(spark):
    docs = spark.range(300).selectExpr("7L AS doc_id", "concat('w', id) AS text")
    rows = encode_to_records(docs).collect()
    assert len(rows) == 300 and {r.doc_id for r in rows} == {7} and len({r.start for r in rows}) == 300
