"""Token ids as length-delimited binary records.

Each sequence is one record: its length as a little-endian 64-bit number, the masked CRC-32C of that length, the data
and the masked CRC-32C of the data. This is the common record framing, so other readers can check and read the files.
The data are the ids as little-endian 16-bit numbers if the vocabulary allows, else 32-bit. Beside each file lies a
Parquet index of (id, offset, n_tokens), by which a reader can fetch records in any order.

Files follow ascending ids: rows are range-partitioned and sorted by id, and each task writes one file.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.frames import name
from webstrata.llm.shared_files import filesystem, written
from webstrata.llm.tokens import public_path, slices, word_tokens
from webstrata.session import cut, scratch_path

VOCABULARY = "word_bpe_49k.json"
END = 2
#: The polynomial of CRC-32C, reflected, and the constant added to masked checksums (fixed values).
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_BLOCK = 256
HEADER, FOOTER = 12, 4
READ_BYTES = 4 << 20


@functools.cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables for four bytes at a time, and for moving a checksum past one block of zeros."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
    four = [byte]
    for _ in range(3):
        four.append(byte[four[-1] & 255] ^ (four[-1] >> 8))
    moved = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        moved = byte[moved & 255] ^ (moved >> 8)
    return np.stack(four), moved.reshape(4, 256)


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many pieces of a byte array at once.

    Pieces are padded with zeros in front, which leave a checksum that starts at zero unchanged; the usual start value
    is laid over the first four bytes instead. All blocks are then summed side by side and joined per piece.
    """
    four, moved = _crc_tables()
    lengths = np.asarray(lengths, np.int64)
    short = lengths < 4
    blocks = -(-np.maximum(lengths, 4) // _BLOCK)
    last = np.cumsum(blocks)
    padded = np.zeros(int(last[-1]) * _BLOCK if len(last) else 0, np.uint8)
    begins = last * _BLOCK - lengths
    for start, length, begin in zip(np.asarray(starts).tolist(), lengths.tolist(), begins.tolist()):
        if length >= 4:
            padded[begin:begin + length] = data[start:start + length]
            padded[begin:begin + 4] ^= 255
    side = np.ascontiguousarray(padded.view("<u4").reshape(-1, _BLOCK // 4).T)
    crc = np.zeros(side.shape[1], np.uint32)
    for row in side:
        crc ^= row
        crc = four[3][crc & 255] ^ four[2][(crc >> 8) & 255] ^ four[1][(crc >> 16) & 255] ^ four[0][crc >> 24]
    first, out = last - blocks, np.zeros(len(lengths), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    pending = blocks[order]
    for k in range(int(pending[0]) if len(pending) else 0):
        mine = order[:np.searchsorted(-pending, -k, side="left")]
        now = out[mine]
        out[mine] = (moved[0][now & 255] ^ moved[1][(now >> 8) & 255] ^ moved[2][(now >> 16) & 255]
                     ^ moved[3][now >> 24] ^ crc[first[mine] + k])
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(short).tolist():        # too short for the start value
        value = np.uint32(0xFFFFFFFF)
        for x in data[starts[i]:starts[i] + lengths[i]].tolist():
            value = four[0][(int(value) ^ x) & 255] ^ (value >> np.uint32(8))
        out[i] = value ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frame(data: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(framed records, offset of each record): the pieces of a byte array between consecutive `ends`."""
    lengths = np.diff(ends)
    sizes = lengths.astype("<u8").view(np.uint8)
    n = len(lengths)
    of_size = masked(crc32c(sizes, np.arange(n) * 8, np.full(n, 8)))
    of_data = masked(crc32c(data, ends[:-1], lengths))
    out, offsets = bytearray(), np.concatenate([[0], np.cumsum(lengths + HEADER + FOOTER)])
    raw = memoryview(np.ascontiguousarray(data))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        out += sizes[8 * i:8 * i + 8].tobytes() + of_size[i].tobytes() + raw[a:b] + of_data[i].tobytes()
    return bytes(out), offsets[:-1]


def unframe(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts, lengths, bytes used) of the whole records at the front of `data`, after checking every checksum."""
    buffer, starts, lengths, at = np.frombuffer(data, np.uint8), [], [], 0
    while at + HEADER <= len(buffer):
        length = int.from_bytes(data[at:at + 8], "little")
        if at + HEADER + length + FOOTER > len(buffer):
            # An unfinished record; a damaged length must not pass for one.
            if masked(crc32c(buffer, np.array([at]), np.array([8])))[0] != int.from_bytes(data[at + 8:at + HEADER], "little"):
                raise ValueError("a record's length is damaged")
            break
        starts.append(at + HEADER)
        lengths.append(length)
        at += HEADER + length + FOOTER
    starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)

    def stated(places: np.ndarray) -> np.ndarray:
        return buffer[places[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(places) else np.zeros(0, np.uint32)
    if not np.array_equal(masked(crc32c(buffer, starts - HEADER, np.full(len(starts), 8))), stated(starts - FOOTER)):
        raise ValueError("a record's length is damaged")
    if not np.array_equal(masked(crc32c(buffer, starts, lengths)), stated(starts + lengths)):
        raise ValueError("a record's data are damaged")
    return starts, lengths, at


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Write the ids of all texts, each followed by `end`, in ascending order of id; return one row per file.

    (part, path, index_path, docs, tokens, width). Null and empty texts are the end alone; null ids come first; rows
    that share an id follow each other, spread over files if they are many. A task that is repeated writes its file anew
    under the same name, and a file gets its name only once it is complete. An empty table gives no files.
    """
    path = vocabulary or public_path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens = TaskContext.get(), word_tokens(path)
        part, kind = task.partitionId(), np.dtype("<u2" if max(tokens.vocabulary, end + 1) <= 1 << 16 else "<u4")
        file, size, total, index = f"{folder}/ids-{part:06d}.rec", 0, 0, []
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        with written(file, task.taskAttemptId()) as stream:
            while batch is not None:
                for first, texts in slices(batch.column(1)):
                    ids, ends = tokens.encode(texts)
                    ids, ends = np.insert(ids, ends[1:], end), ends + np.arange(len(ends))
                    data, offsets = frame(ids.astype(kind).view(np.uint8), ends * kind.itemsize)
                    stream.write(data)
                    index.append(pa.table({"id": batch.column(0).slice(first, len(texts)), "offset": offsets + size,
                                           "n_tokens": np.diff(ends)}))
                    size, total = size + len(data), total + len(ids)
                batch = next(batches, None)
        index = pa.concat_tables(index)
        with written(f"{file}.index", task.taskAttemptId()) as stream:
            pq.write_table(index, stream)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": file, "index_path": f"{file}.index", "docs": len(index),
                                           "tokens": total, "width": kind.itemsize}], schema=made)

    made = pa.schema([("part", pa.int64()), ("path", pa.string()), ("index_path", pa.string()), ("docs", pa.int64()),
                      ("tokens", pa.int64()), ("width", pa.int64())])
    rows = docs.select(name(id_col).alias("id"), name(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    # The row number only parts rows of one id, so that a frequent id fills no file alone.
    ordered = rows.repartitionByRange("id", "rid").sortWithinPartitions("id", "rid").drop("rid")
    return cut(ordered.mapInArrow(write, "part long, path string, index_path string, docs long, tokens long, width long"))


def read_records(files: DataFrame, id_type: T.DataType | str = "bigint", with_ids: bool = False) -> DataFrame:
    """Read the files back, checking every record: (id, start, n_tokens, ids_crc32), and `ids` on request.

    `start` counts the ids of all records before; `ids_crc32` is the CRC-32 of the ids as little-endian 32-bit numbers.
    """
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    located = files.withColumn("before", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    fields = [T.StructField("id", T._parse_datatype_string(id_type) if isinstance(id_type, str) else id_type)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            files_, path = filesystem(row["path"])
            index = pq.read_table(files_.open_input_file(filesystem(row["index_path"])[1]))
            keys, kind = index.column("id").combine_chunks(), np.dtype(f"<u{row['width']}")
            start, seen, rest, want = row["before"], 0, b"", READ_BYTES
            with files_.open_input_stream(path, compression=None) as stream:
                while more := stream.read(want):
                    data = rest + more
                    starts, lengths, used = unframe(data)
                    rest = data[used:]
                    # A long record is read to its end at once, and so joined once.
                    whole = HEADER + int.from_bytes(rest[:8], "little") + FOOTER if len(rest) >= 8 else 0
                    want = max(READ_BYTES, whole - len(rest))
                    if not len(starts):
                        continue
                    ids = [np.frombuffer(data, kind, n // kind.itemsize, at) for at, n in zip(starts.tolist(), lengths.tolist())]
                    counts = lengths // kind.itemsize
                    columns = [keys.slice(seen, len(ids)), pa.array(start + np.cumsum(counts) - counts), pa.array(counts),
                               pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
                    start, seen = start + int(counts.sum()), seen + len(ids)
            if rest or seen != row["docs"]:
                raise ValueError(f"{path}: {seen} of {row['docs']} records, {len(rest)} bytes left")

    n = max(1, files.count())
    return located.repartition(n, "part").mapInArrow(read, T.StructType(fields))


def read_shuffled(files: DataFrame, seed: int, id_type: T.DataType | str = "bigint") -> DataFrame:
    """(place, id, ids) in an order that `seed` decides: the indexes are shuffled, and each record is fetched by offset.

    Only the narrow index rows are ordered anew; tasks open the few files their rows lie in and seek.
    """
    kind = T._parse_datatype_string(id_type) if isinstance(id_type, str) else id_type
    keys = [T.StructField("id", kind)]
    places = [T.StructField("path", T.StringType()), T.StructField("width", T.LongType()),
              T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            table = pq.read_table(filesystem(row["index_path"])[0].open_input_file(filesystem(row["index_path"])[1]))
            for b in table.to_batches():
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([row["path"]] * b.num_rows), pa.array([row["width"]] * b.num_rows, pa.int64()),
                                                  b.column("offset"), b.column("n_tokens")], names=["id", "path", "width", "offset", "n_tokens"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for b in batches:
            ids = []
            for row in b.select(["path", "width", "offset", "n_tokens"]).to_pylist():
                if row["path"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    files_, path = filesystem(row["path"])
                    opened[row["path"]] = files_.open_input_file(path)
                size = row["width"] * row["n_tokens"] + HEADER + FOOTER
                data = opened[row["path"]].read_at(size, row["offset"])
                (at,), (n,), _ = unframe(data)
                ids.append(np.frombuffer(data, f"<u{row['width']}", n // row["width"], at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["place", "id", "ids"])

    index = cut(files.repartition(max(1, files.count()), "part").mapInArrow(entries, T.StructType(keys + places)))
    mixed = index.withColumn("place", F.xxhash64(F.lit(seed), "path", "offset")).repartitionByRange("place").sortWithinPartitions("place")
    return mixed.mapInArrow(fetch, T.StructType([T.StructField("place", T.LongType()), *keys, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_to_records(docs: DataFrame, vocabulary: str | None = None, end: int = END, id_col: str = "doc_id",
                      text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the record files below `folder` (default: a fresh one in the shared folder) and read them back."""
    files = write_records(docs, folder or scratch_path(docs.sparkSession, "records"), vocabulary, end, id_col, text_col)
    return read_records(files, docs.schema[id_col].dataType).withColumnRenamed("id", id_col)
