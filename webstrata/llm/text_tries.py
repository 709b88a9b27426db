"""Equal texts by compressed tries over adaptive text prefixes.

Tasks first reduce the texts they read to entries, one for each different text that they remember, with the least id met.
Entries go to ranges of text prefixes. A prefix is as long as it has to be for the texts behind it to fit one trie: short
where texts differ early, longer where many texts begin alike. Behind one prefix, whole texts are inserted into a trie
whose edges hold runs of bytes and whose terminals hold the least id; walking it gives every entry the least id of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm.tokens import release, slices
from webstrata.session import cut

#: Bytes of different texts that a task remembers while it reads; longer texts become entries at once.
REMEMBERED_BYTES = 32 << 20
LONG_TEXT = 1 << 20
#: Bytes of texts in one trie. Beyond 2^18 tries they grow with the input, which bounds the crowded prefixes.
TRIE_BYTES = 1 << 20
MOST_TRIES = 18
#: Bytes of the shortest prefix, and what crowded ones are lengthened by.
FIRST_PREFIX, LONGER = 8, 4
#: Bytes an entry counts for besides its text.
ENTRY_BYTES = 64


class Trie:
    """A radix trie of byte strings. A node is [edge, children by first byte, least id, entries]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, None]

    def insert(self, text: bytes, entry: int, least: int | None) -> None:
        """Add an entry of a text with the least id it knows; null ids count for nothing."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None, None]
                node[1][text[at]] = child
                at = end
            elif text.startswith(child[0], at):
                at += len(child[0])
            else:
                shared = _shared(text, at, child[0])
                upper = [child[0][:shared], {child[0][shared]: child}, None, None]
                child[0] = child[0][shared:]
                node[1][text[at]] = upper
                child, at = upper, at + shared
            node = child
        if node[3] is None:
            node[3] = []
        node[3].append(entry)
        if least is not None and (node[2] is None or least < node[2]):
            node[2] = least

    def terminals(self) -> Iterator[tuple[list[int], int | None]]:
        """(entries, least id) of every text."""
        open_ = [self.root]
        while open_:
            node = open_.pop()
            open_.extend(node[1].values())
            if node[3] is not None:
                yield node[3], node[2]


def _shared(text: bytes, at: int, edge: bytes) -> int:
    """How many bytes of `edge` stand in `text` from `at` on, by halving: every byte is compared about twice."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text[at + low:at + middle] == edge[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def entries_of(rows: DataFrame, mask: Callable[[bytes], int], remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """Rows (id, part, text) as two kinds of rows, told apart by `text`.

    Members (entry, id, part, mask), one for every row, where `mask` is computed once per entry; and entries (entry, text,
    least). A task's memory is bounded by `remembered`: when it is full, what it holds is written and forgotten, so that
    a text may have several entries, also within a task.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        known: dict[bytes, list] = {}       # text -> [entry, mask, least id]
        held = 0

        def written(entries: list[tuple[bytes, list]], members: tuple = ((), (), (), ())) -> pa.RecordBatch:
            n, m = len(members[0]), len(entries)
            none = [None] * m
            return pa.RecordBatch.from_arrays([
                pa.array([*members[0], *(e[0] for _, e in entries)], pa.int64()), pa.array([*members[1], *none], pa.int64()),
                pa.array([*members[2], *none], pa.string()), pa.array([*members[3], *none], pa.int32()),
                pa.array([None] * n + [t for t, _ in entries], pa.binary()), pa.array([None] * n + [e[2] for _, e in entries], pa.int64())],
                names=["entry", "id", "part", "mask", "text", "least"])

        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in slices(batch.column(2)):
                members: tuple = ([], [], [], [])
                for i, text in enumerate(texts.to_pylist(), first):
                    entry = known.get(text)
                    if entry is None:
                        entry = [number, mask(text), ids[i]]
                        number += 1
                        if len(text) > LONG_TEXT:
                            yield written([(text, entry)])
                        else:
                            known[text] = entry
                            held += len(text) + ENTRY_BYTES
                    elif ids[i] is not None and (entry[2] is None or ids[i] < entry[2]):
                        entry[2] = ids[i]
                    for column, value in zip(members, (entry[0], ids[i], parts[i], entry[1])):
                        column.append(value)
                yield written([], members)
                if held > remembered:
                    yield written(list(known.items()))
                    known, held = {}, 0
        yield written(list(known.items()))
        known.clear()
        release()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return rows.select("id", "part", text.alias("text")).mapInArrow(
        reduce, "entry bigint, id bigint, part string, mask int, text binary, least bigint")


def _head(length: Column) -> Column:
    return F.substring(F.col("text"), F.lit(1), length)


def with_prefix(entries: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """`entries` with `prefix`, the beginning of the text that names its trie.

    All entries are counted by their first bytes; prefixes with too much behind them are lengthened and counted again,
    until nothing is crowded or a prefix holds whole texts, whose copies a trie stores once. Crowded prefixes are known
    by their hash: at most 2^18 numbers per length, since each has at least that share of all bytes behind it. Equal
    texts always get the same prefix.
    """
    size = F.length("text") + ENTRY_BYTES
    total = entries.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    limit = max(trie_bytes, total >> MOST_TRIES)
    placed, open_, length = [], entries, FIRST_PREFIX
    while True:
        head = _head(F.lit(length))
        crowded = cut(open_.groupBy(F.xxhash64(head).alias("_head")).agg(
            F.sum(size.cast("bigint")).alias("bytes"), F.max(F.length("text")).alias("longest"))
            .where((F.col("bytes") > limit) & (F.col("longest") > length)).select("_head"))
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*placed, open_.withColumn("prefix", head)])
        meets = F.xxhash64(head) == F.col("_head")
        placed.append(open_.join(F.broadcast(crowded), meets, "left_anti").withColumn("prefix", head))
        # Only entries behind crowded prefixes are written again.
        open_ = cut(open_.join(F.broadcast(crowded), meets, "left_semi"))
        length *= LONGER


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, least id of its text), with one trie at a time: rows come sorted by prefix."""
    trie, prefix = Trie(), None

    def walked() -> Iterator[pa.RecordBatch]:
        entries, least = [], []
        for own, low in trie.terminals():
            entries += own
            least += [low] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(least, pa.int64())], names=["entry", "least"])

    for batch in batches:
        prefixes, entries, lows = (batch.column(c).to_pylist() for c in (0, 1, 3))
        for first, texts in slices(batch.column(2)):
            for i, text in enumerate(texts.to_pylist(), first):
                if prefixes[i] != prefix:
                    yield from walked()
                    trie, prefix = Trie(), prefixes[i]
                trie.insert(text, entries[i], lows[i])
    yield from walked()
    release()


def least_ids(entries: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(entry, least): the least id of all entries with the same text."""
    placed = with_prefix(entries, trie_bytes).select("prefix", "entry", "text", "least")
    return placed.repartitionByRange("prefix").sortWithinPartitions("prefix").mapInArrow(_tries, "entry bigint, least bigint")


def repeated_flags(rows: DataFrame, mask: Callable[[bytes], int], trie_bytes: int = TRIE_BYTES, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """(id, part, mask, repeated) of all rows (id, part, text): whether a smaller id has the identical text.

    Null texts count as empty. Rows that share the smallest id of a text are no copies of each other; a null id is
    neither a copy nor an original.
    """
    both = cut(entries_of(rows, mask, remembered))
    least = cut(least_ids(both.where("text is not null").select("entry", "text", "least"), trie_bytes))
    members = both.where("text is null").select("entry", "id", "part", "mask")
    return members.join(least, "entry").select("id", "part", "mask", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("repeated"))
