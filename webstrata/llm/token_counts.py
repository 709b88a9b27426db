"""Token counts of the sections of whole documents.

A document is encoded once, as a whole, with the character span of every token. The spans are then joined to the
sections by their bounds: a token inside one section counts there, and one that crosses a boundary is allocated by a
stated rule, so the sections' counts always add up to the document's.

Chunks of a blank and a word, which the vocabulary's word pattern never joins, are encoded once per worker with their
spans; a document's spans are those of its chunks, moved to their places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webstrata.llm.frames import name
from webstrata.llm.tokens import LONG_WORD, REMEMBERED_CHARS, per_worker, public_path, release, slices

VOCABULARY = "byte_bpe_50k.json"
#: Rules for a token over several sections: all to the section of its first or last character, all to the section
#: that holds most of its characters (the first of equals), or to each by its share of characters.
RULES = ("first", "last", "most", "share")
# White space as the vocabulary's pattern knows it (fixed values).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The pattern takes a word with one blank before it, and the rest of a run of white space as one piece. Letters of one
# script end where one of the marks below begins, so that words are remembered without the mark behind them.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(f" ?[{_LATIN}]+(?=[,.;:!?)]|[{_SPACE}]|\\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD = re.compile(f" ?[{_LATIN}]+").fullmatch


class SpanTokens:
    """Character spans of all tokens of a text, by a byte-level tokenizer whose words start with at most one blank.

    Chunks are encoded once and remembered, up to a number and to a number of characters. Long ones are encoded each time
    they occur: their numbers and spans lie behind all others and are written over by the next call.
    """

    def __init__(self, path: str, remembered: int = 400_000, chars: int = REMEMBERED_CHARS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text
        self.remembered, self.chars = remembered, chars
        spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._spelled = {ord(c): spelling.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x20, 0x250)) if _WORD(c) or c == " "}
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.first, self.count, self.size = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.spans, self.used, self.held = np.zeros((1 << 14, 2), np.int32), 0, 0

    def _word_spans(self, word: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the tokens of a chunk that is one word: its bytes are spelled and cut by the model alone."""
        ends = list(accumulate([len(token.value) for token in self.tokenizer.model.tokenize(word.translate(self._spelled))]))
        if len(word) == ends[-1]:
            return [0, *ends[:-1]], ends
        # Tokens end at bytes: a token begins and ends with the characters that hold its first and last byte.
        char = [i for i, c in enumerate(word) for _ in range(1 if c.isascii() else 2)]
        return [char[a] for a in (0, *ends[:-1])], [char[b - 1] + 1 for b in ends]

    def _learn(self, chunks: list[str]) -> None:
        """Number chunks and keep their spans."""
        words = [c for c in chunks if _WORD(c)]
        others = [c for c in chunks if not _WORD(c)]
        starts: list[int] = []
        ends: list[int] = []
        count: list[int] = []
        for word in words:
            first, last = self._word_spans(word)
            starts += first
            ends += last
            count.append(len(first))
        for code in self.tokenizer.encode_batch(others, add_special_tokens=False):
            spans = code.offsets
            starts += [a for a, _ in spans]
            ends += [b for _, b in spans]
            count.append(len(spans))
        n, at, used = len(words) + len(others), len(self.slot), self.used
        while at + n > len(self.first):
            self.first, self.count, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.size))
        while used + len(starts) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.slot.update(zip(chain(words, others), range(at, at + n)))
        self.count[at:at + n] = count
        self.first[at:at + n] = used + np.cumsum(self.count[at:at + n]) - self.count[at:at + n]
        self.size[at:at + n] = [len(c) for c in chain(words, others)]
        self.used = used + len(starts)
        self.spans[used:self.used, 0], self.spans[used:self.used, 1] = starts, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(spans, ends): start and end of every token in the characters of its text, and where each text's tokens end."""
        found = [_CHUNK.findall(text) for text in texts]
        chunks = list(chain.from_iterable(found))
        known = set(chunks)
        if len(self.slot) + len(known) > self.remembered or self.held > self.chars:
            self._forget()
        missing = known.difference(self.slot)
        short = [c for c in missing if len(c) <= LONG_WORD]
        long = [c for c in missing if len(c) > LONG_WORD]
        self._learn(short)
        self.held += sum(map(len, short))
        used = self.used
        self._learn(long)
        slots = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
        per_text = np.array([0, *accumulate(map(len, found))])
        sizes = self.size[slots]
        places = np.concatenate([[0], np.cumsum(sizes)])      # of chunks, over all texts
        starts = places[:-1] - np.repeat(places[per_text[:-1]], np.diff(per_text))
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        spans = self.spans[np.repeat(self.first[slots] - ends[:-1], count) + np.arange(ends[-1])] + np.repeat(starts, count)[:, None]
        for chunk in long:
            del self.slot[chunk]
        self.used = used
        return spans, ends[per_text]


def lines(text: str) -> list[int]:
    """Sections by line: where each ends. A line holds its line end; a text without characters is one empty section."""
    ends = list(accumulate(len(x) + 1 for x in text.split("\n")))
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends.pop()
    return ends


def attribute(spans: np.ndarray, ends: list[int], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, for sections that follow each other up to `ends`.

    A token without characters lies where it starts. Crossing tokens are counted in every section they touch.
    """
    bounds, n = np.asarray(ends, np.int64), len(ends)
    first = np.minimum(np.searchsorted(bounds, spans[:, 0], side="right"), n - 1)
    last = np.minimum(np.searchsorted(bounds, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right"), n - 1)
    over = np.flatnonzero(first != last)
    crossing = np.zeros(n, np.int64)
    if not len(over):
        return np.bincount(first, minlength=n).astype(float), crossing
    for i in over.tolist():
        crossing[first[i]:last[i] + 1] += 1
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    tokens = np.bincount(first[first == last], minlength=n).astype(float)
    begins = np.concatenate([[0], bounds[:-1]])
    for i in over.tolist():
        a, b = first[i], last[i] + 1
        held = np.minimum(bounds[a:b], spans[i, 1]) - np.maximum(begins[a:b], spans[i, 0])
        if rule == "most":
            tokens[a + int(np.argmax(held))] += 1
        else:
            tokens[a:b] += held / held.sum()
    return tokens, crossing


def token_counts(docs: DataFrame, vocabulary: str | None = None, sections: Callable[[str], list[int]] = lines,
                 rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, section, start, end, n_tokens, n_crossing, doc_tokens): one row for every section of every document.

    `sections` maps a text to the ends of its sections, ascending, the last at its end; default are lines. `n_tokens`
    is fractional under the rule `share` only. Null counts as empty, and an empty text has one empty section. Rows that
    share an id are documents of their own, told apart by `row`, which numbers the rows of `docs`. No row is shuffled.
    """
    assert rule in RULES, rule
    path = vocabulary or public_path(VOCABULARY)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("section", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "end")], T.StructField("n_tokens", T.DoubleType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_crossing", "doc_tokens")]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, done = per_worker(f"spans {path}", lambda: SpanTokens(path)), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, part in slices(batch.column(1)):
                texts = [t or "" for t in part.to_pylist()]
                spans, ends = tokens.encode(texts)
                rows, columns = [], [[] for _ in range(6)]
                for i, text in enumerate(texts):
                    bounds = sections(text)
                    own = spans[ends[i]:ends[i + 1]]
                    n, crossing = attribute(own, bounds, rule)
                    rows.append(np.full(len(bounds), first + i))
                    for column, values in zip(columns, (np.arange(len(bounds)), np.array([0, *bounds[:-1]]), np.array(bounds),
                                                        n, crossing, np.full(len(bounds), len(own)))):
                        column.append(values)
                arrays, places = [np.concatenate(c) for c in columns], np.concatenate(rows)
                arrays[0] = arrays[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(places + done)] + [pa.array(a) for a in arrays],
                                                 names=schema.names)
            done += batch.num_rows
        release()

    out = docs.select(name(id_col).alias("id"), name(text_col).alias("text")).mapInArrow(count, schema)
    return out.withColumnRenamed("id", id_col)
