"""Token ids of whole texts, with every distinct word encoded once per worker.

The tokenizers are read from public files, whose path is a parameter, and never trained here.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; words that a worker remembers, and their characters at most: with ids
#: and tables about 100 MB.
SLICE_CHARS = 1_000_000
REMEMBERED = 400_000
REMEMBERED_CHARS = 8_000_000
#: Longer words are encoded each time they occur.
LONG_WORD = 80
#: Rows that cross to Python at a time while whole texts are encoded.
BATCH_ROWS = 1000

#: The one normalisation and word pattern for which white space and the splits below are known to be safe (fixed values).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# A letter followed by punctuation always ends a word of that pattern. İ is no such letter: in lower case it ends in a
# mark, which the pattern joins with punctuation.
_WORD_END = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([,.;:!?])"
# One word of the pattern that normalisation leaves as it is.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def release() -> None:
    """Give freed memory back to the system, so that a process that waits for its next stage is small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def per_worker(key: str, make):
    """An object that stays in the Python worker, so that later tasks find what earlier ones learned.

    Only the object asked for last is kept: a job of several stages holds the memory of one of them.
    """
    memory = sys.modules.setdefault("_webstrata_memory", types.ModuleType("_webstrata_memory"))
    if getattr(memory, "key", None) != key:
        memory.key, memory.held = None, None
        release()
        memory.held, memory.key = make(), key
    return memory.held


def slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part): parts of about `chars` bytes, or single longer texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else []
    first = 0
    while first < len(texts):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + chars, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


class WordTokens:
    """The ids of a tokenizer that drops white space and knows no case.

    Words between blanks and line ends never share a token, so the ids of a text are those of its words in turn. Words
    are told apart by Arrow; only those a worker has not met are given to the tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, chars: int = REMEMBERED_CHARS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        splits = stated["pre_tokenizer"].get("pretokenizers", [{}])
        if [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])] != _NORMALIZERS \
                or splits[0].get("pattern") != {"Regex": _PATTERN} or splits[0].get("behavior") != "Removed":
            raise ValueError(f"{path}: words of this tokenizer cannot be encoded one by one")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.remembered, self.chars = remembered, chars
        spelling = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._spelled = {c: spelling.pre_tokenize_str(chr(c))[0][0] for c in range(0x61, 0x100) if _PLAIN(chr(c))}
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used, self.held = np.zeros(1 << 14, np.uint32), 0, 0

    def _encode_word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [token.id for token in self.tokenizer.model.tokenize(word.lower())]
        if _PLAIN(word):
            return [token.id for token in self.tokenizer.model.tokenize(word.translate(self._spelled))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Number words and keep their ids."""
        ids: list[int] = []
        count: list[int] = []
        for word in words:
            own = self._encode_word(word)
            ids += own
            count.append(len(own))
        n, at, used = len(words), len(self.slot), self.used
        while at + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.slot.update(zip(words, range(at, at + n)))
        self.count[at:at + n] = count
        self.first[at:at + n] = used + np.cumsum(self.count[at:at + n]) - self.count[at:at + n]
        self.ids[used:used + len(ids)] = ids
        self.used = used + len(ids)

    def _slots(self, words: list[str]) -> np.ndarray:
        """The numbers of different words. Long ones get numbers behind all others, good until the next call."""
        if len(self.slot) + len(words) > self.remembered or self.held > self.chars:
            self._forget()
        new = [word for word in words if word not in self.slot]
        short, long = [w for w in new if len(w) <= LONG_WORD], [w for w in new if len(w) > LONG_WORD]
        self._learn(short)
        self.held += sum(map(len, short))
        used = self.used
        self._learn(long)
        out = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        for word in long:
            del self.slot[word]
        self.used = used        # the next call writes over the ids of long words
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all ids in a row as uint32, and where each text's ids start and end. Null counts as empty."""
        words = pc.replace_substring_regex(pc.fill_null(texts, ""), _WORD_END, r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(words, "\n", " "), " ")
        told = words.flatten().dictionary_encode()
        slots = self._slots(told.dictionary.to_pylist())[told.indices.to_numpy()]
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[slots] - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[words.offsets.to_numpy()]


def word_tokens(path: str) -> WordTokens:
    return per_worker(f"words {path}", lambda: WordTokens(path))


@contextlib.contextmanager
def small_batches(spark, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While whole texts are encoded, fewer of them cross to Python at a time, which keeps tasks small on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def public_path(file: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(file)
