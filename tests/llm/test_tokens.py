import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webstrata.llm.token_counts import RULES, SpanTokens, VOCABULARY, attribute, lines, token_counts
from webstrata.llm.tokens import WordTokens, public_path

WORD_FILE = public_path("word_bpe_49k.json")
WORDS, PLAIN = WordTokens(WORD_FILE, remembered=50), Tokenizer.from_file(WORD_FILE)
SPANS, SPELLED = SpanTokens(public_path(VOCABULARY), remembered=40), Tokenizer.from_file(public_path(VOCABULARY))
SPELLED.encode_special_tokens = True
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("aAbéÉñ .,;!?'\n\t\r\x0b\x1c\x85\xa0 　s1９²-_<|>ßΣσςİıﬁ́̊̌̇JjTÅK")),
                                  st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    ids, ends = WORDS.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_every_letter_before_every_mark():
    """All letters up to U+024F, of which some change in lower case, before the marks that end words and others."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"{before}{letter}{mark}{after}" for letter in letters for mark in ",.;:!?'-" for before, after in (("", ""), ("x", "y"), ("x ", " y"))]
    texts += ["BU KARAR İPTAL EDİLDİ.", "TÜRKİYE'Yİ, GEZDİ!", "İ.x", "DİYARBAKIR; İZMİR: EVİ?"]
    ids, ends = WORDS.encode(pa.array(texts))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == PLAIN.encode(text, add_special_tokens=False).ids, text


WORDS_ABOVE = ["x" * 100, "https://example.org/" + "path/" * 30, "東京" * 60, "É" * 81, "İ" * 90 + "."]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.one_of(st.sampled_from(WORDS_ABOVE), TEXT), max_size=5).map(" ".join), min_size=1, max_size=3), min_size=2, max_size=4))
def test_long_words_are_not_remembered(calls):
    """What a call learns stays right in later calls, and memory is bounded by words and by characters."""
    words = WordTokens(WORD_FILE, remembered=60, chars=500)
    for texts in [["aa " + WORDS_ABOVE[0] + " zz"], ["bb zz", "aa cc"], *calls]:
        ids, ends = words.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[ends[i]:ends[i + 1]].tolist() == PLAIN.encode(text, add_special_tokens=False).ids
        assert not any(len(w) > 80 for w in words.slot) and sorted(words.slot.values()) == list(range(len(words.slot)))
        assert words.held == sum(map(len, words.slot))


def test_unspaced_paragraphs_take_no_memory():
    words = WordTokens(WORD_FILE)
    for n in range(20):
        words.encode(pa.array([("abcdefghij" * 50) + str(n * 100 + k) for k in range(100)]))
    assert words.held < 1000 and len(words.ids) < 1 << 20


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_spans_are_those_of_the_whole_text(texts):
    spans, ends = SPANS.encode(texts)
    for i, text in enumerate(texts):
        assert [tuple(s) for s in spans[ends[i]:ends[i + 1]].tolist()] == SPELLED.encode(text, add_special_tokens=False).offsets


LONG = ["x" * 100, "https://example.org/" + "path/" * 30, "QUJD" * 40, "東京" * 60, " " * 90, "\n" * 120]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.one_of(st.sampled_from(LONG), TEXT), max_size=5).map(" ".join), min_size=1, max_size=3), min_size=2, max_size=4))
def test_long_chunks_leave_the_numbers_of_others(calls):
    """What a call learns stays right in later calls, though chunks above LONG_WORD are not kept."""
    spans = SpanTokens(public_path(VOCABULARY), remembered=60)
    for texts in [["antidisestablishmentarianism " + LONG[0] + " zz"], ["bb zz", "antidisestablishmentarianism cc"], *calls]:
        found, ends = spans.encode(texts)
        for i, text in enumerate(texts):
            assert [tuple(s) for s in found[ends[i]:ends[i + 1]].tolist()] == SPELLED.encode(text, add_special_tokens=False).offsets
        assert not any(len(c) > 80 for c in spans.slot) and sorted(spans.slot.values()) == list(range(len(spans.slot)))


def test_rules():
    spans, ends = np.array([(0, 3), (3, 6), (6, 6), (6, 12)]), [4, 7, 12]
    assert attribute(spans, ends, "first")[0].tolist() == [2, 2, 0]
    assert attribute(spans, ends, "last")[0].tolist() == [1, 2, 1]
    assert attribute(spans, ends, "most")[0].tolist() == [1, 2, 1]
    assert np.allclose(attribute(spans, ends, "share")[0], [1 + 1 / 3, 2 / 3 + 1 + 1 / 6, 5 / 6])
    assert attribute(spans, ends, "most")[1].tolist() == [1, 2, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=12))
def test_attribution_equals_the_plain_form(ends, spans):
    """Every rule on random sections and spans, character by character."""
    ends = sorted(ends)
    n, total = len(ends), ends[-1]
    spans = sorted((min(a, total), min(a + size, total)) for a, size in spans)
    begins = [0, *ends[:-1]]

    def section(char):
        return next((s for s in range(n) if begins[s] <= char < ends[s]), n - 1)
    for rule in RULES:
        tokens, crossing = [0.0] * n, [0] * n
        for a, b in spans:
            held = {}
            for char in range(a, b):
                held[section(char)] = held.get(section(char), 0) + 1
            own = sorted(held) or [section(a)]
            if len(own) == 1:
                tokens[own[0]] += 1
                continue
            for s in range(own[0], own[-1] + 1):
                crossing[s] += 1
            if rule == "share":
                for s in own:
                    tokens[s] += held[s] / (b - a)
            else:
                tokens[{"first": own[0], "last": own[-1], "most": max(own, key=lambda s: (held[s], -s))}[rule]] += 1
        found = attribute(np.array(spans, np.int64).reshape(-1, 2), ends, rule)
        assert np.allclose(found[0], tokens) and found[1].tolist() == crossing


def test_words_of_one_script_are_those_of_the_whole_text():
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"{before}{letter}{mark}{after}" for letter in letters for mark in (*",.;:!?)'-(1_", "\u0301") for before, after in (("", ""), (" x", "y"), ("é", " é"))]
    texts += [letter * 3 + " " + letter + "e" for letter in letters]
    spans, ends = SPANS.encode(texts)
    for text, a, b in zip(texts, ends, ends[1:]):
        assert [tuple(s) for s in spans[a:b].tolist()] == SPELLED.encode(text, add_special_tokens=False).offsets, text


def test_lines():
    assert lines("") == [0] and lines("a") == [1] and lines("a\n") == [2] and lines("a\nbc") == [2, 4] and lines("\n\n") == [1, 2]


def test_sections_add_up(spark, sf, odd, odd_texts, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for rule in ("first", "most", "share"):
        found = {}
        for r in token_counts(docs, rule=rule).collect():
            found.setdefault(r.doc_id, []).append(r)
        assert set(found) == set(texts)
        for key, rows in found.items():
            rows.sort(key=lambda r: r.section)
            offsets = SPELLED.encode(texts[key], add_special_tokens=False).offsets
            assert rows[0].doc_tokens == len(offsets) and abs(sum(r.n_tokens for r in rows) - len(offsets)) < 1e-6
            assert [r.end for r in rows] == lines(texts[key]) and [r.start for r in rows] == [0, *[r.end for r in rows[:-1]]]
            if rule == "first":
                for r in rows:
                    last = r.section == len(rows) - 1
                    assert r.n_tokens == sum(r.start <= a and (a < r.end or last) for a, _ in offsets)
    rows = token_counts(odd).collect()
    assert len(rows) == sum(len(lines(t or "")) for t in odd_texts)
    assert len({r.row for r in rows}) == len(odd_texts) and len({(r.row, r.section) for r in rows}) == len(rows)
    assert token_counts(nothing).collect() == []
