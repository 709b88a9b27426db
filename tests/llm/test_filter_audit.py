import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from webstrata.llm.filter_audit import filter_audit, text_mask
from webstrata.llm.text_tries import Trie, least_ids, repeated_flags, with_prefix
from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_fails(text, smaller):
    words = WORD.findall(text)
    return {x for x, fail in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                                           100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text), smaller)) if fail}


def plain(docs, labels):
    """All rows by applying the filters in every order, document by document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = [(part or "", plain_fails(text or "", i is not None and i > least[text or ""]), *labels.get(i, (0, 0))) for i, text, part in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(x in r[1] for r in own) - len(removed), sum(r[1] == {x} for r in own),
                                          sum(r[2] == 1 for r in removed), sum(r[3] == 1 for r in removed)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def audited(docs, labels, **options):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in filter_audit(docs, labels, **options).collect()}


def texts():
    base = prose(3, 60)
    return [None, "", base, base, base.upper(), base + " $", "a " * 49, "a " * 50, prose(4, 49), prose(4, 50), "É" * 95 + "ABCDE", "É" * 94 + "ABCDE",
            "x" * 300_000, "one two\x1cthree", "\u00a0".join("abcdefg" * 10), base, prose(5, 20_000), prose(5, 20_000), "#", "A B C|", base + "é", base[:-1]]


@pytest.mark.parametrize("options", [{}, {"trie_bytes": 200}, {"remembered": 0}])
def test_audit_equals_applying_the_filters(spark, options):
    docs = [(None if n == 7 else 100 - 3 * (n % 20), t, [None, "web", "src", ""][n % 4]) for n, t in enumerate(texts() * 3)]
    labels = {100 - 3 * n: (n % 2, n % 3 == 0) for n in range(0, 20, 2)}
    rows = [(i, t, p, 1, "m") for i, t, p in docs]
    told = [(i, int(q), int(t)) for i, (q, t) in labels.items()] + [(100, 0, 0), (None, 1, 1), (4711, 1, 1)]
    got = audited(spark.createDataFrame(rows, "doc_id long, text string, source string, mask int, part string").repartition(3),
                  spark.createDataFrame(told, "doc_id long, quality int, toxic int"), **options)
    want = plain(docs, {i: (int(q), int(t)) for i, (q, t) in labels.items()})
    assert len(got) == 3 * 600 and got == want


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", "s")], docs.schema)
    rows = audited(one, labels)
    assert len(rows) == 600 and rows["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_masks_of_odd_texts(odd_texts):
    for t in [*odd_texts, *texts()]:
        assert text_mask((t or "").encode()) == sum(1 << "ABCD".index(x) for x in plain_fails(t or "", False))


def test_trie_holds_every_text():
    words = ["", "a", "ab", "abc", "abd", "b", "ba", "abcabc", "é", "è", "a" * 1000, "a" * 999 + "b", "a" * 998]
    trie, want = Trie(), defaultdict(list)
    for n, w in enumerate(words * 3 + words[::-1]):
        trie.insert(w.encode(), n, None if n % 5 == 0 else 1000 - n)
        want[w].append(n)
    got = sorted((sorted(own), low) for own, low in trie.terminals())
    assert got == sorted((own, min((1000 - n for n in own if n % 5), default=None)) for own in want.values())


def test_nested_prefixes_are_inserted_in_linear_time():
    trie = Trie()
    for n in range(3000):
        trie.insert(b"x" * (n + 1), n, n)
    assert sum(1 for _ in trie.terminals()) == 3000


def test_prefixes_grow_where_texts_begin_alike(spark):
    """A shared beginning gets longer prefixes, other texts keep short ones, and equal texts never part."""
    shared = "the same beginning of very many texts, " * 10
    rows = [(n, shared + f"{n % 100} and on", n) for n in range(400)] + [(1000 + n, f"{n}: another", n) for n in range(50)]
    df = with_prefix(spark.createDataFrame([(e, t.encode(), i) for e, t, i in rows], "entry long, text binary, least long"), 20_000)
    got = df.collect()
    assert len(got) == 450
    by_text = defaultdict(set)
    for r in got:
        assert bytes(r.text).startswith(bytes(r.prefix))
        by_text[bytes(r.text)].add(bytes(r.prefix))
    assert all(len(p) == 1 for p in by_text.values())
    assert max(len(r.prefix) for r in got if r.entry < 1000) > 100 and max(len(r.prefix) for r in got if r.entry >= 1000) <= 8


def test_tries_give_every_entry_the_least_id(spark):
    rows = [(n, f"text {n * n % 77}".encode(), None if n % 9 == 0 else (n * 31) % 997) for n in range(500)]
    want = defaultdict(list)
    for _, t, i in rows:
        if i is not None:
            want[t].append(i)
    got = {r.entry: r.least for r in least_ids(spark.createDataFrame(rows, "entry long, text binary, least long"), 500).collect()}
    assert got == {e: min(want[t], default=None) for e, t, _ in rows}


def test_flags_of_repeated_ids(spark):
    rows = [(1, "s", "a"), (1, "s", "a"), (2, "s", "a"), (None, "s", "a"), (None, "s", "b"), (3, "s", "b")]
    got = sorted((r.id or 0, r.repeated) for r in repeated_flags(spark.createDataFrame(rows, "id long, part string, text string"), text_mask).collect())
    assert got == [(0, False), (0, False), (1, False), (1, False), (2, True), (3, False)]
