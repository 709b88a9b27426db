import hashlib
import re
import string

import pytest

from webstrata.llm.decontamination import contamination
from .conftest import prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    """Every window of every item at every place of every document."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        yield len(w), len(hit), len(listed.split(",")) if listed else 0, hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def result(spark, docs, items, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = sorted(contamination(df, bench, **more).collect())
    return [tuple(r)[1:] for r in rows]


def cases():
    a, b = prose(11, 40), prose(12, 25)
    items = [(1, a), (2, b), (3, " ".join(a.split()[5:20])), (4, "Only Four short words"), (5, "single"), (6, None), (7, ""), (None, prose(13, 15)),
             (10, "ab ab ab ab ab ab ab ab ab ab ab ab ab"), (10, b)]
    docs = [None, "", "...", a, prose(14, 50) + " " + a.upper() + " " + prose(15, 9), " ".join(a.split()[3:12]), " ".join(a.split()[3:13]),
            "x only four short WORDS y only-four.short words", "single", prose(13, 15), "ab " * 40, "ab " * 9, f"{a} {b} {a}",
            ", ".join(b.split()), prose(16, 2000) + " " + b + " " + prose(17, 3000), "é " + a.replace(" ", " . ")]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"filter_words": 1}, {"window": 4}, {"window": 13}])
def test_against_all_windows(spark, more):
    docs, items = cases()
    assert result(spark, docs, items, **more) == list(plain(docs, items, more.get("window", 10)))


def test_odd_rows_and_empty_tables(spark, odd, odd_texts, nothing):
    items = spark.createDataFrame([(1, prose(2, 300))], "item_id long, text string")
    rows = contamination(odd, items).collect()
    assert len(rows) == len(odd_texts) and sum(r.contaminated for r in rows) == 4
    none = contamination(odd, items.limit(0)).collect()
    assert len(none) == len(odd_texts) and not any(r.n_hit for r in none)
    assert sorted(r.n_words for r in none) == sorted(len(words(t)) for t in odd_texts)
    assert contamination(nothing, items).collect() == []


def test_native(spark, sf):
    out = contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
