import hashlib
import string
from collections import defaultdict

from webstrata.llm.exact_dedup import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_groups_of_odd_rows(odd, odd_texts):
    rows = exact_dedup(odd).collect()
    assert len(rows) == len(odd_texts)
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()].append(r.doc_id)
    for r in rows:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_other_columns_are_carried(odd):
    out = exact_dedup(odd)
    assert {"row", "rid", "key", "score", "lang"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert sorted(r.row for r in out.collect()) == sorted(r.row for r in odd.collect())


def test_a_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "A b")] * 50 + [(1, "a B")] * 3 + [(0, "a b")], "doc_id long, text string")
    rows = exact_dedup(df).collect()
    assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {54} and {r.keep_id for r in rows} == {1}


def test_a_full_filter_changes_nothing(odd):
    key = lambda r: (str(r.text_sha256), str(r.row))
    wide, narrow = ({key(r): (r.keep_id, r.group_size) for r in exact_dedup(odd, words=w).collect()} for w in (1 << 22, 1))
    assert wide == narrow


def test_only_possible_repeats_are_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = exact_dedup(docs, carry=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(nothing):
    assert exact_dedup(nothing).collect() == []
