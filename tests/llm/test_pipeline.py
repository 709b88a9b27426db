"""The pipeline against its stages done plainly, one after the other, on the driver."""

import corpus_pipeline
from webstrata.llm import toxicity

from . import test_decontamination as leaks
from . import test_exact_dedup as copies
from . import test_jaccard as near
from . import test_packing as packing


def test_stages(spark, sf):
    docs, labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in toxicity.score(docs, model).where(~toxicity.rejected(model)).collect()]
    last = {}
    for key, text in rows:
        same = (text or "").translate(copies.LOWER)
        last[same] = max(last.get(same, key), key)
    rows = [(k, t) for k, t in rows if last[(t or "").translate(copies.LOWER)] == k]
    least = {k: c for k, _, c in near.plain(rows)}
    rows = [(k, t) for k, t in rows if least[k] == k]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [r for r, found in zip(rows, leaks.plain([t for _, t in rows], items)) if not found[4]]
    ids = dict(zip([k for k, _ in rows], packing.ids_of([t for _, t in rows], 0)))
    assert 0 < len(ids) < docs.count()
    packing.check(corpus_pipeline.run(spark, sf).collect(), ids, 2048)


def test_stages_keep_columns(spark, odd, sf):
    df = odd
    for label, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == odd.columns and df.schema.simpleString() == odd.schema.simpleString(), label
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() > 0


def test_stages_take_an_empty_table(spark, nothing, sf):
    df = nothing
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        assert df.count() == 0


def test_near_stage_keeps_one_of_each_class(spark, sf):
    rows = near.near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, df, sf).collect())
    assert kept == sorted({c for _, _, c in near.plain(rows)})


def test_near_stage_keeps_one_of_a_class_whose_ids_repeat(spark, sf):
    base = near.prose(40, 300)
    texts = [base, base + " end", "other " + base, near.prose(41, 50)]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[2]), (5, texts[3]), (None, near.prose(42, 80)), (None, near.prose(42, 80) + " x"), (5, ""), (6, None), (5, texts[0])]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    left = [(r.doc_id, r.text) for r in out]
    kept = {t for _, t in left}
    assert len(kept & set(texts[:3])) == 1 and (7, texts[2]) not in left and (5, texts[3]) in left
    assert len([t for i, t in left if i is None]) == 1 and (5, "") in left and (6, None) in left
    # Rows that share id and text are one document, and stay or go together.
    assert left.count((5, texts[0])) in (0, 2)
