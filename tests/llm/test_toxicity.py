import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webstrata.llm import toxicity


def auc(p, y):
    order = np.argsort(np.argsort(p))
    n = y.sum()
    return (order[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = (toxicity.score(docs, model).select("doc_id", "score", "lang", toxicity.rejected(model).alias("rejected"))
            .join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 2).toPandas())
    assert (rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()
    y = rows.toxic.to_numpy()
    # Measured: 0.88 over all, 0.97 in English. The other languages have some twenty toxic texts each to learn from here,
    # marked by stems that clean texts contain as well.
    assert auc(rows.score.to_numpy(), y) > 0.85
    english = rows[rows.lang == "en"]
    assert auc(english.score.to_numpy(), english.toxic.to_numpy()) > 0.95
    clean = rows[rows.toxic == 0]
    assert (clean.score >= 0.3).mean() < 0.03 and clean.rejected.mean() < 0.03      # measured: 0.024 at 0.3
    assert set(model.thresholds) <= {"en", "de", "fr", "es"} and 0.3 <= model.threshold <= 0.8


def test_the_forward_pass_equals_a_plain_loop():
    """Window by window and filter by filter, on a model of noise and texts of every length."""
    rng = np.random.default_rng(3)
    weights = rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.WIDTH)).astype(np.float32),
                           [rng.normal(size=(w, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           rng.normal(size=len(weights)).astype(np.float32), weights, 0.5)
    words = ["idiot", "House", "a", "the", "straße", "wretched", "é", "river,", "\"clown!\""]
    texts = [None, "", " \n ", "...", *(" ".join(rng.choice(words, n)) for n in (1, 2, 3, 4, 5, 7, 30, 200)), "a\nthe  House"]

    def plain(text):
        own = [w for w in (w.strip(toxicity._EDGES).lower() for w in (text or "").replace("\n", " ").split(" ")) if w]
        vectors = [np.mean([model.embeddings[b].astype(float) for b in toxicity.buckets(w)], axis=0) for w in own]
        pooled = []
        for width, kernel in zip(toxicity.WIDTHS, model.filters):
            for lane in range(toxicity.FILTERS):
                answers = [sum(vectors[at + k] @ kernel[k, :, lane] for k in range(width) if 0 <= at + k < len(own))
                           for at in range(1 - width, len(own))] if own else [0.0]
                pooled.append(max(answers))
        return float(np.maximum(np.array(pooled) + model.bias, 0) @ model.weights + model.offset)

    memory = toxicity._Words()
    for part in (texts, texts[::-1], texts[3:6]):
        assert np.allclose(toxicity.margins(model, pa.array(part, pa.string()), memory), [plain(t) for t in part], rtol=1e-4, atol=1e-3)


def test_words_of_any_length_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED_CHARS", 5000)
    memory, kernels = toxicity._Words(), [np.zeros((w, toxicity.WIDTH, toxicity.FILTERS), np.float32) for w in toxicity.WIDTHS]
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    model = toxicity.Model(np.zeros((toxicity.BUCKETS, toxicity.WIDTH), np.float32), kernels, np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0)
    for i in range(30):
        toxicity.margins(model, pa.array([f"{i}" + "x" * 3000]), memory)
        assert sum(map(len, memory.slot)) <= 9010


def test_only_text_decides(spark, odd, odd_texts, nothing):
    texts = ["you idiot and clown"] * 60 + ["a house by the river"] * 60
    ids = list(range(120))
    docs = spark.createDataFrame([(i, f"{t} n{i}", "en") for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    two = spark.createDataFrame([(None, "An IDIOT, a clown!", None), (3, "An IDIOT, a clown!", "de"), (5, "by the river", "en")],
                                "doc_id long, text string, lang string")
    a, b, c = (r.score for r in toxicity.score(two, model).collect())
    assert a == b > 0.5 > c
    scored = toxicity.score(odd, model)
    rows = scored.collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows) and scored.columns.count("score") == 1
    empty = {r.score for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert toxicity.score(nothing, model).collect() == []


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:60]
    docs = spark.createDataFrame([(i, f"idiot {i}", "en") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.weights.any() == False and toxicity.scores(model, pa.array(["idiot"]))[0] < 0.3  # noqa: E712


def test_missing_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "idiot", "en"), (1, "idiot", "en"), (5, None, None), (None, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    assert 0 <= toxicity.scores(toxicity.train(docs, labels), pa.array(["idiot", ""]))[0] <= 1
    assert toxicity.scores(toxicity.train(docs, labels.limit(0)), pa.array(["idiot"]))[0] < 0.3


def test_texts_do_not_touch():
    """A batch scores as its texts do alone, whatever stands beside them."""
    rng = np.random.default_rng(2)
    model = toxicity.fit([f"w{rng.integers(50)} " * 5 + "bad" * int(k % 2) for k in range(80)], np.arange(80) % 2, ["en"] * 80)
    texts = ["bad one", "", "w1 w2", None, "one two three four bad", ".", "w3", "\n", "bad"]
    together = toxicity.scores(model, pa.array(texts, pa.string()))
    alone = np.concatenate([toxicity.scores(model, pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0])) == 0.45


def test_all_labelled_rows_calibrate(spark):
    """Scores follow the label share of the table, not of the sample, and a rare language gets a threshold of its own."""
    def row(i):
        toxic = i % 20 == 0
        word = "clown" if i % 40 == 0 or i % 7 == 0 else "idiot" if toxic else "river"
        return i, f"the {word} by the house n{i}", "xx" if i % 100 in (0, 3) else "en", int(toxic)

    rows = [row(i) for i in range(6000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=200)
    scored = toxicity.score(docs, model).where(toxicity.fold(F.col("doc_id")) == 2).select("score").toPandas()
    assert abs(scored.score.mean() - 0.05) < 0.03
    assert set(model.thresholds) == {"en", "xx"}


def test_counts_stand_for_rows():
    margin, y, n = np.array([-2.0, -1.0, 0.5, 2.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([40, 5, 10, 20])
    one_by_one = toxicity.calibrate(np.repeat(margin, n), np.repeat(y, n))
    assert np.allclose(toxicity.calibrate(margin, y, counts=n), one_by_one)
    p = np.array([0.7, 0.5, 0.2])
    assert toxicity.best_threshold(p, np.array([5, 5, 0]), n=np.array([5, 6, 90])) == 0.35


def test_few_rows_cross_to_python_at_a_time(spark):
    """Also in a session that sets no bound of its own; a smaller one is kept."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    kernels = [np.zeros((w, toxicity.WIDTH, toxicity.FILTERS), np.float32) for w in toxicity.WIDTHS]
    model = toxicity.Model(np.zeros((toxicity.BUCKETS, toxicity.WIDTH), np.float32), kernels, np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0)
    for own, most in (("10000", 1000), ("0", 1000), ("200", 200)):
        session = spark.newSession()
        session.conf.set(setting, own)
        docs = session.range(0, 3500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("the house n"), "id").alias("text"))
        sizes = toxicity.score(docs, model).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").toPandas().n
        assert sizes.sum() == 3500 and sizes.max() <= most


def test_training_hands_its_marks_over_without_python_workers(spark, monkeypatch):
    made, make = [], type(spark).createDataFrame
    docs = spark.createDataFrame([(i, f"{'idiot' if i % 2 else 'river'} n{i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(make(self, *a, **b)) or made[-1])
    assert toxicity.train(docs, labels).key and made
    assert not [f for f in made if "ExistingRDD" in f._jdf.queryExecution().toString()]
