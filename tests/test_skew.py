from pyspark.sql import functions as F

from webstrata.operators import skew


def hot_events(spark, n=3000):
    """Two thirds of all rows belong to one key, some to none."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select("id", key.alias("key"), (F.col("id") * 7919 % 1000).alias("at"), (F.col("id") * 31 % 97).alias("v"))


def test_join_equals_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 100)
    facts = hot_events(spark)
    dim = facts.where("key is not null").groupBy("key").agg(F.sum("v").alias("total"))
    for how in ("inner", "left"):
        got = skew.join_unique(facts, dim.where("key <> 'k3'"), "key", how).select("id", "key", "total")
        want = facts.join(dim.where("key <> 'k3'"), "key", how).select("id", "key", "total")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_rows_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 100)
    facts = hot_events(spark)
    hot = skew.hot_keys(facts, "key")
    parts = {r.key: r.n for r in skew.salted(facts, "key", hot).groupBy("key").agg(F.count_distinct("_salt").alias("n")).collect()}
    assert parts["hot"] == 20 and parts["k3"] == 1 and parts[None] > 20
    copies = {r.key: r.n for r in skew.repeated(facts.select("key").distinct(), "key", hot).groupBy("key").agg(
        F.count("*").alias("n")).collect()}
    assert copies["hot"] == 20 and copies["k3"] == 1


def test_hot_keys_are_bounded(spark):
    many = spark.range(20_000).select((F.col("id") % 9000).alias("k"))
    assert skew.hot_keys(many, "k").count() == skew.HOT_KEYS


def test_chunks_are_ordered_parts(spark):
    rows = hot_events(spark).where("key is not null")
    cut = skew.chunked(rows, "key", ["at", "id"], 5)
    assert cut.select("chunk").distinct().count() == 5 and cut.count() == rows.count()
    spans = cut.groupBy("chunk").agg(F.min(F.struct("key", "at", "id")).alias("a"), F.max(F.struct("key", "at", "id")).alias("b")).orderBy("chunk").collect()
    assert all(tuple(x.b) < tuple(y.a) for x, y in zip(spans, spans[1:]))


def test_dense_index(spark):
    values = spark.range(500).select((F.col("id") * 37 % 501).alias("v"))
    rows = skew.dense_index(values, ["v"], "i").orderBy("v").collect()
    assert [r.i for r in rows] == list(range(500))
