import pytest
from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.table_queries import _fetches, ingested, tables_of_stream
from webstrata.operators import hosts as Ho
from webstrata.operators import stats as St
from webstrata.operators.extract import extract_fetches
from webstrata.session import cut
from webstrata.streaming import hosts as Sh
from webstrata.streaming import ingest as In
from webstrata.streaming import rates as Sr
from webstrata.streaming import versions as Vs


def split_log(spark, sf, parts):
    """The fetch log in `parts` batches by time, with a host that only the first of them knows."""
    log = Data(spark, sf).fetch_log.withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = log.agg(F.expr(f"percentile(unix_micros(ts), array({', '.join(str(i / parts) for i in range(1, parts))}))")).first()[0]
    number = sum((F.unix_micros("ts") > F.lit(int(b))).cast("int") for b in bounds)
    log = log.withColumn("part", number)
    return log.withColumn("host", F.when((F.col("part") == 0) & (F.col("event_id") % 7 == 0), "silent.example.com").otherwise(F.col("host")))


@pytest.mark.parametrize("every", [0, 2])
def test_batches_carry_host_state_and_replay(spark, sf, tmp_path, every):
    log, out = cut(split_log(spark, sf, 4)), str(tmp_path / "hosts")
    for number in (0, 1, 1, 2, 2, 3):       # some batches are replayed, also after their snapshot
        batch = log.where(F.col("part") == number)
        Sh.circuit_batch(batch, number, out)
        Sh.delay_batch(batch, number, out)
        if every and Vs.snapshot_due(number, every):
            for table in Sh.STATES:
                Vs.write_snapshot(spark, out, table, Sh.PER_HOST, number)
    columns = ["event_id", "state_before", "state_after"]
    got = Vs.read_batches(spark, out, "circuit_events").select(*columns)
    want = Ho.host_circuit(log).select(*columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert {r.host: round(r.adaptive_delay, 6) for r in Sh.host_states(spark, out, "delay_state").collect()} == {
        r.host: round(r.adaptive_delay, 6) for r in Ho.host_delay(log).collect()}
    assert {r.host: r.state for r in Sh.host_states(spark, out, "circuit_state").collect()} == {
        r.host: r.state for r in Ho.host_circuit_latest(Ho.host_circuit(log)).collect()}


def test_a_batch_writes_no_silent_host(spark, sf, tmp_path):
    log, out = cut(split_log(spark, sf, 2)), str(tmp_path / "hosts")
    for number in (0, 1):
        Sh.circuit_batch(log.where(F.col("part") == number), number, out)
        Sh.delay_batch(log.where(F.col("part") == number), number, out)
    touched = {r.host for r in log.where("part = 1").select("host").distinct().collect()}
    for table in Sh.STATES:
        assert {r.host for r in Vs.read_batches(spark, out, table).where("batch = 1").collect()} == touched
        assert "silent.example.com" in {r.host for r in Sh.host_states(spark, out, table).collect()} - touched


def test_progress_equals_the_batch_form(spark, sf, tmp_path):
    """In any order of batches, with a replayed one, with and without snapshots."""
    log = cut(split_log(spark, sf, 4))
    want = sorted(map(tuple, St.crawl_rate(log, 3600).collect()))
    for every, order in ((0, (2, 0, 1, 3)), (2, (3, 2, 1, 0))):
        out = str(tmp_path / f"p{every}")
        for number, part in enumerate(order):
            for _ in range(2):
                Sr.progress_batch(log.where(F.col("part") == part), number, out, 3600)
                if Vs.snapshot_due(number, every):
                    for table, fold in Sr.TABLES.items():
                        Vs.write_snapshot(spark, out, table, fold, number)
        assert sorted(map(tuple, Sr.crawl_progress(spark, out, 3600).collect())) == want
        assert Sr.crawl_progress(spark, out, 3600, 0).count() < len(want)


def test_tables_are_the_same_before_and_after_a_snapshot(spark, sf):
    out = ingested(Data(spark, sf), 0)
    rows = sorted(map(tuple, tables_of_stream(spark, out).collect()))
    assert {r[0] for r in rows} == set(In.TABLES)
    early = {t: In.read_table(spark, out, t, 0).count() for t in In.TABLES}
    for batch_id in (1, 2):
        In.write_snapshots(spark, out, batch_id)
        assert sorted(map(tuple, tables_of_stream(spark, out).collect())) == rows
    assert early == {t: In.read_table(spark, out, t, 0).count() for t in In.TABLES}
    files = In.read_table(spark, out, "content").inputFiles()
    assert files and all("_snapshots" in f for f in files)


def test_replayed_ingest_batch_replaces_itself(spark, sf, tmp_path):
    fetches = _fetches(Data(spark, sf))
    out = str(tmp_path / "tables")
    half = F.col("page_id") < 25
    for batch_id, batch in ((0, fetches.where(half)), (1, fetches.where(~half)), (1, fetches.where(~half))):
        In.ingest_batch(extract_fetches(batch), batch_id, out)
    assert In.read_table(spark, out, "content").count() == fetches.where("status = 200").count()
    links = In.read_table(spark, out, "internal_links")
    assert links.count() > 0 and links.groupBy("source_url", "position").count().where("count > 1").count() == 0


def test_pages_change_between_batches(spark, tmp_path):
    """A page that loses its links keeps none of the old ones, and an unchanged answer changes nothing."""
    out, kind = str(tmp_path / "t"), {"Content-Type": "text/html"}
    schema = ("url string, final_url string, status int, kind string, headers map<string,string>, html string, "
              "chain array<struct<url:string,status:int,headers:map<string,string>>>, fetched_at long")

    def batch(number, *rows):
        frame = spark.createDataFrame([(u, u, s, "html", kind, h, [(u, s, {})], number) for u, s, h in rows], schema)
        In.ingest_batch(extract_fetches(frame), number, out)

    linked = '<title>{}</title><a href="/x">x</a>'
    batch(0, ("http://h/a", 200, linked.format("a0")), ("http://h/b", 200, linked.format("b0")))
    batch(1, ("http://h/a", 200, "<title>a1</title>"), ("http://h/b", 304, None))
    batch(2, ("http://h/c", 200, linked.format("c2")))
    assert sorted(r.source_url for r in In.read_table(spark, out, "internal_links").collect()) == ["http://h/b", "http://h/c"]
    assert {r.url[-1]: r.title for r in In.read_table(spark, out, "content").collect()} == {"a": "a1", "b": "b0", "c": "c2"}
    assert {r.url[-1]: r.final_status_code for r in In.read_table(spark, out, "page_metadata").collect()} == dict.fromkeys("abc", 200)
    assert {r.url[-1]: (r.first_seen, r.last_seen) for r in In.read_table(spark, out, "urls").collect()} == {"a": (0, 1), "b": (0, 1), "c": (2, 2)}


def test_of_several_fetches_in_a_batch_the_last_counts(spark, tmp_path):
    out, kind = str(tmp_path / "t"), {"Content-Type": "text/html"}
    schema = ("url string, final_url string, status int, kind string, headers map<string,string>, html string, "
              "chain array<struct<url:string,status:int,headers:map<string,string>>>, fetched_at long")
    rows = [("http://h/a", "http://h/a", 200, "html", kind, f'<title>v{n}</title><a href="/{n}">x</a>', [("http://h/a", 200, {})], n) for n in (2, 3, 1, 3)]
    In.ingest_batch(extract_fetches(spark.createDataFrame(rows, schema)), 0, out)
    assert [r.href for r in In.read_table(spark, out, "internal_links").collect()] == ["/3"]
    assert [r.title for r in In.read_table(spark, out, "content").collect()] == ["v3"]


def test_later_batches_win(spark, tmp_path):
    out = str(tmp_path / "t")
    Vs.write_batch(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), out, "x", 0)
    Vs.write_batch(spark.createDataFrame([("a", 2)], "k string, v int"), out, "x", 1)
    rows = Vs.merged(spark, out, "x", Vs.latest(["k"])).collect()
    assert {r.k: r.v for r in rows} == {"a": 2, "b": 1}
