import pytest

from strata_checks.derived import Data
from strata_checks.view_queries import crawl_tables
from webstrata.plans.registry import build_views, register_views
from webstrata.session import scratch_path, shared_dir
from webstrata.sources import exports as Ex
from webstrata.sources import readers as Rd


def test_a_short_list_is_pushed_into_the_scan(spark, sf):
    path = f"{sf}/pages.parquet"
    some = [r.url for r in spark.read.parquet(path).select("url").limit(3).collect()]
    pages = Rd.read_pages(spark, path, some)
    plan = pages.select("url")._jdf.queryExecution().executedPlan().toString()
    assert pages.count() == 3 and "In(url" in plan
    many = some + [f"https://none/{i}" for i in range(200)]
    assert Rd.read_pages(spark, path, many).count() == 3


def test_url_lists(spark, tmp_path):
    csv, text = tmp_path / "a.csv", tmp_path / "b.txt"
    csv.write_text("name,url\nx, https://a/1 \ny,\nz,https://a/2\n")
    text.write_text("# list\nhttps://a/1\n\n  https://a/2\n#https://a/3\n")
    for path in (csv, text):
        assert sorted(r.url for r in Rd.read_url_list(spark, str(path)).collect()) == ["https://a/1", "https://a/2"]


def test_unknown_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert Ex.select_view(df, ["s", "zz"], "n > 1").collect()[0].asDict() == {"s": "b"}
    assert Ex.select_view(df, ["zz"], limit=1).columns == ["n", "s"]


def test_views_are_built_for_the_tables_there_are(spark, sf):
    tables = crawl_tables(Data(spark, sf))
    built = build_views({n: tables[n] for n in ("urls", "content", "frontier")})
    assert {"view_hubs", "view_crawl_status", "view_exact_duplicates"} <= set(built) and "view_crawl_overview" not in built
    with pytest.raises(ValueError):
        build_views({}, ["view_hubs"])


def test_sample_questions_in_sql(spark, sf):
    register_views(crawl_tables(Data(spark, sf)))
    slow = spark.sql("select url, word_count from view_crawl_overview where indexable order by word_count desc limit 5")
    images = spark.sql("select count(*) n from view_links_internal where is_image = 1").first().n
    broken = spark.sql("select invalid_reason, count(*) n from view_links_invalid_content group by 1").collect()
    assert slow.count() <= 5 and images > 0 and {r.invalid_reason for r in broken} <= {
        "redirects", "not self-canonical", "non-200 status"}


def test_steps_go_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
    assert spark.sparkContext.getCheckpointDir() is not None
