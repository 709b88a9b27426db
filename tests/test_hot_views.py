"""Link and structured-data views when one page and one item hold most of the rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.run import compare
from strata_checks.view_queries import NAMES, VIEW_SQL
from webstrata.operators import skew
from webstrata.operators.tables import indexability
from webstrata.plans.registry import ALL_VIEWS
from webstrata.session import cut

VIEWS = ["view_links_internal", "view_links_external", "view_links_network", "view_links_subdomain", "view_links_invalid_content",
         "view_utm_links", "view_links_internal_legacy", "view_links_external_legacy", "view_utm_links_legacy", "view_hubs_legacy",
         "view_hub_children_legacy", "view_schema_analysis", "view_schema_hierarchy", "view_schema_analysis_legacy",
         "view_sitemap_statistics", "view_sitemap_statistics_legacy", "view_exact_duplicates", "view_exact_duplicate_members",
         "view_near_duplicates", "view_exact_duplicates_legacy", "view_crawl_overview", "view_crawl_overview_legacy"]


@pytest.fixture(scope="module")
def hot(spark, sf):
    data = Data(spark, sf)
    tables = data.tables(*NAMES, "indexability_inputs")
    links = tables["internal_links"]
    # Two thirds of all links lead to page 8, a third of the rest stands on page 3, some lead nowhere.
    turn = F.xxhash64("source_url_id", "xpath") % 9
    more = links.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns({
        "target_url_id": F.when(F.col("n") < 4, 8).when(turn == 0, None).otherwise(F.col("target_url_id")),
        "source_url_id": F.when(turn % 3 == 1, 3).otherwise(F.col("source_url_id")),
        "discovered_at": F.col("discovered_at") + F.col("n")}).drop("n")
    tables["internal_links"] = cut(links.unionByName(more))
    shared = tables["schema_instances"].agg(F.min("content_hash")).first()[0]
    tables["schema_references"] = cut(tables["schema_references"].withColumn("content_hash", F.when(
        F.col("url_id") % 3 > 0, shared).otherwise(F.col("content_hash"))))
    tables["content"] = cut(tables["content"].withColumns({c: F.when(F.col("url_id") % 3 > 0, "same").otherwise(F.col(c))
                                                          for c in ("content_hash_sha256", "content_hash_simhash")}))
    tables["url_sitemaps"] = cut(tables["url_sitemaps"].withColumn("sitemap_id", F.when(
        F.col("url_id") % 3 > 0, 1).otherwise(F.col("sitemap_id"))))
    # Two thirds of all pages name one canonical, one alternate and one place they moved to.
    often = F.col("url_id") % 3 > 0
    for name, column in (("canonical_urls", "canonical_url_id"), ("hreflang_sitemap", "href_url_id"), ("page_metadata", "redirect_destination_url_id")):
        tables[name] = cut(tables[name].withColumn(column, F.when(often, 8).otherwise(F.col(column)).cast("bigint")))
    tables["indexability"] = cut(indexability(tables["indexability_inputs"], tables["page_metadata"], tables["canonical_urls"]))
    db = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas()
        for column, kind in df.dtypes:
            if kind in ("bigint", "int"):
                frame[column] = frame[column].astype("Int64")
        db.register(f"{name}_frame", frame)
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_frame")
    return tables, db


@pytest.mark.parametrize("name", VIEWS)
def test_view_with_hot_keys(hot, name, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 20)
    tables, db = hot
    sql = re.sub(r"\{(\w+)\}", r"\1", VIEW_SQL[name])
    assert compare(db, sql, ALL_VIEWS[name](tables)) is None
