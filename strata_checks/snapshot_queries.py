"""The crawl tables made from recorded fetches, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.page_queries import COUNTED, NAV_LINKS, decoded
from strata_checks.registry import check
from strata_checks.table_queries import _fetches
from webstrata.plans.snapshot import crawl_tables
from webstrata.plans.views import view_crawl_overview


def _tables(data: Data) -> dict[str, DataFrame]:
    """Fetches of all pages as html; every third one redirects, every fifth one is unchanged."""
    class Spread:
        pages = data.parsed("pages")
    html = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"))
    fetches = _fetches(Spread).withColumn("headers", F.map_concat("headers", html))
    return crawl_tables(fetches, "therin.example.net", "strata", data.robots_files, data.sitemap_files)


# The last fetch of every stored URL that is no 304, else the last; stored URLs have no fragment.
FETCHED = """SELECT * FROM (SELECT *, regexp_replace(url, '#.*$', '') AS stored, row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '')
    ORDER BY CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END, page_id DESC) AS rn FROM {pages}) AS f WHERE rn = 1"""


@check("crawl_tables_content", f"""WITH linked AS (SELECT page_id, count(DISTINCT (href, anchor_text)) AS n FROM ({NAV_LINKS}) AS l GROUP BY 1)
    SELECT f.stored AS url, trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title, {COUNTED} AS word_count,
    CASE WHEN f.url LIKE '%//therin.example.net/%' THEN l.n ELSE 0 END AS internal_links_count,
    CASE WHEN f.url LIKE '%//therin.example.net/%' THEN 0 ELSE l.n END AS external_links_count
    FROM ({FETCHED}) AS f JOIN linked l ON l.page_id = f.page_id WHERE f.page_id % 5 <> 0 AND f.page_id % 3 <> 0""")
def _crawl_tables_content(data: Data) -> DataFrame:
    t = _tables(data)
    return t["content"].join(t["urls"].select("url_id", "url"), "url_id").select(
        "url", "title", "word_count", "internal_links_count", "external_links_count")


@check("crawl_tables_overview", f"""SELECT stored AS url, CASE WHEN page_id % 3 = 0 THEN 301 ELSE CASE WHEN page_id % 5 = 0 THEN 304 ELSE 200 END END AS status_code,
    CASE WHEN page_id % 5 <> 0 AND page_id % 3 <> 0 THEN trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")}) END AS title,
    CASE WHEN page_id % 3 = 0 THEN regexp_extract(stored, '^(https?://[^/]+)', 1) || '/to/' || CAST(page_id AS STRING) END AS redirect_destination_url
    FROM ({FETCHED}) AS f WHERE stored LIKE '%//therin.example.net/%'""")
def _crawl_tables_overview(data: Data) -> DataFrame:
    overview = view_crawl_overview(_tables(data)).where("crawl_status = 'done'")
    return overview.select("url", "status_code", "title", "redirect_destination_url")
