"""Extraction from page HTML, robots files, sitemaps, response headers and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.registry import check
from webstrata.functions.headers import parse_hsts
from webstrata.functions.urls import classify_url, host
from webstrata.operators import checks as C
from webstrata.operators import pages as P
from webstrata.operators import robots as R
from webstrata.operators import schema_org as S
from webstrata.operators import sitemaps as M
from webstrata.operators.extract import extract_pages
from webstrata.operators.links import extract_links, inlink_counts, link_counts, links_of
from webstrata.session import cut

# Text of a page as SQL sees it: markup, scripts, styles and comments out, entities decoded.
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def decoded(text: str) -> str:
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{entity}', '{char}', 'g')"
    return text


def page_words(separator: str, html: str = "html") -> str:
    return decoded(f"regexp_replace({html}, '{MARKUP}', '{separator}', 'g')")


SPACED = f"trim(regexp_replace({page_words(' ')}, '\\s+', ' ', 'g'))"
COUNTED = f"length(regexp_replace(trim(regexp_replace({page_words('')}, '\\s+', ' ', 'g')), '[^ ]', '', 'g')) + 1"


@check("extract_content", f"""SELECT page_id, trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
    CASE WHEN page_id % 3 = 0 THEN 'About ' || CAST(page_id AS STRING) || ' & more' END AS meta_description,
    trim({decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1, 'Part ' || CAST(page_id AS STRING) AS h2,
    CASE page_id % 5 WHEN 0 THEN 'noindex|nofollow' WHEN 1 THEN 'index' ELSE '' END AS meta_directives,
    CASE WHEN page_id % 2 = 0 THEN 'none|noarchive' ELSE '' END AS header_directives,
    CASE page_id % 4 WHEN 0 THEN '/c/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://www.example.org/c/' || CAST(page_id AS STRING)
        WHEN 2 THEN '//cdn.example.org/c/' || CAST(page_id AS STRING) END AS canonical_url,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
    CASE WHEN page_id % 2 = 0 THEN 'de=/de/' || CAST(page_id AS STRING) || '|x-default=https://www.example.org/' || CAST(page_id AS STRING) ELSE '' END AS hreflang,
    {COUNTED} AS word_count, sha256({SPACED}) AS content_hash_sha256, length({SPACED}) AS content_length FROM {{rich_pages}}""")
def _extract_content(data: Data) -> DataFrame:
    tag = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("X-Robots-Tag"), F.lit("none, NOARCHIVE")))
    content = P.extract_content(data.parsed("rich_pages").withColumn("headers", tag))
    return content.select(
        "page_id", "title", "meta_description", F.array_join("h1_tags", "|").alias("h1"),
        F.array_join("h2_tags", "|").alias("h2"), F.array_join("html_meta_directives", "|").alias("meta_directives"),
        F.array_join("http_header_directives", "|").alias("header_directives"), "canonical_url", "html_lang",
        F.array_join(F.transform("hreflang_urls", lambda h: F.concat(h["hreflang"], F.lit("="), h["url"])), "|").alias("hreflang"),
        "word_count", "content_hash_sha256", "content_length")


@check("contentful", """SELECT page_id FROM {rich_pages} WHERE page_id % 8 < 5 AND page_id % 25 <> 24""")
def _contentful(data: Data) -> DataFrame:
    content = P.extract_content(data.parsed("rich_pages").select("page_id", "url", "html"))
    turn = F.col("page_id") % 8
    fetched = content.withColumns({
        "status": F.when(turn == 5, 301).when(turn == 6, 404).when(turn == 7, 500).otherwise(200),
        "kind": F.when(F.col("page_id") % 25 == 24, "sitemap").otherwise("html")})
    return P.contentful(fetched).select("page_id")


@check("page_text", f"SELECT page_id, {SPACED} AS text FROM {{rich_pages}}")
def _page_text(data: Data) -> DataFrame:
    return P.page_text(data.parsed("rich_pages")).select("page_id", "text")


@check("clean_text", f"SELECT page_id, {SPACED} AS clean_text FROM {{pages}}")
def _clean_text(data: Data) -> DataFrame:
    return P.clean_text(data.parsed("pages")).select("page_id", "clean_text")


@check("canonical_of", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/c/' || CAST(page_id AS STRING)
    WHEN 1 THEN 'https://www.example.org/c/' || CAST(page_id AS STRING)
    WHEN 2 THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/c/' || CAST(page_id AS STRING) END AS canonical_url FROM {pages}""")
def _canonical_of(data: Data) -> DataFrame:
    return P.canonical_of(data.parsed("rich_pages")).select("page_id", "canonical_url")


# Links of the shipped pages: one list item per link, so a link's place is that of the first equal item.
NAV_LINKS = f"""SELECT page_id, url, i - 1 AS position, {decoded("href")} AS href, {decoded("text")} AS anchor_text,
    min(i) OVER (PARTITION BY page_id, href, text) AS twin, count(*) OVER (PARTITION BY page_id) AS items
    FROM (SELECT page_id, url, i, regexp_extract(item, 'href="([^"]*)"', 1) AS href, regexp_extract(item, '>([^<]*)</a>', 1) AS text
        FROM (SELECT page_id, url, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS i
            FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS items FROM pages) AS a) AS b) AS c"""


@check("extract_links", f"""SELECT page_id, position, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS original_href, href,
    trim(anchor_text) AS anchor_text, '/[document]/html/body/nav/ul/li' || CASE WHEN items > 1 THEN '[' || CAST(twin AS STRING) || ']' ELSE '' END || '/a' AS xpath
    FROM ({NAV_LINKS}) AS n""")
def _extract_links(data: Data) -> DataFrame:
    return extract_links(data.parsed("pages")).select("page_id", "position", "original_href", "href", "anchor_text", "xpath")


@check("extract_links_labels", """SELECT page_id, target_url, anchor_text, fragment, url_parameters FROM (
    SELECT page_id, 'https://twitter.com/s/' || CAST(page_id AS STRING) AS target_url, '[IMG: Share ' || CAST(page_id AS STRING) || ']' AS anchor_text,
        '' AS fragment, '' AS url_parameters FROM {pages}
    UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/]+(.*/)[^/]*$', 1), '[^/]+/$', '') || 'up?a=1&b=2', '[TITLE: Up ' || CAST(page_id AS STRING) || ']', 'sec', 'b=2&a=1&utm_source=x' FROM {pages}
    UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/files/data-sheet_' || CAST(page_id AS STRING) || '.pdf',
        '[PATH: Data Sheet ' || CAST(page_id AS STRING) || '.Pdf]', '', '' FROM {pages}
    UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/org/' || CAST(page_id AS STRING), 'x', '', '' FROM {pages} WHERE page_id % 2 = 1) AS l""")
def _extract_links_labels(data: Data) -> DataFrame:
    added = extract_links(data.parsed("rich_pages")).where(~F.col("xpath").contains("/nav/"))
    return added.select("page_id", "target_url", "anchor_text", "fragment", "url_parameters")


def overview_of_snapshot(pages: DataFrame) -> DataFrame:
    """Pages with what they say and how they are linked, straight from raw HTML, parsed once."""
    extracted = cut(extract_pages(pages.select("page_id", "url", "html"), schema=False).select(
        "page_id", "url", "title", F.get("h1_tags", F.lit(0)).alias("h1"), "html_lang", "word_count",
        "links"))
    links = links_of(extracted.select("url", "links")).withColumn(
        "classification", classify_url("target_url", host("source_url")))
    out = link_counts(links).withColumnRenamed("source_url", "url")
    arriving = inlink_counts(links).withColumnRenamed("target_url", "url")
    counts = ["internal_links_count", "external_links_count", "internal_links_unique_count",
              "external_links_unique_count", "inlinks_count", "inlinks_unique_count"]
    return extracted.drop("links").join(out, "url", "left").join(arriving, "url", "left").select(
        "page_id", "url", "title", "h1", "html_lang", "word_count",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])


@check("snapshot_overview", f"""WITH links AS ({NAV_LINKS}),
    out AS (SELECT page_id, count(*) AS n, count(DISTINCT href) AS u FROM links GROUP BY page_id),
    arriving AS (SELECT regexp_extract(url, '^(https?://[^/]+)', 1) || href AS url, count(*) AS n, count(DISTINCT page_id) AS u FROM links GROUP BY 1)
    SELECT p.page_id, p.url, trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title,
    trim({decoded("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
    {COUNTED} AS word_count, coalesce(out.n, 0) AS internal_links_count, CAST(0 AS BIGINT) AS external_links_count,
    coalesce(out.u, 0) AS internal_links_unique_count, CAST(0 AS BIGINT) AS external_links_unique_count,
    coalesce(arriving.n, 0) AS inlinks_count, coalesce(arriving.u, 0) AS inlinks_unique_count
    FROM pages p LEFT JOIN out ON out.page_id = p.page_id LEFT JOIN arriving ON arriving.url = p.url""")
def _snapshot_overview(data: Data) -> DataFrame:
    return overview_of_snapshot(data.parsed("pages"))


# ---- sitemaps -----------------------------------------------------------------------------

ENTRY = """SELECT url, page_id, 'https://' || host || '/map-' || CAST(shard AS STRING) || '.xml' AS sitemap_url,
    row_number() OVER (PARTITION BY host, shard ORDER BY page_id) - 1 AS position,
    CASE WHEN page_id % 7 <> 0 THEN CAST(page_id % 10 AS DOUBLE) / 10 END AS priority,
    CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || CAST(1 + page_id % 9 AS STRING) END AS lastmod,
    CASE WHEN page_id % 3 = 0 THEN 'de|x-default' ELSE '' END AS hreflangs FROM {entries}"""


def _plain(entries: DataFrame) -> DataFrame:
    return entries.select("url", "sitemap_url", "position", F.round("priority", 6).alias("priority"), "lastmod",
                          F.coalesce(F.array_join("hreflangs", "|"), F.lit("")).alias("hreflangs"))


def _seeds(data: Data) -> DataFrame:
    named = R.sitemaps_from_robots(data.robots_files, data.sitemap_files)
    return named.select("sitemap_url", "position")


@check("parse_sitemaps", f"SELECT url, sitemap_url, position, priority, lastmod, hreflangs FROM ({ENTRY}) AS e")
def _parse_sitemaps(data: Data) -> DataFrame:
    return _plain(M.parse_sitemaps(data.sitemap_files))


# Files cut off within their second entry, within the first, or within an index's second child.
CUT = """SELECT page_id, CAST(page_id AS STRING) AS name, CASE page_id % 3 WHEN 0 THEN '<?xml version="1.0"?><urlset><url><loc>' || replace(url, '&', '&amp;') || '</loc><priority>0.3</priority></url><url><loc>http://cut.example.org/' || CAST(page_id AS STRING)
    WHEN 1 THEN '<urlset><url><loc>' || replace(url, '&', '&amp;') WHEN 2 THEN '<sitemapindex><sitemap><loc>http://cut.example.org/child/' || CAST(page_id AS STRING) || '</loc></sitemap><sitemap><lo' END AS xml, url FROM {pages}"""


def _cut_files(data: Data) -> DataFrame:
    page, url = F.col("page_id").cast("string"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    kind = F.col("page_id") % 3
    xml = F.when(kind == 0, F.concat(F.lit('<?xml version="1.0"?><urlset><url><loc>'), url, F.lit("</loc><priority>0.3</priority></url><url><loc>http://cut.example.org/"), page)).when(
        kind == 1, F.concat(F.lit("<urlset><url><loc>"), url)).otherwise(
        F.concat(F.lit("<sitemapindex><sitemap><loc>http://cut.example.org/child/"), page, F.lit("</loc></sitemap><sitemap><lo")))
    return data.pages.select(page.alias("sitemap_url"), xml.alias("xml"))


@check("sitemaps_cut_off", f"""SELECT name AS sitemap_url, 'entry' AS part, url AS found, CAST(0 AS BIGINT) AS position FROM ({CUT}) AS c WHERE page_id % 3 = 0
    UNION ALL SELECT name, 'child', 'http://cut.example.org/child/' || name, 0 FROM ({CUT}) AS c WHERE page_id % 3 = 2
    UNION ALL SELECT name, 'broken', '', CASE WHEN page_id % 3 = 1 THEN 0 ELSE 1 END FROM ({CUT}) AS c""")
def _sitemaps_cut_off(data: Data) -> DataFrame:
    """What stands before the break of a file is kept, and the file is reported."""
    files = cut(M.read_sitemaps(_cut_files(data)))
    return M.parse_sitemaps(files).select("sitemap_url", F.lit("entry").alias("part"), F.col("url").alias("found"), "position").unionByName(
        M.sitemap_children(files).select("sitemap_url", F.lit("child").alias("part"), F.col("child_url").alias("found"), "position")).unionByName(
        M.sitemap_errors(files).select("sitemap_url", F.lit("broken").alias("part"), F.lit("").alias("found"),
                                       (F.col("entries_read") + F.col("children_read")).alias("position")))


@check("sitemap_kind", """SELECT sitemap_url, kind FROM (
    SELECT DISTINCT 'https://' || host || '/map-' || CAST(shard AS STRING) || '.xml' AS sitemap_url, 'sitemap' AS kind FROM {entries}
    UNION ALL SELECT 'https://' || host || '/map.xml', 'sitemap_index' FROM {hosts}
    UNION ALL SELECT 'https://' || host || '/sitemap.xml', 'sitemap' FROM {hosts} WHERE first_id % 4 = 1) AS k""")
def _sitemap_kind(data: Data) -> DataFrame:
    return data.sitemap_files.select("sitemap_url", M.sitemap_kind(F.col("xml")).alias("kind"))


@check("expand_sitemaps", """SELECT sitemap_url, parent, CAST(depth AS BIGINT) AS depth FROM (
    SELECT 'https://' || host || '/map.xml' AS sitemap_url, CAST(NULL AS STRING) AS parent, 0 AS depth FROM {hosts} WHERE first_id % 4 <> 1
    UNION ALL SELECT 'https://' || host || '/sitemap.xml', NULL, 0 FROM {hosts} WHERE first_id % 4 = 1
    UNION ALL SELECT DISTINCT 'https://' || e.host || '/map-' || CAST(shard AS STRING) || '.xml', 'https://' || e.host || '/map.xml', 1
        FROM {entries} e JOIN {hosts} h ON h.host = e.host WHERE first_id % 4 <> 1) AS s""")
def _expand_sitemaps(data: Data) -> DataFrame:
    return M.expand_sitemaps(_seeds(data), data.sitemap_files).select("sitemap_url", "parent", "depth")


@check("sitemap_urls", f"""SELECT e.url, sitemap_url, position, priority, lastmod, hreflangs FROM ({ENTRY}) AS e
    JOIN {{hosts}} h ON h.host = regexp_extract(e.url, '://([^/]+)', 1) WHERE first_id % 4 <> 1""")
def _sitemap_urls(data: Data) -> DataFrame:
    return _plain(M.sitemap_urls(_seeds(data), data.sitemap_files))


@check("sitemap_tables_sitemaps", f"""SELECT sitemap_url, count(*) AS total_urls_found, CAST(77 AS BIGINT) AS discovered_at FROM ({ENTRY}) AS e GROUP BY sitemap_url""")
def _sitemap_tables_sitemaps(data: Data) -> DataFrame:
    return M.sitemap_tables(M.parse_sitemaps(data.sitemap_files), 77)[0]


@check("sitemap_tables_urls", f"""SELECT regexp_replace(url, '#.*$', '') AS url, sitemap_url, min(position) AS position, CAST(77 AS BIGINT) AS discovered_at
    FROM ({ENTRY}) AS e GROUP BY 1, 2""")
def _sitemap_tables_urls(data: Data) -> DataFrame:
    return M.sitemap_tables(M.parse_sitemaps(data.sitemap_files), 77)[1]


@check("sitemap_hreflang", """SELECT DISTINCT url, language_code, href_url FROM (
    SELECT regexp_replace(url, '#.*$', '') AS url, 'de' AS language_code, 'https://de.example.org/' || CAST(page_id AS STRING) AS href_url FROM {pages} WHERE page_id % 3 = 0
    UNION ALL SELECT regexp_replace(url, '#.*$', ''), 'x-default', 'https://example.org/' || CAST(page_id AS STRING) FROM {pages} WHERE page_id % 3 = 0) AS x
    WHERE url IN (SELECT url FROM {pages})""")
def _sitemap_hreflang(data: Data) -> DataFrame:
    return M.sitemap_hreflang(M.parse_sitemaps(data.sitemap_files), data.urls)


# ---- robots -------------------------------------------------------------------------------

@check("parse_robots", """SELECT domain, user_agent, rule_type, rule_path FROM (
    SELECT host AS domain, '*' AS user_agent, 'disallow' AS rule_type, '/de/*' AS rule_path FROM {hosts}
    UNION ALL SELECT host, '*', 'allow', '/en/1' FROM {hosts}
    UNION ALL SELECT host, 'strata', CASE WHEN first_id % 2 = 0 THEN 'disallow' ELSE 'allow' END,
        CASE WHEN first_id % 2 = 0 THEN '/en/2' ELSE '/de/3' END FROM {hosts}) AS r""")
def _parse_robots(data: Data) -> DataFrame:
    return R.parse_robots(data.robots_files).select("domain", "user_agent", "rule_type", "rule_path")


@check("sitemaps_from_robots", """SELECT host AS domain, 'https://' || host || CASE WHEN first_id % 4 <> 1 THEN '/map.xml' ELSE '/sitemap.xml' END AS sitemap_url FROM {hosts}""")
def _sitemaps_from_robots(data: Data) -> DataFrame:
    return R.sitemaps_from_robots(data.robots_files, data.sitemap_files).select("domain", "sitemap_url")


PATHS = """SELECT u.url, h.first_id, regexp_extract(u.url, '://[^/]+([^?#]*)', 1) AS path FROM {urls} u
    JOIN {hosts} h ON h.host = regexp_extract(u.url, '://([^/]+)', 1)"""


@check("robots_verdict", f"""SELECT url, NOT ((first_id % 2 = 0 AND path LIKE '/en/2%')
    OR (path LIKE '/de/%' AND NOT (first_id % 2 = 1 AND path LIKE '/de/3%'))) AS robots_allows FROM ({PATHS}) AS p""")
def _robots_verdict(data: Data) -> DataFrame:
    return R.robots_verdict(data.urls.select("url"), R.parse_robots(data.robots_files), "strata")


@check("robots_verdict_longest", f"""SELECT url, path LIKE '/en/1%' OR NOT path LIKE '/de/%' AS robots_allows FROM ({PATHS}) AS p""")
def _robots_verdict_longest(data: Data) -> DataFrame:
    return R.robots_verdict(data.urls.select("url"), R.parse_robots(data.robots_files), "another", rfc9309=True)


@check("robots_matches", f"""SELECT url, rule_type, rule_path FROM (
    SELECT url, 'disallow' AS rule_type, '/de/*' AS rule_path FROM ({PATHS}) AS a WHERE path LIKE '/de/%'
    UNION ALL SELECT url, 'allow', '/en/1' FROM ({PATHS}) AS b WHERE path LIKE '/en/1%'
    UNION ALL SELECT url, 'disallow', '/en/2' FROM ({PATHS}) AS c WHERE first_id % 2 = 0 AND path LIKE '/en/2%'
    UNION ALL SELECT url, 'allow', '/de/3' FROM ({PATHS}) AS d WHERE first_id % 2 = 1 AND path LIKE '/de/3%') AS m""")
def _robots_matches(data: Data) -> DataFrame:
    return R.robots_matches(data.urls.select("url"), R.parse_robots(data.robots_files), "strata")


@check("crawl_delay", """SELECT host, coalesce(nullif(CAST(first_id % 4 AS DOUBLE), 0), CASE WHEN first_id % 3 <> 0 THEN CAST(first_id % 5 AS DOUBLE) END) AS crawl_delay FROM {hosts}""")
def _crawl_delay(data: Data) -> DataFrame:
    return R.crawl_delay(data.hosts.select("host"), R.robots_delays(data.robots_files), "strata")


# ---- response checks ----------------------------------------------------------------------

def _policy_header(probes: DataFrame) -> DataFrame:
    named = F.when(F.col("policy").isNotNull(), F.create_map(F.lit("Strict-Transport-Security"), F.col("policy")))
    return probes.withColumn("headers", named)


@check("parse_hsts", """SELECT base_domain, checked_at, CAST(CASE first_id % 4 WHEN 0 THEN 31536000 WHEN 1 THEN 300 END AS BIGINT) AS max_age,
    first_id % 4 IN (0, 2) AS include_subdomains, first_id % 4 IN (0, 1) AS preload, first_id % 4 = 0 AS max_age_ok,
    first_id % 4 <> 3 AS present FROM {hsts_probes} p JOIN {hosts} h ON h.host = p.base_domain WHERE probe = 'https'""")
def _parse_hsts(data: Data) -> DataFrame:
    https = data.hsts_probes.where("probe = 'https'")
    return https.select("base_domain", "checked_at", parse_hsts("policy").alias("h")).select("base_domain", "checked_at", "h.*")


HSTS = """SELECT host AS base_domain, 1000 + k AS checked_at, 'https://' || host || '/' AS https_url,
    CASE WHEN first_id % 5 = 4 THEN 500 ELSE 200 END AS https_status,
    CASE first_id % 4 WHEN 0 THEN 'max-age=31536000; includeSubDomains; preload' WHEN 1 THEN 'max-age="300"; preload'
        WHEN 2 THEN 'includeSubDomains; max-age=x' END AS hsts_header,
    CAST(CASE first_id % 4 WHEN 0 THEN 31536000 WHEN 1 THEN 300 END AS BIGINT) AS hsts_max_age, first_id % 4 IN (0, 2) AS hsts_include_subdomains,
    first_id % 4 IN (0, 1) AS hsts_preload, first_id % 4 = 0 AS hsts_max_age_ok, 'http://' || host || '/' AS http_url,
    CASE WHEN first_id % 5 = 4 THEN 500 ELSE 200 END AS http_status, first_id % 3 <> 0 AS http_redirects_to_https,
    CASE WHEN first_id % 3 <> 0 THEN 'https://' || host || '/' END AS http_redirect_target,
    first_id % 4 = 0 AND first_id % 3 <> 0 AS eligible, CAST(NULL AS STRING) AS notes
    FROM (SELECT host, first_id, {each:1, 2} AS k FROM {hosts}) AS x"""

SPA = """SELECT host AS base_domain, 2000 + first_id % 7 AS checked_at, 'https://' || host || '/nope' AS random_404_url,
    CASE WHEN first_id % 2 = 0 THEN 404 ELSE 200 END AS random_404_status, 'https://' || host || '/nope' AS random_404_final_url,
    first_id % 2 = 0 AS random_404_ok, CASE WHEN first_id % 3 <> 0 THEN 'https://' || host || '/EN/start' END AS case_url,
    CASE WHEN first_id % 3 <> 0 THEN 200 END AS case_status,
    CASE WHEN first_id % 3 <> 0 THEN 'https://' || host || CASE WHEN first_id % 4 = 1 THEN '/en/start' ELSE '/EN/start' END END AS case_final_url,
    CASE WHEN first_id % 3 <> 0 THEN first_id % 4 = 1 END AS case_redirects,
    CASE WHEN first_id % 3 <> 0 AND first_id % 4 = 2 THEN 'https://' || host || '/en/start' END AS case_canonical_url,
    'https://' || host || CASE WHEN first_id % 3 = 0 THEN '/' ELSE '/en/start' END AS case_expected_url,
    CASE WHEN first_id % 3 <> 0 THEN first_id % 4 IN (1, 2) END AS case_ok,
    CASE WHEN first_id % 3 = 0 THEN 'case check skipped: start URL path has no alphabetic characters' END AS notes
    FROM {hosts} WHERE first_id % 5 <> 3"""


def hsts_table(data: Data) -> DataFrame:
    return C.hsts_checks(_policy_header(data.hsts_probes))


def spa_table(data: Data) -> DataFrame:
    return C.site_probe_checks(data.spa_probes)


check("hsts_checks", HSTS)(hsts_table)
check("site_probe_checks", SPA)(spa_table)


@check("stale_resources", """SELECT page_id, CAST(ttl AS BIGINT) AS ttl FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 60 WHEN 1 THEN 0 WHEN 2 THEN 3600
    WHEN 3 THEN 1000 WHEN 4 THEN 1000 ELSE 3600 END AS ttl FROM {pages}) AS t WHERE page_id * 10 > ttl""")
def _stale_resources(data: Data) -> DataFrame:
    now = 1704067200 + 10_000
    turn = F.col("page_id") % 6
    name = F.when(turn <= 1, "Cache-Control").when(turn == 2, "X-Other").when(turn == 3, "EXPIRES").when(
        turn == 4, "Last-Modified").otherwise("cache-control")
    value = (F.when(turn == 0, "public, max-age=60").when(turn == 1, "no-store").when(turn == 2, "y")
             .when(turn == 3, "Mon, 01 Jan 2024 03:03:20 GMT").when(turn == 4, "Mon, 01 Jan 2024 00:00:00 GMT")
             .otherwise("max-age=soon"))
    fetches = data.pages.select("page_id", (F.lit(now) - F.col("page_id") * 10).alias("fetched_at"),
                                F.create_map(name, value).alias("headers"))
    return C.stale_resources(fetches, now, 3600).select("page_id", "ttl")


@check("conditional_headers", """SELECT u.url_id, CASE WHEN u.url_id % 3 = 0 AND m.url_id IS NOT NULL THEN md5(CAST(u.url_id AS STRING)) END AS if_none_match,
    m.last_modified AS if_modified_since FROM {urls} u LEFT JOIN {page_metadata} m ON m.url_id = u.url_id""")
def _conditional_headers(data: Data) -> DataFrame:
    return C.conditional_headers(data.urls.select("url_id"), data.page_metadata)


# ---- structured data ----------------------------------------------------------------------

def _source() -> Column:
    return F.col("ordinal.source").alias("source")


def _items(data: Data) -> DataFrame:
    """Items of all pages, written once for the operators that read them more than once."""
    return cut(S.extract_schema(data.parsed("rich_pages")))


@check("extract_schema", "SELECT url, format, type, position, source, severity, errors, errors = 0 AS is_valid FROM {schema_expected}")
def _extract_schema(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("rich_pages"))
    return items.select("url", "format", "type", "position", _source(), "severity",
                        F.size("validation_errors").alias("errors"), "is_valid")


@check("schema_jsonld_data", """SELECT url, type, data FROM (
    SELECT url, 'Article' AS type, '{{"@context":"https://schema.org","@type":"Article","author":"A","headline":"H","url":"'
        || regexp_extract(url, '^(https?://[^/]+)', 1) || '/a/' || CAST(page_id AS STRING) || '"}}' AS data FROM {pages} WHERE page_id % 6 = 0
    UNION ALL SELECT url, 'Product', '{{"@type":"http://schema.org/Product","name":"P' || CAST(page_id AS STRING) || '"}}' FROM {pages} WHERE page_id % 6 = 1
    UNION ALL SELECT url, 'Person', '{{"@type":"Person","name":"N"}}' FROM {pages} WHERE page_id % 6 = 2
    UNION ALL SELECT url, 'Event', '{{"@type":["Event","Thing"],"pageUrl":"bad"}}' FROM {pages} WHERE page_id % 6 = 2
    UNION ALL SELECT url, 'WebPage', '{{"@type":"WebPage","name":"W"}}' FROM {pages} WHERE page_id % 6 = 3
    UNION ALL SELECT url, 'VideoObject', '{{"@type":"VideoObject","description":"D","duration":"PT1M","embedUrl":"http://v/?a&amp;b","image":"i","name":"V","uploadDate":"2024"}}' FROM {pages} WHERE page_id % 6 = 3
    UNION ALL SELECT url, 'InvalidJSON', NULL FROM {pages} WHERE page_id % 6 = 4) AS d""".replace("{{", "{").replace("}}", "}"))
def _schema_jsonld_data(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("rich_pages"), ["json-ld"])
    return items.select("url", "type", F.to_json(F.parse_json("parsed_data")).alias("data"))


@check("schema_microdata_data", """SELECT url, '{"@type":"Organization","name":"Org ' || CAST(page_id AS STRING) || '","url":"'
    || regexp_extract(url, '^(https?://[^/]+)', 1) || '/org/' || CAST(page_id AS STRING) || '"}' AS data,
    '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name"> Org ' || CAST(page_id AS STRING)
    || ' </span><a itemprop="url" href="/org/' || CAST(page_id AS STRING) || '">x</a></div>' AS raw_data FROM {pages} WHERE page_id % 2 = 1""")
def _schema_microdata_data(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("rich_pages"), ["microdata"])
    return items.select("url", F.to_json(F.parse_json("parsed_data")).alias("data"), "raw_data")


@check("schema_rdfa_data", """SELECT url, '{"@type":"Person","name":"Pat ' || CAST(page_id AS STRING) || '"}' AS data,
    '<div vocab="https://schema.org/" typeof="Person"><b property="name">Pat ' || CAST(page_id AS STRING) || '</b></div>' AS raw_data
    FROM {pages} WHERE page_id % 3 = 1""")
def _schema_rdfa_data(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("rich_pages"), ["rdfa"])
    return items.select("url", F.to_json(F.parse_json("parsed_data")).alias("data"), "raw_data")


@check("schema_broken", """SELECT url, format, type, position, CASE type WHEN 'BrokenJSON-LD' THEN '{"@context":"https://schema.org","@type": oops}'
    WHEN 'BrokenMicrodata' THEN '<div itemscope>untyped</div>' ELSE CASE WHEN page_id % 6 = 1 AND position = '0'
        THEN '{"@type":"http://schema.org/Product","name":"P' || CAST(page_id AS STRING) || '"}' ELSE ' see https://schema.org/Thing ' END END AS raw_data
    FROM {schema_expected} WHERE source >= 3""")
def _schema_broken(data: Data) -> DataFrame:
    return S.extract_schema(data.parsed("rich_pages"), ["broken"]).select("url", "format", "type", "position", "raw_data")


@check("dirty_pages_schema", """SELECT url, CASE WHEN page_id % 8 IN (0, 1, 4) THEN 'InvalidJSON' WHEN page_id % 8 IN (5, 6) THEN 'ParseError' ELSE 'Person' END AS type,
    '0' AS position, CASE WHEN page_id % 8 IN (2, 3, 7) THEN 0 ELSE 1 END AS errors,
    CASE page_id % 8 WHEN 2 THEN '{"@type": "Person"}' WHEN 3 THEN '{"@type": "Person", "age": NaN}' WHEN 7 THEN '{"@type": ["Person"], "name": "n"}' END AS data
    FROM {pages}""")
def _dirty_pages_schema(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("dirty_pages"), ["json-ld"])
    return items.select("url", "type", "position", F.size("validation_errors").alias("errors"), F.col("parsed_data").alias("data"))


@check("dirty_pages_content", "SELECT page_id, 'T' || CAST(page_id AS STRING) AS title, 'H' AS h1 FROM {pages}")
def _dirty_pages_content(data: Data) -> DataFrame:
    return P.extract_content(data.parsed("dirty_pages")).select("page_id", "title", F.array_join("h1_tags", "|").alias("h1"))


@check("parse_errors", "SELECT url, '' AS error FROM {pages} WHERE page_id < 0")
def _parse_errors(data: Data) -> DataFrame:
    return P.parse_errors(data.parsed("dirty_pages"))


@check("schema_hash", """SELECT url, type, sha256(data) AS content_hash FROM (
    SELECT url, 'Article' AS type, '{"@context":"https://schema.org","@type":"Article","author":"A","headline":"H"}' AS data FROM {pages} WHERE page_id % 6 = 0
    UNION ALL SELECT url, 'Product', '{"@type":"http://schema.org/Product","name":"P' || CAST(page_id AS STRING) || '"}' FROM {pages} WHERE page_id % 6 = 1
    UNION ALL SELECT url, 'Person', '{"@type":"Person","name":"N"}' FROM {pages} WHERE page_id % 6 = 2
    UNION ALL SELECT url, 'Event', '{"@type":["Event","Thing"],"pageUrl":"bad"}' FROM {pages} WHERE page_id % 6 = 2
    UNION ALL SELECT url, 'WebPage', '{"@type":"WebPage","name":"W"}' FROM {pages} WHERE page_id % 6 = 3
    UNION ALL SELECT url, 'VideoObject', '{"@type":"VideoObject","description":"D","duration":"PT1M","embedUrl":"http://v/?a&amp;b","image":"i","name":"V","uploadDate":"2024"}' FROM {pages} WHERE page_id % 6 = 3) AS d""")
def _schema_hash(data: Data) -> DataFrame:
    items = S.extract_schema(data.parsed("rich_pages"), ["json-ld"]).where("content_hash is not null")
    return items.select("url", "type", "content_hash")


RANKED = """SELECT url, type, position, source, CASE type WHEN 'WebPage' THEN 0 WHEN 'Article' THEN 1 WHEN 'Product' THEN 2 WHEN 'Event' THEN 3
    WHEN 'Organization' THEN 7 WHEN 'Person' THEN 8 ELSE 10 END AS rank FROM {schema_expected}"""
MAIN = f"""SELECT url, type, position, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, source, position) AS rn
    FROM ({RANKED}) AS r) AS m WHERE rn = 1"""


@check("schema_main_entity", f"SELECT url, type, source FROM ({MAIN}) AS m")
def _schema_main_entity(data: Data) -> DataFrame:
    return S.schema_main_entity(S.extract_schema(data.parsed("rich_pages"))).select("url", "type", _source())


@check("schema_roles", f"""SELECT e.url, e.type, e.position, e.source, CASE WHEN m.url IS NOT NULL THEN 'main'
    WHEN e.type IN ('ImageObject', 'VideoObject', 'BreadcrumbList', 'Offer', 'AggregateRating', 'Review', 'Author', 'Publisher', 'Organization') THEN 'property'
    ELSE 'related' END AS role FROM {{schema_expected}} e LEFT JOIN ({MAIN}) AS m
    ON m.url = e.url AND m.type = e.type AND m.position = e.position AND m.source = e.source""")
def _schema_roles(data: Data) -> DataFrame:
    return S.schema_roles(_items(data)).select("url", "type", "position", _source(), "role")


@check("schema_stats", """SELECT 'total_schemas' AS measure, '' AS label, count(*) AS n FROM {schema_expected}
    UNION ALL SELECT 'format', format, count(*) FROM {schema_expected} GROUP BY format
    UNION ALL SELECT 'type', type, count(*) FROM {schema_expected} GROUP BY type
    UNION ALL SELECT 'validity', CASE WHEN errors = 0 THEN 'valid' ELSE 'invalid' END, count(*) FROM {schema_expected} GROUP BY 2
    UNION ALL SELECT 'error', CASE type WHEN 'Product' THEN 'Product missing required ''offers'' property' WHEN 'Event' THEN 'Invalid URL format for pageUrl: bad'
        WHEN 'VideoObject' THEN 'VideoObject embedUrl contains HTML entities that should be decoded' WHEN 'InvalidJSON' THEN 'JSON decode error'
        WHEN 'BrokenJSON-LD' THEN 'Malformed JSON-LD: Invalid JSON syntax' WHEN 'BrokenMicrodata' THEN 'Malformed microdata: itemscope without valid itemtype'
        ELSE 'Schema.org reference in comment without proper structure' END, count(*) FROM {schema_expected} WHERE errors > 0 GROUP BY 2
    UNION ALL SELECT 'error', 'VideoObject uploadDate should be a valid ISO 8601 date string', count(*) FROM {schema_expected} WHERE type = 'VideoObject' HAVING count(*) > 0""")
def _schema_stats(data: Data) -> DataFrame:
    return S.schema_stats(S.extract_schema(data.parsed("rich_pages")))


BLOCK = """CASE page_id % 6 WHEN 0 THEN '{"@context":"https://schema.org","@type":"Article","headline":"H","author":"A","url":"/a/' || CAST(page_id AS STRING) || '"}'
    WHEN 1 THEN '{"@type":"http://schema.org/Product","name":"P' || CAST(page_id AS STRING) || '"}'
    WHEN 2 THEN '[{"@type":"Person","name":"N"},7,{"@type":["Event","Thing"],"pageUrl":"bad"}]'
    WHEN 3 THEN '{"@graph":[{"@type":"WebPage","name":"W"},{"@type":"VideoObject","name":"V","description":"D","embedUrl":"http://v/?a&amp;b","uploadDate":"2024","image":"i","duration":"PT1M"}]}'
    WHEN 4 THEN '{"@context":"https://schema.org","@type": oops}' END"""


# The first page by URL supplies the text of an instance.
@check("schema_instances", f"""SELECT type, format, raw_data FROM (SELECT type, format, key, raw_data, row_number() OVER (PARTITION BY type, format, key ORDER BY url) AS rn FROM (
    SELECT url, type, CASE WHEN format IN ('json-ld', 'microdata', 'rdfa') THEN format ELSE 'json-ld' END AS format,
        CASE WHEN type IN ('Product', 'Organization') OR (type = 'Person' AND format = 'rdfa') OR (type = 'BrokenCommentSchema' AND position = '0' AND page_id % 6 = 1)
            THEN CAST(page_id AS STRING) ELSE 'shared' END AS key,
        CASE type WHEN 'Organization' THEN '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name"> Org ' || CAST(page_id AS STRING)
                || ' </span><a itemprop="url" href="/org/' || CAST(page_id AS STRING) || '">x</a></div>'
            WHEN 'BrokenMicrodata' THEN '<div itemscope>untyped</div>'
            WHEN 'BrokenCommentSchema' THEN CASE WHEN page_id % 6 = 1 AND position = '0' THEN {BLOCK} ELSE ' see https://schema.org/Thing ' END
            ELSE CASE WHEN format = 'rdfa' THEN '<div vocab="https://schema.org/" typeof="Person"><b property="name">Pat ' || CAST(page_id AS STRING) || '</b></div>'
                ELSE {BLOCK} END END AS raw_data
    FROM {{schema_expected}}) AS e) AS r WHERE rn = 1""")
def _schema_instances(data: Data) -> DataFrame:
    return S.schema_instances(S.extract_schema(data.parsed("rich_pages"))).select("type", "format", "raw_data")


@check("schema_references", f"""SELECT e.url, CAST(split_part(e.position, '-', 1) AS BIGINT) AS position, e.source, m.url IS NOT NULL AS is_main_entity,
    CASE WHEN m.url IS NULL AND e.type IN ('VideoObject', 'Organization') THEN lower(e.type) END AS property_name,
    m.url IS NULL AND e.type IN ('VideoObject', 'Organization') AS has_parent FROM {{schema_expected}} e LEFT JOIN ({MAIN}) AS m
    ON m.url = e.url AND m.type = e.type AND m.position = e.position AND m.source = e.source""")
def _schema_references(data: Data) -> DataFrame:
    refs = S.schema_references(_items(data))
    return refs.select("url", "position", _source(), "is_main_entity", "property_name",
                       F.col("parent_ordinal").isNotNull().alias("has_parent"))
