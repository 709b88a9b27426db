"""Crawl tables derived from the shipped tables by arithmetic, as one SQL text for both engines.

`{name}` stands for a table, shipped or derived. `{each:…}` stands for the engine's way to repeat a
row per list element. Conditions such as `page_id % 11 <> 10` make a crawl with the gaps every
crawl has (pages not fetched, pages without a canonical); every page takes part in every table it
would be part of in such a crawl.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from webstrata.sources.readers import spread

BASE = ["events", "documents", "embeddings", "pages"]

EPOCH = 1704067200

DERIVED = {
    # ---- the URL dimension and its satellites ----
    "counted": "SELECT *, (SELECT count(*) FROM {pages}) AS n FROM {pages}",
    "urls": f"""SELECT page_id AS url_id, url, CASE WHEN page_id % 25 = 24 THEN 'sitemap' ELSE 'html' END AS kind,
        CASE page_id % 10 WHEN 6 THEN 'subdomain' WHEN 7 THEN 'network' WHEN 8 THEN 'external' WHEN 9 THEN 'social'
            ELSE 'internal' END AS classification,
        {EPOCH} + page_id * 60 AS first_seen, {EPOCH} + page_id * 90 AS last_seen FROM {{pages}}""",
    "page_metadata": f"""SELECT page_id AS url_id,
        CASE page_id % 8 WHEN 5 THEN 301 WHEN 6 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS initial_status_code,
        CASE page_id % 8 WHEN 6 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS final_status_code,
        CASE WHEN page_id % 8 = 5 THEN (page_id + 1) % n END AS final_url_id,
        CASE WHEN page_id % 8 = 5 THEN (page_id + 1) % n END AS redirect_destination_url_id,
        {EPOCH} + page_id * 30 AS fetched_at,
        CASE WHEN page_id % 3 = 0 THEN '"' || md5(CAST(page_id AS STRING)) || '"' END AS etag,
        CASE WHEN page_id % 4 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified
        FROM {{counted}} WHERE page_id % 11 <> 10""",
    "canonical_urls": """SELECT page_id AS url_id,
        CASE WHEN page_id % 6 = 4 THEN (page_id + 2) % n ELSE page_id END AS canonical_url_id, 'html_head' AS source
        FROM {counted} WHERE page_id % 6 <> 5""",
    "content": """SELECT page_id AS url_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
        CASE WHEN page_id % 3 = 0 THEN 'About ' || CAST(page_id AS STRING) END AS meta_description,
        split(regexp_extract(html, '<h1>(.*?)</h1>', 1) || CASE WHEN page_id % 4 = 0 THEN '~ ~ Second ' ELSE '' END, '~') AS h1_tags,
        split('Part ' || CAST(page_id % 5 AS STRING) || CASE WHEN page_id % 2 = 0 THEN '~More ' ELSE '' END, '~') AS h2_tags,
        (page_id * 37) % 1500 AS word_count, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
        (page_id * 11) % 60 AS internal_links_count, (page_id * 5) % 20 AS external_links_count,
        (page_id * 11) % 30 AS internal_links_unique_count, (page_id * 5) % 10 AS external_links_unique_count,
        page_id % 7 AS crawl_depth, md5(CAST(page_id % 40 AS STRING)) AS content_hash_sha256,
        md5(CAST(page_id % 20 AS STRING)) AS content_hash_simhash, CAST(length(html) AS BIGINT) AS content_length
        FROM {pages} WHERE page_id % 8 < 5""",
    "internal_links": f"""SELECT page_id AS source_url_id, (page_id * 7 + k) % n AS target_url_id,
        (page_id * 7 + k) % n AS href_url_id,
        CASE WHEN (page_id + k) % 11 = 1 THEN '[IMG: logo]' WHEN (page_id + k) % 5 <> 0
            THEN 'anchor ' || CAST((page_id * k) % 13 AS STRING) END AS anchor_text,
        '/html/body/nav/ul/li[' || CAST(k AS STRING) || ']/a' AS xpath,
        CASE WHEN (page_id + k) % 9 = 0 THEN 'top' END AS fragment,
        CASE (page_id + k) % 7 WHEN 0 THEN 'utm_source=feed' WHEN 1 THEN 'page=2' END AS url_parameters,
        {EPOCH} + page_id * 60 + k AS discovered_at FROM (SELECT page_id, n, {{each:1, 2, 3}} AS k FROM {{counted}}) AS x""",
    "frontier": f"""SELECT page_id AS url_id, page_id % 7 AS depth, CASE WHEN page_id > 0 THEN (page_id * 3) % n END AS parent_id,
        CASE page_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'pending' ELSE 'done' END AS status,
        {EPOCH} + (page_id * 13) % 1000 AS enqueued_at, {EPOCH + 3600} + page_id AS updated_at,
        CAST((page_id * 17) % 100 AS DOUBLE) / 100 AS priority_score, CAST(page_id % 11 AS DOUBLE) / 10 AS sitemap_priority,
        page_id % 7 AS reset_count FROM {{counted}} WHERE page_id % 13 <> 12""",
    "indexability_inputs": """SELECT page_id AS url_id, page_id % 9 <> 0 AS robots_txt_allows,
        split(CASE page_id % 5 WHEN 0 THEN 'noindex,nofollow' WHEN 1 THEN 'index' ELSE 'all' END, ',') AS html_meta_directives,
        split(CASE WHEN page_id % 17 = 0 THEN 'noindex' ELSE 'all' END, ',') AS http_header_directives FROM {pages}""",
    "redirects": """SELECT url_id AS source_url_id, final_url_id AS target_url_id, 1 + url_id % 3 AS chain_length, final_status_code
        FROM {page_metadata} WHERE final_url_id IS NOT NULL""",
    "chained_redirects": """SELECT page_id AS source_url_id, CASE WHEN page_id % 100 = 99 THEN page_id - 9 ELSE (page_id + 1) % n END AS target_url_id
        FROM {counted} WHERE page_id % 100 < 50 OR page_id % 100 >= 90""",
    "sitemaps": f"""SELECT DISTINCT page_id % 4 AS sitemap_id,
        'https://example.com/sitemap-' || CAST(page_id % 4 AS STRING) || '.xml' AS sitemap_url,
        100 + page_id % 4 AS total_urls_found, page_id % 4 = 3 AS is_sitemap_index, {EPOCH} AS discovered_at FROM {{pages}}""",
    "url_sitemaps": f"""SELECT page_id AS url_id, page_id % 4 AS sitemap_id, page_id AS position, {EPOCH} + page_id AS discovered_at
        FROM {{pages}} WHERE page_id % 3 <> 2""",
    "hreflang_sitemap": """SELECT page_id AS url_id, CASE k WHEN 1 THEN 'en' WHEN 2 THEN 'de' ELSE 'x-default' END AS language_code,
        (page_id + k - 1) % n AS href_url_id FROM (SELECT page_id, n, {each:1, 2, 3} AS k FROM {counted}) AS x WHERE page_id % 2 = 0""",
    "hreflang_html_head": """SELECT page_id AS url_id, CASE k WHEN 1 THEN 'fr' ELSE 'x-default' END AS language_code,
        (page_id + (k - 1) * 3) % n AS href_url_id FROM (SELECT page_id, n, {each:1, 2} AS k FROM {counted}) AS x WHERE page_id % 3 = 0""",
    "schema_instances": """SELECT DISTINCT md5(CAST((page_id * k) % 12 AS STRING)) AS content_hash,
        CASE (page_id * k) % 12 % 5 WHEN 0 THEN 'Article' WHEN 1 THEN 'Product' WHEN 2 THEN 'Organization' WHEN 3 THEN 'WebPage'
            ELSE 'ImageObject' END AS type,
        CASE (page_id * k) % 12 % 3 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'microdata' ELSE 'rdfa' END AS format,
        'raw ' || CAST((page_id * k) % 12 AS STRING) AS raw_data, (page_id * k) % 12 < 9 AS is_valid,
        CASE WHEN (page_id * k) % 12 < 9 THEN '[]' ELSE '["missing"]' END AS validation_errors,
        CASE WHEN (page_id * k) % 12 < 9 THEN 'info' ELSE 'error' END AS severity
        FROM (SELECT page_id, {each:1, 2, 3} AS k FROM {pages}) AS x""",
    "schema_references": f"""SELECT page_id AS url_id, k AS ordinal, md5(CAST((page_id * k) % 12 AS STRING)) AS content_hash,
        k * 10 AS position, CASE WHEN k = 2 THEN 'organization' END AS property_name, k = 1 AS is_main_entity,
        CASE WHEN k = 2 THEN 1 END AS parent_ordinal, {EPOCH} + page_id AS discovered_at
        FROM (SELECT page_id, {{each:1, 2, 3}} AS k FROM {{pages}}) AS x WHERE page_id % 4 <> 3""",
    # ---- fetch log ----
    "fetch_log": """SELECT event_id, ts, 'h' || CAST(user_id % 20 AS STRING) || '.example.com' AS host,
        'https://h' || CAST(user_id % 20 AS STRING) || '.example.com/u/' || CAST(event_id % 50 AS STRING) AS url,
        CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'view' THEN 304 ELSE 200 END AS status FROM {events}""",
    # ---- two crawls of one site ----
    "origin": """SELECT page_id AS url_id, 'https://example.com/p/' || CAST(page_id AS STRING) AS url, 'internal' AS classification,
        'T' || CAST(page_id % 30 AS STRING) AS title, CASE WHEN page_id % 7 <> 0 THEN 'H' || CAST(page_id % 9 AS STRING) END AS h1,
        CASE WHEN page_id % 4 <> 0 THEN 'D' || CAST(page_id % 11 AS STRING) END AS meta_description, (page_id * 37) % 1500 AS word_count FROM {pages} WHERE page_id % 5 <> 4""",
    "staging": """SELECT page_id AS url_id, 'https://staging.example.com/p/' || CAST(page_id AS STRING) AS url,
        'internal' AS classification, 'T' || CAST(page_id % 29 AS STRING) AS title,
        CASE WHEN page_id % 6 <> 0 THEN 'H' || CAST(page_id % 9 AS STRING) END AS h1,
        CASE WHEN page_id % 6 <> 0 THEN 'D' || CAST(page_id % 22 AS STRING) END AS meta_description, (page_id * 37) % 1501 AS word_count FROM {pages} WHERE page_id % 4 <> 3""",
    "moved": """SELECT 'https://example.com/p/' || CAST(page_id AS STRING) AS source_url,
        'https://example.com/p/' || CAST(page_id + 1 AS STRING) AS target_url FROM {pages} WHERE page_id % 9 = 0""",
    "origin_links": """SELECT 'https://example.com/p/' || CAST(page_id AS STRING) AS source_url,
        'https://example.com/p/' || CAST((page_id * k) % n AS STRING) AS target_url
        FROM (SELECT page_id, n, {each:2, 3, 5} AS k FROM {counted}) AS x""",
    "staging_links": """SELECT 'https://staging.example.com/p/' || CAST(page_id AS STRING) AS source_url,
        'https://staging.example.com/p/' || CAST((page_id * k) % n AS STRING) AS target_url
        FROM (SELECT page_id, n, {each:3, 5, 7} AS k FROM {counted}) AS x""",
    # ---- raw inputs of the parsers ----
    "hosts": """SELECT regexp_extract(url, '://([^/]+)', 1) AS host, min(page_id) AS first_id, count(*) AS pages FROM {pages}
        GROUP BY regexp_extract(url, '://([^/]+)', 1)""",
    "robots_files": """SELECT host AS domain, '# rules of ' || host || chr(10) || 'Disallow: /ignored' || chr(10)
        || 'User-agent: *' || chr(10) || 'Disallow: /de/*' || chr(10) || 'Allow: /en/1' || chr(10)
        || 'Crawl-delay: ' || CASE WHEN first_id % 3 = 0 THEN 'soon' ELSE CAST(first_id % 5 AS STRING) END || chr(13) || chr(10)
        || 'USER-AGENT: strata' || chr(10) || CASE WHEN first_id % 2 = 0 THEN 'Disallow: /en/2' ELSE 'Allow: /de/3' END || chr(10)
        || 'Crawl-delay: ' || CAST(first_id % 4 AS STRING) || chr(10)
        || CASE WHEN first_id % 4 <> 1 THEN 'Sitemap: https://' || host || '/map.xml' || chr(10) ELSE '' END AS body FROM {hosts}""",
    "entries": """SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS host, CAST(floor(page_id / 500) AS BIGINT) AS shard FROM {pages}""",
    "leaf_files": """SELECT 'https://' || host || '/map-' || CAST(shard AS STRING) || '.xml' AS sitemap_url, host, shard,
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">'
        || string_agg('<url><loc> ' || replace(url, '&', '&amp;') || ' </loc><priority>'
            || CASE WHEN page_id % 7 = 0 THEN 'high' ELSE '0.' || CAST(page_id % 10 AS STRING) END || '</priority>'
            || CASE WHEN page_id % 2 = 0 THEN '<lastmod>2024-01-0' || CAST(1 + page_id % 9 AS STRING) || '</lastmod>' ELSE '' END
            || CASE WHEN page_id % 3 = 0 THEN '<xhtml:link rel="alternate" hreflang="de" href="https://de.example.org/'
                || CAST(page_id AS STRING) || '"/><xhtml:link rel="alternate" hreflang="x-default" href="https://example.org/'
                || CAST(page_id AS STRING) || '"/>' ELSE '' END || '</url>', '') WITHIN GROUP (ORDER BY page_id) || '</urlset>' AS xml
        FROM {entries} GROUP BY host, shard""",
    "index_files": """SELECT 'https://' || host || '/map.xml' AS sitemap_url, '<?xml version="1.0"?><sitemapindex>'
        || string_agg('<sitemap><loc>' || sitemap_url || '</loc></sitemap>', '') WITHIN GROUP (ORDER BY shard) || '<sitemap><loc>https://' || host
        || '/map.xml</loc></sitemap></sitemapindex>' AS xml FROM {leaf_files} GROUP BY host""",
    "sitemap_files": """SELECT sitemap_url, xml FROM {leaf_files} UNION ALL SELECT sitemap_url, xml FROM {index_files}
        UNION ALL SELECT 'https://' || host || '/sitemap.xml' AS sitemap_url, '<urlset></urlset>' AS xml FROM {hosts} WHERE first_id % 4 = 1""",
    "rich_pages": """SELECT page_id, url, replace(replace(html, '</head>',
        CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content=" About ' || CAST(page_id AS STRING) || ' &amp; more ">' ELSE '' END
        || CASE page_id % 5 WHEN 0 THEN '<meta name="robots" content="NoIndex, nofollow">' WHEN 1 THEN '<meta name=robots content=index>' ELSE '' END
        || CASE page_id % 4 WHEN 0 THEN '<link rel="canonical" href=" /c/' || CAST(page_id AS STRING) || ' ">'
            WHEN 1 THEN '<link rel="shortcut canonical" href="https://www.example.org/c/' || CAST(page_id AS STRING) || '">'
            WHEN 2 THEN '<link href="//cdn.example.org/c/' || CAST(page_id AS STRING) || '" rel="canonical">' ELSE '' END
        || CASE WHEN page_id % 2 = 0 THEN '<link rel="alternate" hreflang="de" href="/de/' || CAST(page_id AS STRING)
            || '"><link rel="alternate" hreflang="x-default" href="https://www.example.org/' || CAST(page_id AS STRING) || '">' ELSE '' END
        || CASE page_id % 6
            WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"H","author":"A","url":"/a/' || CAST(page_id AS STRING) || '"}</script>'
            WHEN 1 THEN '<script type="application/ld+json">{"@type":"http://schema.org/Product","name":"P' || CAST(page_id AS STRING) || '"}</script>'
            WHEN 2 THEN '<script type="application/ld+json">[{"@type":"Person","name":"N"},7,{"@type":["Event","Thing"],"pageUrl":"bad"}]</script>'
            WHEN 3 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"W"},{"@type":"VideoObject","name":"V","description":"D","embedUrl":"http://v/?a&amp;b","uploadDate":"2024","image":"i","duration":"PT1M"}]}</script>'
            WHEN 4 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type": oops}</script>'
            ELSE '' END || '</head>'), '<footer>',
        '<h2>Part ' || CAST(page_id AS STRING) || '</h2><a href="https://twitter.com/s/' || CAST(page_id AS STRING)
        || '"><img src="/i/share.png" alt=" Share ' || CAST(page_id AS STRING) || '"></a><a href="../up?b=2&amp;a=1&amp;utm_source=x#sec" title="Up ' || CAST(page_id AS STRING)
        || '"></a><a href="/files/data-sheet_' || CAST(page_id AS STRING) || '.pdf"></a>'
        || CASE WHEN page_id % 2 = 1 THEN '<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name"> Org ' || CAST(page_id AS STRING)
            || ' </span><a itemprop="url" href="/org/' || CAST(page_id AS STRING) || '">x</a></div>' ELSE '' END
        || CASE WHEN page_id % 3 = 1 THEN '<div vocab="https://schema.org/" typeof="Person"><b property="name">Pat ' || CAST(page_id AS STRING) || '</b></div>' ELSE '' END
        || CASE WHEN page_id % 7 = 0 THEN '<div itemscope>untyped</div>' ELSE '' END
        || CASE WHEN page_id % 7 = 1 THEN '<!-- see https://schema.org/Thing -->' ELSE '' END || '<footer>') AS html FROM {pages}""",
    # Markup no parser takes, and text that is nearly JSON.
    "dirty_pages": """SELECT page_id, url, '<html><head><title>T' || CAST(page_id AS STRING) || '</title><script type="application/ld+json">'
        || CASE page_id % 8 WHEN 0 THEN '{"@type":"Product","name":"a","offers":1};' WHEN 1 THEN '{"@type":"A"}{"@type":"B"}'
            WHEN 2 THEN '{"@type":"A","@type":"Person"}' WHEN 3 THEN '{"@type":"Person","age":NaN}' WHEN 4 THEN '[{"@type":"A"}] x'
            WHEN 5 THEN repeat('[', 100000) WHEN 6 THEN '{"@type":{"a":1}}' ELSE '{"@type":["Person"],"name":"n"}' END
        || '</script></head><body><![foo[ x ]]><h1>H</h1>' || CASE WHEN page_id % 3 = 0 THEN '<![ x' ELSE '</body></html>' END AS html FROM {pages}""",
    "schema_expected": """
        SELECT url, page_id, 'json-ld' AS format, 'Article' AS type, '0' AS position, 0 AS source, 'info' AS severity, 0 AS errors FROM {pages} WHERE page_id % 6 = 0
        UNION ALL SELECT url, page_id, 'json-ld', 'Product', '0', 0, 'error', 1 FROM {pages} WHERE page_id % 6 = 1
        UNION ALL SELECT url, page_id, 'json-ld', 'Person', '0', 0, 'info', 0 FROM {pages} WHERE page_id % 6 = 2
        UNION ALL SELECT url, page_id, 'json-ld', 'Event', '2', 0, 'warning', 1 FROM {pages} WHERE page_id % 6 = 2
        UNION ALL SELECT url, page_id, 'json-ld', 'WebPage', '0-0', 0, 'info', 0 FROM {pages} WHERE page_id % 6 = 3
        UNION ALL SELECT url, page_id, 'json-ld', 'VideoObject', '0-1', 0, 'warning', 2 FROM {pages} WHERE page_id % 6 = 3
        UNION ALL SELECT url, page_id, 'json-ld', 'InvalidJSON', '0', 0, 'info', 1 FROM {pages} WHERE page_id % 6 = 4
        UNION ALL SELECT url, page_id, 'microdata', 'Organization', '0', 1, 'info', 0 FROM {pages} WHERE page_id % 2 = 1
        UNION ALL SELECT url, page_id, 'rdfa', 'Person', '0', 2, 'info', 0 FROM {pages} WHERE page_id % 3 = 1
        UNION ALL SELECT url, page_id, 'json-ld', 'BrokenJSON-LD', '0', 3, 'info', 1 FROM {pages} WHERE page_id % 6 = 4
        UNION ALL SELECT url, page_id, 'microdata', 'BrokenMicrodata', CAST(page_id % 2 AS STRING), 4, 'info', 1 FROM {pages} WHERE page_id % 7 = 0
        UNION ALL SELECT url, page_id, 'comment', 'BrokenCommentSchema', CASE WHEN page_id % 6 IN (0, 1, 4) THEN '1' ELSE '0' END, 7, 'info', 1 FROM {pages} WHERE page_id % 7 = 1
        UNION ALL SELECT url, page_id, 'comment', 'BrokenCommentSchema', '0', 7, 'info', 1 FROM {pages} WHERE page_id % 6 = 1""",
    "hsts_probes": """SELECT host AS base_domain, 1000 + k AS checked_at, probe, probe || '://' || host || '/' AS url,
        CASE WHEN first_id % 5 = 4 THEN 500 ELSE 200 END AS status,
        CASE WHEN probe = 'http' AND first_id % 3 = 0 THEN 'http://' || host || '/' ELSE 'https://' || host || '/' END AS final_url,
        CASE WHEN probe = 'https' THEN CASE first_id % 4 WHEN 0 THEN 'max-age=31536000; includeSubDomains; preload'
            WHEN 1 THEN 'max-age="300"; preload' WHEN 2 THEN 'includeSubDomains; max-age=x' END END AS policy
        FROM (SELECT host, first_id, k, {each:'https', 'http'} AS probe FROM (SELECT host, first_id, {each:1, 2} AS k FROM {hosts}) AS x) AS y""",
    "spa_probes": """SELECT host AS base_domain, 2000 + first_id % 7 AS checked_at, probe,
        CASE WHEN first_id % 3 = 0 THEN 'https://' || host || '/' ELSE 'https://' || host || '/en/start#top' END AS start_url,
        CASE WHEN probe = 'random' THEN 'https://' || host || '/nope' ELSE 'https://' || host || '/EN/start' END AS url,
        CASE WHEN probe = 'random' AND first_id % 2 = 0 THEN 404 ELSE 200 END AS status,
        CASE WHEN probe = 'random' THEN 'https://' || host || '/nope' WHEN first_id % 4 = 1 THEN 'https://' || host || '/en/start'
            ELSE 'https://' || host || '/EN/start' END AS final_url,
        CASE WHEN probe = 'case' AND first_id % 4 = 2 THEN 'https://' || host || '/en/start' END AS canonical_url,
        CASE WHEN first_id % 4 = 1 THEN 1 ELSE 0 END AS redirects
        FROM (SELECT host, first_id, {each:'random', 'case'} AS probe FROM {hosts}) AS x WHERE first_id % 5 <> 3""",
}


def _fill(sql: str, each, table) -> str:
    sql = re.sub(r"\{each:([^}]*)\}", lambda m: each(m.group(1)), sql)
    return re.sub(r"\{(\w+)\}", lambda m: table(m.group(1)), sql)


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


class Data:
    """Shipped and derived tables of one scale factor as frames: `data.urls`, `data.pages`, …"""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._frames = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name not in DERIVED:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = DERIVED[name]
        text = _fill(sql, lambda items: f"explode(array({items}))", lambda t: f"<<{t}>>")
        # spark.sql formats its text, so braces that are data are doubled.
        text = re.sub(r"<<(\w+)>>", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(_needs(sql))})

    def parsed(self, name: str) -> DataFrame:
        """A table about to be parsed or hashed, spread over all cores."""
        return spread(getattr(self, name), self.spark.sparkContext.defaultParallelism)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}


def with_derived(sql: str) -> str:
    """The DuckDB text of a query over `{table}` placeholders: derived tables become CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in order:
            for need in _needs(DERIVED[name]):
                visit(need)
            order.append(name)

    for name in _needs(sql):
        visit(name)

    def duck(text: str) -> str:
        return _fill(text, lambda items: f"unnest([{items}])", lambda t: t)

    body = duck(sql).strip().replace("\\p<L>", "\\p{L}").replace("\\p<N>", "\\p{N}")
    ctes = ", ".join(f"{n} AS ({duck(DERIVED[n])})" for n in order)
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes}, " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes}, " + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {ctes} {body}"
