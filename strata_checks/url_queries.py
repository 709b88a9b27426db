"""URL operators over the page table and links derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.registry import check
from webstrata.functions import urls as U
from webstrata.functions.headers import essential_headers
from webstrata.operators.robots import parse_robots
from webstrata.operators.url_jobs import canonicalize_urls, classify_urls, scope_urls, should_crawl

# Shapes of href a page can contain, built from its own links: how, and what they resolve to.
HREFS = """SELECT page_id, url, i, href, raw, regexp_extract(url, '^(https?)', 1) AS scheme,
    regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM (
    SELECT page_id, url, i, regexp_extract(html, '<a href="(/[^"]*)"', 1) AS raw,
    CASE i WHEN 1 THEN regexp_extract(html, '<a href="(/[^"]*)"', 1) WHEN 2 THEN '../x' || CAST(page_id AS STRING) || '/./y'
        WHEN 3 THEN 'next?p=' || CAST(page_id AS STRING) || '#end' WHEN 4 THEN '?p=1' WHEN 5 THEN '//cdn.example.com/a'
        WHEN 6 THEN 'HTTPS://other.example.org/B?q=1#f' ELSE '#top' END AS href
    FROM (SELECT page_id, url, html, {each:1, 2, 3, 4, 5, 6, 7} AS i FROM {pages}) AS x) AS y"""


def _hrefs(data: Data):
    """Each page once per shape of href."""
    shapes = {1: F.regexp_extract("html", '<a href="(/[^"]*)"', 1),
              2: F.concat(F.lit("../x"), F.col("page_id").cast("string"), F.lit("/./y")),
              3: F.concat(F.lit("next?p="), F.col("page_id").cast("string"), F.lit("#end")),
              4: F.lit("?p=1"), 5: F.lit("//cdn.example.com/a"),
              6: F.lit("HTTPS://other.example.org/B?q=1#f"), 7: F.lit("#top")}
    options = F.array(*[F.struct(F.lit(i).alias("i"), h.alias("href")) for i, h in shapes.items()])
    return data.pages.select("page_id", "url", F.explode(options).alias("_h")).select("page_id", "url", "_h.*")


@check("resolve_url", f"""SELECT page_id, i, CASE i WHEN 1 THEN site || href WHEN 2 THEN site || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'x' || CAST(page_id AS STRING) || '/y'
    WHEN 3 THEN site || regexp_replace(path, '[^/]*$', '') || 'next?p=' || CAST(page_id AS STRING) WHEN 4 THEN site || path || '?p=1'
    WHEN 5 THEN scheme || '://cdn.example.com/a' WHEN 6 THEN 'https://other.example.org/B?q=1'
    ELSE regexp_replace(url, '#.*$', '') END AS resolved FROM ({HREFS}) AS h""")
def _resolve_url(data: Data):
    return _hrefs(data).select("page_id", "i", U.resolve_url("url", "href").alias("resolved"))


@check("url_components", f"""SELECT page_id, i, CASE i WHEN 1 THEN site || href WHEN 2 THEN site || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'x' || CAST(page_id AS STRING) || '/y'
    WHEN 3 THEN site || regexp_replace(path, '[^/]*$', '') || 'next' WHEN 5 THEN '//cdn.example.com/a'
    WHEN 6 THEN 'https://other.example.org/B' ELSE url END AS href,
    CASE i WHEN 3 THEN 'end' WHEN 6 THEN 'f' WHEN 7 THEN 'top' END AS url_fragment,
    CASE i WHEN 3 THEN 'p=' || CAST(page_id AS STRING) WHEN 4 THEN 'p=1' WHEN 6 THEN 'q=1' END AS url_parameters,
    i IN (5, 6) AS is_absolute FROM ({HREFS}) AS h""")
def _url_components(data: Data):
    parts = _hrefs(data).select("page_id", "i", U.url_components("href", "url").alias("c"))
    return parts.select("page_id", "i", "c.*")


@check("fix_protocol_relative", f"""SELECT page_id, i, CASE WHEN i = 5 THEN 'https:' || href ELSE href END AS href
    FROM ({HREFS}) AS h""")
def _fix_protocol_relative(data: Data):
    return _hrefs(data).select("page_id", "i", U.fix_protocol_relative("href").alias("href"))


# Spellings under which a page may be linked; all lead to one canonical URL.
SPELLINGS = """SELECT page_id, k, CASE k WHEN 1 THEN url WHEN 2 THEN upper(scheme) || '://' || upper(host)
    || CASE scheme WHEN 'http' THEN ':80' ELSE ':443' END || rest || '#part'
    ELSE scheme || '://' || host || rest || CASE WHEN rest LIKE '%?%' THEN '&' ELSE '?' END || 'UTM_Medium=mail' END AS url, scheme, host, rest
    FROM (SELECT page_id, url, k, regexp_extract(url, '^(https?)://([^/]+)([^#]*)', 1) AS scheme,
        regexp_extract(url, '^(https?)://([^/]+)([^#]*)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)([^#]*)', 3) AS rest
        FROM (SELECT page_id, url, {each:1, 2, 3} AS k FROM {pages}) AS x) AS y"""
CANONICAL = "scheme || '://' || host || replace(rest, '?utm_source=feed', '')"


def _spellings(data: Data):
    parts = U.split_url("url")
    rest = F.regexp_extract("url", "^https?://[^/]+([^#]*)", 1)
    port = F.when(parts["scheme"] == "http", ":80").otherwise(":443")
    joiner = F.when(rest.contains("?"), "&").otherwise("?")
    spelled = F.array(
        F.col("url"),
        F.concat(F.upper(parts["scheme"]), F.lit("://"), F.upper(parts["netloc"]), port, rest, F.lit("#part")),
        F.concat(parts["scheme"], F.lit("://"), parts["netloc"], rest, joiner, F.lit("UTM_Medium=mail")))
    return data.pages.select("page_id", F.posexplode(spelled).alias("k", "url")).withColumn("k", F.col("k") + 1)


@check("normalize_url_hardened", f"SELECT page_id, k, {CANONICAL} AS normalized FROM ({SPELLINGS}) AS s")
def _normalize_url_hardened(data: Data):
    return _spellings(data).select("page_id", "k", U.normalize_url_hardened("url").alias("normalized"))


@check("normalize_url_for_storage", f"""SELECT page_id, k, CASE k WHEN 1 THEN scheme || '://' || host || rest
    WHEN 2 THEN scheme || '://' || host || CASE scheme WHEN 'http' THEN ':80' ELSE ':443' END || rest
    ELSE url END AS normalized FROM ({SPELLINGS}) AS s""")
def _normalize_url_for_storage(data: Data):
    return _spellings(data).select("page_id", "k", U.normalize_url_for_storage("url").alias("normalized"))


@check("canonicalize_urls", f"""SELECT {CANONICAL} AS canonical_url, count(DISTINCT url) AS variants, count(*) AS occurrences,
    min(1000 + page_id) AS first_seen, max(1000 + page_id) AS last_seen FROM ({SPELLINGS}) AS s GROUP BY {CANONICAL}""")
def _canonicalize_urls(data: Data):
    seen = _spellings(data).select("url", (F.col("page_id") + 1000).alias("seen_at"))
    return canonicalize_urls(seen)


@check("classify_kind", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'html'
    WHEN 2 THEN CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'asset' ELSE 'other' END ELSE 'other' END AS kind FROM {pages}""")
def _classify_kind(data: Data):
    turn, ending = F.col("page_id") % 4, F.col("page_id") % 3
    content_type = F.when(turn == 0, "application/XML+sitemap").when(turn == 1, "Text/HTML; charset=utf-8")
    url = F.when(turn == 2, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(ending == 0, "/a.JPG").when(
        ending == 1, "/a.woff2").otherwise("/a"))).otherwise(F.concat("url", F.lit("x")))
    return data.pages.select("page_id", U.classify_kind(content_type, url).alias("kind"))


@check("classify_url", r"""SELECT page_id, CASE
    WHEN page_id % 6 = 0 THEN 'social' WHEN regexp_replace(host, '^www\.', '') = 'free-bets.example.com' THEN 'internal'
    WHEN host LIKE '%.free-bets.example.com' THEN 'subdomain' WHEN page_id % 2 = 1 THEN 'network' ELSE 'external' END AS classification
    FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM {pages}) AS p""")
def _classify_url(data: Data):
    url = F.when(F.col("page_id") % 6 == 0, F.regexp_replace("url", "://[^/]+", "://M.Facebook.com")).otherwise(F.col("url"))
    return data.pages.select("page_id", U.classify_url(
        url, "www.free-bets.example.com", F.col("page_id") % 2 == 1).alias("classification"))


@check("classify_urls", r"""SELECT url, 'html' AS kind, CASE WHEN regexp_replace(host, '^www\.', '') = 'example.net' THEN 'internal'
    WHEN host LIKE '%.example.net' THEN 'subdomain' ELSE 'external' END AS classification,
    regexp_replace(regexp_replace(host, '^www\.', ''), '[^a-z0-9_]', '_', 'g') AS site FROM (SELECT url, regexp_extract(url, '://([^/]+)', 1) AS host FROM {pages}) AS p""")
def _classify_urls(data: Data):
    typed = data.pages.select("url", F.lit("text/html").alias("content_type"))
    return classify_urls(typed, "example.net").drop("content_type")


@check("site_key", r"""SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\.', ''),
    '[^a-z0-9_]', '_', 'g') AS site FROM {pages}""")
def _site_key(data: Data):
    return data.pages.select("url", U.site_key("url").alias("site"))


@check("essential_headers", """SELECT page_id, 'content-type=text/html;etag="' || CAST(page_id AS STRING) || '"'
    || CASE WHEN page_id % 2 = 0 THEN ';server=s' || CAST(page_id AS STRING) ELSE '' END AS headers FROM {pages}""")
def _essential_headers(data: Data):
    page = F.col("page_id").cast("string")
    given = F.create_map(F.lit("ETag"), F.concat(F.lit(' "'), page, F.lit('"')), F.lit("Content-Type"), F.lit("text/html "),
                         F.when(F.col("page_id") % 2 == 0, "Server").otherwise("X-Powered-By"), F.concat(F.lit("s"), page))
    entries = F.array_sort(F.map_entries(essential_headers(given)))
    return data.pages.select("page_id", F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


@check("to_staging", """SELECT url, replace(replace(url, 'https://therin.example.net', 'https://staging.example.net'),
    'http://therin.example.net', 'http://staging.example.net') AS staging_url FROM {pages}""")
def _to_staging(data: Data):
    return data.pages.select("url", U.to_staging("url", "therin.example.net", "staging.example.net").alias("staging_url"))


@check("scope_urls", r"""SELECT url, host = 'therin.example.net' AS same_host,
    (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '%en%' AND path NOT LIKE '/en/2%' AND path NOT LIKE '/fr%' AS in_scope
    FROM (SELECT url, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path FROM {pages}) AS p""")
def _scope_urls(data: Data):
    return scope_urls(data.pages.select("url"), "therin.example.net", ["/en/2", "fr"], "en", ["example.net"])


@check("should_crawl", r"""SELECT url, CASE WHEN path LIKE '/fr%' THEN false
    WHEN classification = 'internal' AND path NOT LIKE '%e%' THEN true
    WHEN classification IN ('internal', 'network') THEN
        NOT ((first_id % 2 = 0 AND path LIKE '/en/2%') OR (path LIKE '/de/%' AND NOT (first_id % 2 = 1 AND path LIKE '/de/3%')))
    ELSE classification = 'external' END AS should_crawl
    FROM (SELECT u.url, u.classification, h.first_id, regexp_extract(u.url, '://[^/]+([^?#]*)', 1) AS path
        FROM {urls} u JOIN {hosts} h ON h.host = regexp_extract(u.url, '://([^/]+)', 1)) AS p""")
def _should_crawl(data: Data):
    return should_crawl(data.urls.select("url", "classification"), parse_robots(data.robots_files), "strata",
                        allow_external=True, excludes=["/fr"], restriction="e").select("url", "should_crawl")


@check("should_crawl_listed", """SELECT url, url LIKE '%/en/%' AS should_crawl FROM {pages}""")
def _should_crawl_listed(data: Data):
    wanted = data.pages.where(F.col("url").contains("/en/")).select("url")
    return should_crawl(data.pages.select("url"), parse_robots(data.robots_files), "strata", url_list=wanted)
