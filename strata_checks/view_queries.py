"""Analysis views, current and legacy, over the derived crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_checks.derived import Data
from strata_checks.page_queries import HSTS, SPA, hsts_table, spa_table
from strata_checks.registry import check
from webstrata.operators import tables as E
from webstrata.plans import registry as R
from webstrata.plans import views as V

NAMES = ["urls", "frontier", "content", "page_metadata", "canonical_urls", "internal_links", "sitemaps", "url_sitemaps",
         "hreflang_sitemap", "hreflang_html_head", "schema_instances", "schema_references", "redirects"]

INDEXABILITY = """SELECT v.url_id, v.robots_txt_allows, v.url_id % 5 <> 0 AS html_meta_allows, v.url_id % 17 <> 0 AS http_header_allows,
    CASE WHEN v.robots_txt_allows THEN '' ELSE 'disallow' END AS robots_txt_directives,
    CASE v.url_id % 5 WHEN 0 THEN 'noindex,nofollow' WHEN 1 THEN 'index' ELSE 'all' END AS html_meta_directives,
    CASE WHEN v.url_id % 17 = 0 THEN 'noindex' ELSE 'all' END AS http_header_directives,
    CASE WHEN m.initial_status_code IS NULL OR m.initial_status_code <> 200 THEN false
        WHEN c.url_id IS NULL THEN NULL WHEN c.canonical_url_id <> c.url_id THEN false
        ELSE v.robots_txt_allows AND v.url_id % 5 <> 0 AND v.url_id % 17 <> 0 END AS overall_indexable
    FROM {indexability_inputs} v LEFT JOIN {page_metadata} m ON m.url_id = v.url_id LEFT JOIN {canonical_urls} c ON c.url_id = v.url_id"""


def indexability_table(data: Data) -> DataFrame:
    return E.indexability(data.indexability_inputs, data.page_metadata, data.canonical_urls)


check("indexability", INDEXABILITY)(indexability_table)


def crawl_tables(data: Data) -> dict[str, DataFrame]:
    return {**data.tables(*NAMES), "indexability": indexability_table(data)}


def _first_true(*cases: tuple[str, str]) -> str:
    """The label of the first condition that holds, else null."""
    return "coalesce(" + ", ".join(f"if({condition}, '{label}', NULL)" for condition, label in cases) + ")"


def _headings(column: str) -> str:
    return f"[trim(h) FOR h IN coalesce(c.{column}, []) IF trim(h) <> '']"


def _overview_sql(hreflang: str, legacy: bool = False) -> str:
    """Pages with one pre-grouped relation per kind of fact. The legacy form keeps URLs with
    fragments and every redirect, and forgives a trailing slash in the page's own language."""
    reason = _first_true(("NOT i.robots_txt_allows", "blocked by robots.txt"), ("NOT i.html_meta_allows", "blocked by meta robots"),
                         ("NOT i.http_header_allows", "blocked by HTTP headers"), ("m.initial_status_code <> 200", "not 200 status"),
                         ("can.elsewhere", "not self canonical"), ("true", "unknown reason"))
    same_page = "rtrim(a.url, '/') = rtrim(b.url, '/')" if legacy else "h.href_url_id = h.url_id"
    shown = {
        "url": "u.url", "crawl_status": "coalesce(f.status, 'unknown')", "status_code": "m.initial_status_code",
        "indexable": "i.overall_indexable", "indexability_reason": f"if(NOT i.overall_indexable, {reason}, NULL)",
        "type": "u.kind", "classification": "u.classification", "title": "c.title", "meta_description": "c.meta_description",
        "h1_1": f"{_headings('h1_tags')}[1]", "h1_2": f"{_headings('h1_tags')}[2]", "h1_count": f"len({_headings('h1_tags')})",
        "h2_tags": f"nullif(array_to_string({_headings('h2_tags')}, ', '), '')", "h2_count": f"len({_headings('h2_tags')})",
        **{n: f"c.{n}" for n in ("word_count", "html_lang", "internal_links_count", "external_links_count",
                                 "internal_links_unique_count", "external_links_unique_count", "crawl_depth")},
        "inlinks_count": "coalesce(inl.n, 0)", "inlinks_unique_count": "coalesce(inl.pages, 0)",
        **{n: f"i.{n}" for n in ("robots_txt_allows", "html_meta_allows", "http_header_allows")},
        **{n: f"coalesce(i.{n}, '')" for n in ("robots_txt_directives", "html_meta_directives", "http_header_directives")},
        "canonical_urls": "can.targets", "canonical_sources": "can.sources",
        "redirect_destination_url": "d.url" if legacy else "if(m.initial_status_code IN (301, 302, 303, 307, 308), d.url, NULL)",
    }
    if legacy:
        shown["self_hreflang"] = "own.language"
    else:
        shown.update({
            "self_hreflang_language": "own.language", "hreflang_count": "coalesce(alt.n, 0)", "x_default_hreflang_url": "def.url",
            "main_schema_types": "sch.types", "main_schema_count": "coalesce(sch.mains, 0)", "total_schema_count": "coalesce(sch.n, 0)",
            **{n: f"c.{n}" for n in ("content_hash_sha256", "content_hash_simhash", "content_length")},
            "first_seen": "u.first_seen", "last_seen": "u.last_seen", "fetched_at": "m.fetched_at",
            "enqueued_at": "f.enqueued_at", "updated_at": "f.updated_at"})
    columns = ", ".join(f"{value} AS {name}" for name, value in shown.items())
    fragments = "" if legacy else "AND NOT contains(u.url, '#')"
    return f"""WITH i AS ({INDEXABILITY}),
    inl AS (SELECT target_url_id AS url_id, count(*) AS n, count(DISTINCT source_url_id) AS pages FROM {{internal_links}} GROUP BY ALL),
    can AS (SELECT c.url_id, string_agg(DISTINCT t.url, ',' ORDER BY t.url) AS targets, string_agg(DISTINCT c.source, ',' ORDER BY c.source) AS sources,
        bool_or(c.canonical_url_id <> c.url_id) AS elsewhere FROM {{canonical_urls}} c LEFT JOIN {{urls}} t ON t.url_id = c.canonical_url_id GROUP BY ALL),
    alt AS (SELECT url_id, count(*) AS n FROM {{{hreflang}}} GROUP BY ALL),
    own AS (SELECT h.url_id, min(h.language_code) AS language FROM {{{hreflang}}} h JOIN {{urls}} a ON a.url_id = h.url_id JOIN {{urls}} b ON b.url_id = h.href_url_id
        WHERE h.language_code <> 'x-default' AND {same_page} GROUP BY ALL),
    def AS (SELECT h.url_id, min(t.url) AS url FROM {{{hreflang}}} h JOIN {{urls}} t ON t.url_id = h.href_url_id WHERE h.language_code = 'x-default' GROUP BY ALL),
    sch AS (SELECT r.url_id, count(*) AS n, count(*) FILTER (r.is_main_entity) AS mains, string_agg(DISTINCT s.type, ',' ORDER BY s.type) FILTER (r.is_main_entity) AS types
        FROM {{schema_references}} r JOIN {{schema_instances}} s USING (content_hash) GROUP BY ALL)
    SELECT {columns} FROM {{urls}} u LEFT JOIN {{frontier}} f USING (url_id) LEFT JOIN {{content}} c USING (url_id) LEFT JOIN {{page_metadata}} m USING (url_id)
    LEFT JOIN i USING (url_id) LEFT JOIN inl USING (url_id) LEFT JOIN can USING (url_id) LEFT JOIN alt USING (url_id) LEFT JOIN own USING (url_id)
    LEFT JOIN def USING (url_id) LEFT JOIN sch USING (url_id) LEFT JOIN {{urls}} d ON d.url_id = m.redirect_destination_url_id
    WHERE u.classification IN ('internal', 'network') {fragments}"""


LINK_FLAGS = "(l.anchor_text IS NULL)::INT AS is_image, (l.fragment IS NOT NULL)::INT AS has_fragment, (l.url_parameters IS NOT NULL)::INT AS has_parameters"
FROM_INTERNAL = "JOIN {urls} s ON s.url_id = l.source_url_id AND s.classification = 'internal'"

# What is known of each possible target: its own answer, or that of pages which redirect to it.
TARGETS = """SELECT u.url_id, u.url, coalesce(u.classification, 'internal') AS classification, coalesce(own.status, arriving.status) AS target_status_code,
    (u.url_id IN (SELECT url_id FROM {canonical_urls} WHERE canonical_url_id = url_id))::INT AS target_is_self_canonical,
    (arriving.url_id IS NOT NULL OR coalesce(own.stays, false))::INT AS target_resolves, arriving.url_id IS NOT NULL OR own.url_id IS NOT NULL AS crawled
    FROM {urls} u LEFT JOIN (SELECT url_id, initial_status_code AS status, coalesce(final_url_id = url_id, true) AS stays FROM {page_metadata}) AS own USING (url_id)
    LEFT JOIN (SELECT final_url_id AS url_id, min(initial_status_code) AS status FROM {page_metadata} WHERE final_url_id IS NOT NULL GROUP BY ALL) AS arriving USING (url_id)"""


def _judged(where: str) -> str:
    return f"""SELECT s.url AS source_url, t.url AS target_url, l.anchor_text, l.xpath, l.fragment, l.url_parameters, l.discovered_at, {LINK_FLAGS},
    t.target_status_code, t.target_is_self_canonical, t.target_resolves
    FROM (SELECT source_url_id, target_url_id, anchor_text, xpath, fragment, url_parameters, min(discovered_at) AS discovered_at FROM {{internal_links}} GROUP BY ALL) AS l
    {FROM_INTERNAL} JOIN ({TARGETS}) AS t ON t.url_id = l.target_url_id WHERE {where}"""


INTERNAL = _judged("t.classification = 'internal' AND t.crawled")
EXTERNAL = _judged("t.classification = 'external'")
WRONG = _first_true(("target_resolves = 0", "redirects"), ("target_is_self_canonical = 0", "not self-canonical"), ("target_status_code <> 200", "non-200 status"))
INVALID = f"""SELECT *, {WRONG} AS invalid_reason FROM ({_judged("t.classification = 'external' OR (t.classification = 'internal' AND t.crawled)")}) AS x
    WHERE target_status_code IS NOT NULL AND {WRONG} IS NOT NULL"""


def _flagged(classification: str) -> str:
    return f"""SELECT s.url AS source_url, t.url AS target_url, l.anchor_text, l.xpath, l.fragment, l.url_parameters, l.discovered_at, {LINK_FLAGS}
    FROM {{internal_links}} l {FROM_INTERNAL} JOIN {{urls}} t ON t.url_id = l.target_url_id AND t.classification = '{classification}'"""


HREF = "h.url AS href, h.classification AS href_classification, "


def _legacy_links(classification: str, extra: str = HREF) -> str:
    return f"""SELECT s.url AS source_url, t.url AS target_url, t.classification AS target_classification, l.anchor_text,
    coalesce(starts_with(l.anchor_text, '[IMG:'), false)::INT AS is_image, l.xpath, {extra}l.fragment AS url_fragment, l.url_parameters, l.discovered_at
    FROM {{internal_links}} l JOIN {{urls}} t ON t.url_id = l.target_url_id AND t.classification = '{classification}' JOIN {{urls}} s ON s.url_id = l.source_url_id
    LEFT JOIN {{urls}} h ON h.url_id = l.href_url_id WHERE l.source_url_id IN (SELECT url_id FROM {{frontier}})"""


GROUPED = """SELECT u.url, c.url_id, c.{h} AS h, c.word_count, c.content_length, c.content_hash_sha256 AS sha, count(*) OVER (PARTITION BY c.{h}) AS n,
    row_number() OVER (PARTITION BY c.{h} ORDER BY c.url_id) AS rn, first_value(c.url_id) OVER (PARTITION BY c.{h} ORDER BY c.url_id) AS id1,
    first_value(u.url) OVER (PARTITION BY c.{h} ORDER BY c.url_id) AS u1, first_value(c.word_count) OVER (PARTITION BY c.{h} ORDER BY c.url_id) AS w1,
    first_value(c.content_length) OVER (PARTITION BY c.{h} ORDER BY c.url_id) AS l1
    FROM {{content}} c JOIN {{urls}} u ON u.url_id = c.url_id WHERE c.{h} <> ''"""
BY_SHA = GROUPED.replace("{h}", "content_hash_sha256").replace("{{", "{").replace("}}", "}")
BY_SIM = GROUPED.replace("{h}", "content_hash_simhash").replace("{{", "{").replace("}}", "}")
HASH_STATS = """SELECT count(*) AS total_pages, count(content_hash_sha256) AS pages_with_sha256, count(content_hash_simhash) AS pages_with_simhash,
    count(DISTINCT content_hash_sha256) AS unique_sha256_hashes, count(DISTINCT content_hash_simhash) AS unique_simhash_hashes,
    avg({m}) AS avg_{m}, min({m}) AS min_{m}, max({m}) AS max_{m} FROM {{content}}"""

VIEW_SQL = {
    "view_crawl_overview": _overview_sql("hreflang_sitemap"),
    "view_crawl_overview_legacy": _overview_sql("hreflang_sitemap", legacy=True),
    "view_links_internal": INTERNAL,
    "view_links_external": EXTERNAL,
    "view_links_invalid_content": INVALID,
    "view_links_network": _flagged("network"),
    "view_links_subdomain": _flagged("subdomain"),
    "view_sitemap_statistics": """SELECT s.sitemap_url, s.total_urls_found, s.is_sitemap_index, s.discovered_at, count(us.url_id) AS urls_processed,
        count(DISTINCT u.classification) AS classification_count, string_agg(DISTINCT u.classification, ',' ORDER BY u.classification) AS classifications
        FROM {sitemaps} s LEFT JOIN {url_sitemaps} us ON us.sitemap_id = s.sitemap_id LEFT JOIN {urls} u ON u.url_id = us.url_id
        GROUP BY s.sitemap_url, s.total_urls_found, s.is_sitemap_index, s.discovered_at""",
    "view_schema_analysis": """SELECT u.url, s.type AS schema_type, s.format, s.is_valid, s.severity, s.validation_errors, r.position, r.property_name,
        r.is_main_entity, r.parent_ordinal, r.discovered_at FROM {schema_references} r JOIN {urls} u ON u.url_id = r.url_id
        JOIN {schema_instances} s ON s.content_hash = r.content_hash""",
    "view_schema_hierarchy": """SELECT u.url, s.type AS schema_type, r.position, r.property_name, r.is_main_entity, p.position AS parent_position,
        ps.type AS parent_schema_type, r.discovered_at FROM {schema_references} r JOIN {urls} u ON u.url_id = r.url_id
        JOIN {schema_instances} s ON s.content_hash = r.content_hash
        LEFT JOIN {schema_references} p ON p.url_id = r.url_id AND p.ordinal = r.parent_ordinal
        LEFT JOIN {schema_instances} ps ON ps.content_hash = p.content_hash""",
    "view_crawl_status": """SELECT status, count(*) AS "count", round(avg(priority_score), 9) AS avg_priority, min(enqueued_at) AS oldest_enqueued,
        max(updated_at) AS last_updated FROM {frontier} GROUP BY status""",
    "view_utm_links": """SELECT s.url AS source_url, t.url AS target_url, l.anchor_text, l.url_parameters, l.discovered_at FROM {internal_links} l
        JOIN {urls} s ON s.url_id = l.source_url_id LEFT JOIN {urls} t ON t.url_id = l.target_url_id WHERE l.url_parameters LIKE '%utm_%'""",
    "view_hubs": """SELECT u.url, c.title, c.internal_links_count, c.external_links_count, c.internal_links_count + c.external_links_count AS total_links,
        c.word_count, c.crawl_depth FROM {urls} u JOIN {content} c ON c.url_id = u.url_id WHERE c.internal_links_count + c.external_links_count > 50""",
    "view_exact_duplicates": f"SELECT h AS content_hash_sha256, count(*) AS duplicate_count, min(url) AS first_url FROM ({BY_SHA}) AS g GROUP BY h HAVING count(*) > 1",
    "view_exact_duplicate_members": f"SELECT h AS content_hash_sha256, url, n AS duplicate_count FROM ({BY_SHA}) AS g WHERE n > 1",
    "view_near_duplicates": f"""SELECT id1 AS url1_id, u1 AS url1, url_id AS url2_id, url AS url2, h AS content_hash_simhash, w1 AS word_count1, word_count AS word_count2
        FROM ({BY_SIM}) AS g WHERE rn > 1""",
    "view_content_hash_stats": HASH_STATS.replace("{m}", "word_count").replace("{{", "{").replace("}}", "}"),
    "view_links_internal_legacy": _legacy_links("internal"),
    "view_links_network_legacy": _legacy_links("network"),
    "view_links_external_legacy": _legacy_links("external"),
    "view_links_subdomain_legacy": _legacy_links("subdomain", ""),
    "view_sitemap_statistics_legacy": """WITH placed AS (SELECT us.sitemap_id, us.url_id, us.discovered_at, f.status FROM {url_sitemaps} us LEFT JOIN {frontier} f USING (url_id)),
        tallied AS (SELECT sitemap_id, count(*) AS n, count(DISTINCT url_id) AS pages, min(discovered_at) AS a, max(discovered_at) AS z,
            count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status IS NULL) AS outside FROM placed GROUP BY ALL)
        SELECT s.sitemap_url, coalesce(n, 1) AS total_urls, coalesce(pages, 0) AS unique_urls, a AS first_discovered, z AS last_discovered, coalesce(done, 0) AS crawled_urls,
        coalesce(queued, 0) AS queued_urls, coalesce(outside, 1) AS not_in_frontier FROM {sitemaps} s LEFT JOIN tallied USING (sitemap_id)""",
    "view_schema_analysis_legacy": """WITH typed AS (SELECT * FROM {schema_references} r JOIN {schema_instances} USING (content_hash)),
        totals AS (SELECT url_id, count(*) AS n, count(*) FILTER (is_main_entity) AS mains, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
            string_agg(DISTINCT property_name, ',' ORDER BY property_name) AS names FROM typed GROUP BY ALL)
        SELECT u.url, m.type AS main_entity_type, m.raw_data AS main_entity_data, m.is_valid AS main_entity_valid, m.validation_errors AS main_entity_errors,
        m.severity AS main_entity_severity, m.position AS main_entity_position, m.discovered_at AS main_entity_discovered_at, n AS total_schema_count,
        mains AS main_entity_count, n - mains AS related_entity_count, types AS all_schema_types, names AS property_names
        FROM totals JOIN {urls} u USING (url_id) LEFT JOIN (SELECT * FROM typed WHERE is_main_entity) AS m USING (url_id)""",
    "view_schema_hierarchy_legacy": """WITH typed AS (SELECT * FROM {schema_references} r JOIN {schema_instances} USING (content_hash)),
        below AS (SELECT url_id, parent_ordinal AS ordinal, count(*) AS n FROM typed WHERE parent_ordinal IS NOT NULL GROUP BY ALL)
        SELECT u.url, e.type AS schema_type, e.raw_data AS schema_data, e.is_valid, e.validation_errors, e.severity, e.position, e.is_main_entity, e.property_name,
        e.parent_ordinal, p.type AS parent_entity_type, p.raw_data AS parent_entity_data, coalesce(kids.n, 0) AS child_count, coalesce(peers.n - 1, 0) AS sibling_count
        FROM typed e JOIN {urls} u USING (url_id) LEFT JOIN typed p ON p.url_id = e.url_id AND p.ordinal = e.parent_ordinal
        LEFT JOIN below kids ON kids.url_id = e.url_id AND kids.ordinal = e.ordinal LEFT JOIN below peers ON peers.url_id = e.url_id AND peers.ordinal = e.parent_ordinal""",
    "view_crawl_status_legacy": f"""WITH i AS ({INDEXABILITY}),
        ss AS (SELECT count(DISTINCT s.sitemap_id) AS a, count(*) AS b FROM {{sitemaps}} s JOIN {{url_sitemaps}} us ON us.sitemap_id = s.sitemap_id),
        uc AS (SELECT count(*) FILTER (classification = 'internal') AS internal, count(*) FILTER (classification = 'network') AS network,
            count(*) FILTER (classification = 'external') AS external, count(*) FILTER (classification = 'social') AS social FROM {{urls}}),
        cs AS (SELECT count(*) AS n FROM {{content}}),
        ca AS (SELECT count(*) AS total, count(cu.canonical_url_id) AS has FROM {{content}} c LEFT JOIN {{canonical_urls}} cu ON cu.url_id = c.url_id),
        ix AS (SELECT count(*) AS total, count(*) FILTER (overall_indexable) AS yes, count(*) FILTER (NOT overall_indexable) AS no FROM i),
        sc AS (SELECT count(DISTINCT u.url_id) AS total, count(DISTINCT us.url_id) AS listed FROM {{urls}} u LEFT JOIN {{url_sitemaps}} us ON us.url_id = u.url_id
            WHERE u.classification IN ('internal', 'network')),
        so AS (SELECT count(DISTINCT us.url_id) AS total, count(DISTINCT c.url_id) AS crawled FROM {{url_sitemaps}} us LEFT JOIN {{content}} c ON c.url_id = us.url_id)
        SELECT ss.a AS sitemaps_scraped, ss.b AS urls_in_sitemaps, uc.internal AS internal_urls, uc.network AS network_urls, uc.external AS external_urls,
        uc.social AS social_urls, cs.n AS total_crawled, cs.n AS status_200, CAST(0 AS BIGINT) AS non_200, ca.has AS has_canonical, ca.total - ca.has AS no_canonical,
        ix.yes AS indexable, ix.no AS non_indexable, sc.total - sc.listed AS internal_urls_not_in_sitemap, so.total - so.crawled AS sitemap_urls_not_crawled,
        round(cs.n * 100.0 / cs.n, 2) AS success_rate_percent, round(ca.has * 100.0 / ca.total, 2) AS canonical_coverage_percent,
        round(ix.yes * 100.0 / ix.total, 2) AS indexability_rate_percent, round(sc.listed * 100.0 / sc.total, 2) AS sitemap_coverage_percent
        FROM ss, uc, cs, ca, ix, sc, so""",
    "view_utm_links_legacy": """SELECT s.url AS source_url, h.url AS target_url_original, l.anchor_text, l.url_parameters, l.discovered_at FROM {internal_links} l
        JOIN {urls} s ON s.url_id = l.source_url_id JOIN {frontier} f ON f.url_id = s.url_id LEFT JOIN {urls} h ON h.url_id = l.href_url_id
        WHERE l.url_parameters LIKE '%utm_%'""",
    "view_hubs_legacy": """SELECT u.url AS hub_url, u.classification AS hub_classification, count(l.target_url_id) AS child_count,
        string_agg(DISTINCT t.classification, ',' ORDER BY t.classification) AS child_classifications FROM {urls} u
        JOIN {internal_links} l ON l.source_url_id = u.url_id JOIN {urls} t ON t.url_id = l.target_url_id GROUP BY u.url, u.classification HAVING count(*) > 1""",
    "view_hub_children_legacy": """SELECT DISTINCT u.url AS hub_url, t.url AS child_url FROM {urls} u JOIN {internal_links} l ON l.source_url_id = u.url_id
        JOIN {urls} t ON t.url_id = l.target_url_id WHERE u.url_id IN (SELECT source_url_id FROM {internal_links} GROUP BY 1 HAVING count(*) > 1)""",
    "view_exact_duplicates_legacy": f"""SELECT id1 AS url1_id, url_id AS url2_id, u1 AS url1, url AS url2, h AS content_hash_sha256, content_length,
        'Exact duplicate' AS duplicate_type FROM ({BY_SHA}) AS g WHERE rn > 1""",
    "view_near_duplicates_legacy": """SELECT f.url_id AS url1_id, d.url_id AS url2_id, f.url AS url1, d.url AS url2, d.sim AS content_hash_simhash,
        f.len AS url1_length, d.len AS url2_length, 'Near duplicate' AS duplicate_type FROM (SELECT *, min(url_id) OVER (PARTITION BY sim) AS first_id FROM (
            SELECT c.content_hash_simhash AS sim, c.content_hash_sha256 AS sha, min(c.url_id) AS url_id, arg_min(u.url, c.url_id) AS url, arg_min(c.content_length, c.url_id) AS len
            FROM {content} c JOIN {urls} u ON u.url_id = c.url_id GROUP BY 1, 2) AS x) AS d
        JOIN (SELECT c.url_id, u.url, c.content_length AS len FROM {content} c JOIN {urls} u ON u.url_id = c.url_id) AS f ON f.url_id = d.first_id WHERE d.url_id <> d.first_id""",
    "view_content_hash_stats_legacy": HASH_STATS.replace("{m}", "content_length").replace("{{", "{").replace("}}", "}"),
}

# Averages of doubles depend on the order of addition, so they are compared to nine places.
ROUNDED = {"view_crawl_status": ["avg_priority"]}


def _registered(name: str):
    def build(data: Data) -> DataFrame:
        view = R.ALL_VIEWS[name](crawl_tables(data))
        return view.withColumns({c: F.round(c, 9) for c in ROUNDED[name]}) if name in ROUNDED else view
    return build


for _name in R.ALL_VIEWS:
    if _name in VIEW_SQL:
        check(_name, VIEW_SQL[_name])(_registered(_name))


@check("view_crawl_overview_html_hreflang", _overview_sql("hreflang_html_head"))
def _overview_html(data: Data) -> DataFrame:
    return V.view_crawl_overview(crawl_tables(data), hreflang_source="html")


check("view_hsts_preload_checks", HSTS)(lambda data: V.view_hsts_preload_checks({"hsts_preload_checks": hsts_table(data)}))
check("view_spa_checks", SPA)(lambda data: V.view_spa_checks({"spa_checks": spa_table(data)}))


@check("view_crawl_general_checks", f"""SELECT coalesce(h.base_domain, s.base_domain) AS base_domain, h.checked_at AS hsts_checked_at,
    h.eligible AS hsts_preload_eligible, h.https_status AS hsts_https_status, h.http_status AS hsts_http_status, h.hsts_header, h.hsts_max_age,
    h.hsts_include_subdomains, h.hsts_preload, h.hsts_max_age_ok, h.http_redirects_to_https, h.http_redirect_target, s.checked_at AS spa_checked_at,
    s.random_404_status, s.random_404_ok, s.random_404_final_url, s.case_status, s.case_ok, s.case_final_url, s.case_canonical_url,
    h.notes AS hsts_notes, s.notes AS spa_notes FROM (SELECT * FROM ({HSTS}) AS a WHERE checked_at = 1002) AS h
    FULL OUTER JOIN ({SPA}) AS s ON s.base_domain = h.base_domain""")
def _general_checks(data: Data) -> DataFrame:
    return V.view_crawl_general_checks({"hsts_preload_checks": hsts_table(data), "spa_checks": spa_table(data)})


@check("register_views", " UNION ALL ".join(
    f"SELECT '{name}' AS view_name, count(*) AS n FROM ({sql}) AS v_{name}" for name, sql in sorted(VIEW_SQL.items())))
def _register_views(data: Data) -> DataFrame:
    names = sorted(VIEW_SQL)
    R.register_views(crawl_tables(data), names)
    return data.spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS view_name, count(*) AS n FROM {name}" for name in names))
