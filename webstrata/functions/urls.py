"""URL columns: split, resolve, normalize, classify.

Everything runs inside the JVM. The one exception is the punycode step for hosts that
contain non-ASCII characters, an Arrow-batched UDF that receives null for all other rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.expr import any_of, blank_to_null, col, let, record

# The result must treat exactly these hosts as social networks.
SOCIAL_DOMAINS = [
    "facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com",
    "linkedin.com", "youtube.com", "tiktok.com", "snapchat.com",
    "pinterest.com", "reddit.com", "discord.com", "telegram.org",
    "whatsapp.com", "messenger.com", "skype.com", "zoom.us",
]

# Campaign parameters that never change what a page shows.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
]

# Port implied by each scheme.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ftps": 990}

# File extensions by resource kind.
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".avif"]
ASSET_EXTENSIONS = [".css", ".js", ".pdf", ".zip", ".woff", ".woff2", ".ttf"]

# Schemes whose relative references resolve against the base.
HIERARCHICAL_SCHEMES = ["http", "https", "ftp", "file", "sftp", "ws", "wss"]

# RFC 3986 appendix B, with the scheme restricted to its legal characters.
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def split_url(url: Column | str) -> Column:
    """struct(scheme, netloc, path, query, fragment); absent parts are empty strings."""
    def parts(u: Column) -> Column:
        return record(
            scheme=F.lower(F.regexp_extract(u, _URL, 1)),
            netloc=F.regexp_extract(u, _URL, 2),
            path=F.regexp_extract(u, _URL, 3),
            query=F.regexp_extract(u, _URL, 4),
            fragment=F.regexp_extract(u, _URL, 5),
        )
    url = col(url)
    return F.when(url.isNotNull(), let(_clean(url), parts))


def join_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def host(url: Column | str) -> Column:
    """Authority in lower case, port included."""
    return F.lower(F.regexp_extract(_clean(col(url)), _URL, 2))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_clean(col(url)), _URL, 1))


def path(url: Column | str) -> Column:
    """Path without the `;parameters` of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(col(url)), _URL, 3), r";[^/]*$", "")


def path_or_root(url: Column | str) -> Column:
    return F.coalesce(blank_to_null(path(url)), F.when(col(url).isNotNull(), F.lit("/")))


def _without_www(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^www\.", "")


def _merge_path(base_path: Column, relative: Column) -> Column:
    """Merge a non-empty relative path with the base path and remove dot segments."""
    def inner_only(segments: Column) -> Column:
        last = F.size(segments) - 1
        return F.filter(segments, lambda s, i: (i == 0) | (i == last) | (s != ""))

    def resolve(segments: Column) -> Column:
        stacked = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(s == ".", kept)
            .otherwise(F.concat(kept, F.array(s))),
        )
        dotted = F.element_at(segments, -1).isin(".", "..")
        closed = F.when(dotted, F.concat(stacked, F.array(F.lit("")))).otherwise(stacked)
        return F.coalesce(blank_to_null(F.array_join(closed, "/")), F.lit("/"))

    folder = F.regexp_extract(base_path, r"(?s)^(.*/)?", 1)
    absolute = F.split(relative, "/")
    # "/a/b" + "x" merges as "/a/x"; a base without any path counts as the root.
    merged = inner_only(F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), relative), "/"))
    return let(F.when(relative.startswith("/"), absolute).otherwise(merged), resolve)


def resolve_url(base: Column | str, href: Column | str, keep_fragment: bool = False) -> Column:
    """Resolve `href` against the page URL `base`; the fragment is dropped unless asked for."""
    def resolve(p: Column) -> Column:
        b, r = p["b"], p["r"]
        fragment = r["fragment"] if keep_fragment else F.lit("")
        foreign = (r["scheme"] != "") & (r["scheme"] != b["scheme"])
        opaque = foreign | ~b["scheme"].isin(HIERARCHICAL_SCHEMES)
        own_path = r["path"] != ""
        return (
            F.when(p["href"] == "", join_url(b["scheme"], b["netloc"], b["path"], b["query"],
                                             b["fragment"] if keep_fragment else F.lit("")))
            .when(opaque, p["href"] if keep_fragment else
                  join_url(r["scheme"], r["netloc"], r["path"], r["query"], fragment))
            .when(r["netloc"] != "", join_url(b["scheme"], r["netloc"], r["path"], r["query"], fragment))
            .otherwise(join_url(
                b["scheme"], b["netloc"],
                F.when(own_path, _merge_path(b["path"], r["path"])).otherwise(b["path"]),
                F.when(own_path | (r["query"] != ""), r["query"]).otherwise(b["query"]),
                fragment))
        )

    base, href = col(base), col(href)
    bound = record(b=split_url(base), r=split_url(href), href=href)
    return F.when(base.isNotNull() & href.isNotNull(), let(bound, resolve))


def _punycode_batch(hosts: pd.Series) -> pd.Series:
    import idna

    def encode(name: str | None) -> str | None:
        if name is None:
            return None
        try:
            return idna.encode(name.lower()).decode("ascii")
        except (idna.IDNAError, UnicodeError):
            return name.lower()

    known = {name: encode(name) for name in hosts.unique()}
    return hosts.map(known, na_action="ignore")


# Declared non-deterministic so that the optimizer neither repeats it nor moves it into filters.
_punycode = F.pandas_udf(_punycode_batch, T.StringType()).asNondeterministic()


def _unescape(text: Column) -> Column:
    """Percent- and plus-decoding that leaves stray percent signs alone."""
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _escape(text: Column) -> Column:
    """Form encoding with `~` kept and `*` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array<struct<key,pos,value>> of a query string, decoded; a bare key has an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pieces, lambda p, i: record(
        key=_unescape(F.substring_index(p, "=", 1)),
        pos=i,
        value=_unescape(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")),
    ))


def _canonical_query(query: Column) -> Column:
    kept = F.filter(query_pairs(query), lambda p: ~F.lower(p["key"]).isin(TRACKING_PARAMS))
    encoded = F.transform(F.array_sort(kept),
                          lambda p: F.concat(_escape(p["key"]), F.lit("="), _escape(p["value"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def normalize_url_hardened(url: Column | str, idn: bool = True) -> Column:
    """Canonical form: lower scheme and host, punycode, no default port, no campaign
    parameters, parameters sorted by key, no fragment. Trailing slashes stay."""
    url = col(url)
    ascii_host = F.lit(None).cast("string")
    if idn:
        netloc = F.regexp_extract(_clean(url), _URL, 2)
        ascii_host = _punycode(F.when(netloc.rlike(r"[^\x00-\x7F]"), netloc))

    def assemble(p: Column) -> Column:
        u = p["u"]
        name = F.coalesce(p["ascii"], F.lower(u["netloc"]))
        for known, port in DEFAULT_PORTS.items():
            name = F.when(u["scheme"] == known, F.regexp_replace(name, f":0*{port}$", "")).otherwise(name)
        return join_url(u["scheme"], name, F.regexp_replace(u["path"], r";[^/]*$", ""),
                        _canonical_query(u["query"]), F.lit(""))

    return F.when(url.isNotNull(), let(record(u=split_url(url), ascii=ascii_host), assemble))


def normalize_url_for_storage(url: Column | str) -> Column:
    """Lower scheme and host, drop the fragment, keep everything else."""
    url = col(url)
    return F.when(url.isNotNull(), let(split_url(url), lambda u: join_url(
        u["scheme"], F.lower(u["netloc"]), u["path"], u["query"], F.lit(""))))


def classify_kind(content_type: Column | str, url: Column | str) -> Column:
    """sitemap / html by content type, else image / asset by extension, else other."""
    kind, name = F.lower(F.coalesce(col(content_type), F.lit(""))), F.lower(col(url))
    return (
        F.when(kind.contains("xml") & kind.contains("sitemap"), "sitemap")
        .when(kind.startswith("text/html"), "html")
        .when(any_of([name.endswith(e) for e in IMAGE_EXTENSIONS]), "image")
        .when(any_of([name.endswith(e) for e in ASSET_EXTENSIONS]), "asset")
        .otherwise("other")
    )


def classify_url(url: Column | str, base_domain: Column | str, from_hreflang: Column | bool = False) -> Column:
    """Relation of a URL to the crawled site; `base_domain` is a string or a column."""
    base = F.lit(base_domain) if isinstance(base_domain, str) else base_domain
    linked = F.lit(from_hreflang) if isinstance(from_hreflang, bool) else from_hreflang
    social = F.array(*[F.lit(d) for d in SOCIAL_DOMAINS])

    def relation(p: Column) -> Column:
        name, site = p["name"], p["site"]
        return (
            F.when(F.exists(social, lambda d: (name == d) | name.endswith(F.concat(F.lit("."), d))), "social")
            .when(name == site, "internal")
            .when(name.endswith(F.concat(F.lit("."), site)), "subdomain")
            .when(p["linked"], "network")
            .otherwise("external")
        )

    url = col(url)
    bound = record(name=_without_www(host(url)), site=_without_www(base), linked=linked)
    return F.when(url.isNotNull(), let(bound, relation))


def fix_protocol_relative(href: Column | str) -> Column:
    href = col(href)
    return F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)


def url_components(href: Column | str, base: Column | str) -> Column:
    """struct(href, url_fragment, url_parameters, is_absolute) of a raw href."""
    href, base = col(href), col(base)

    def first_values(query: Column) -> Column:
        pairs = F.filter(query_pairs(query), lambda p: p["value"] != "")
        firsts = F.filter(pairs, lambda p: ~F.exists(
            pairs, lambda q: (q["key"] == p["key"]) & (q["pos"] < p["pos"])))
        joined = F.array_join(F.transform(firsts, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
        return F.when(query != "", joined)

    def parts(u: Column) -> Column:
        bare = join_url(u["scheme"], u["netloc"], u["path"], F.lit(""), F.lit(""))
        return record(
            bare=bare,
            url_fragment=blank_to_null(u["fragment"]),
            url_parameters=first_values(u["query"]),
            is_absolute=u["netloc"] != "",
        )

    split = let(split_url(href), parts)
    return let(split, lambda s: record(
        href=F.when(s["is_absolute"], s["bare"]).otherwise(resolve_url(base, s["bare"], keep_fragment=True)),
        url_fragment=s["url_fragment"],
        url_parameters=s["url_parameters"],
        is_absolute=s["is_absolute"],
    ))


def site_key(url: Column | str) -> Column:
    """Host without `www.` as a name safe for paths; the natural partition column of a crawl."""
    return F.regexp_replace(_without_www(host(url)), r"[^\p{L}\p{N}_]", "_")


def to_staging(url: Column | str, origin: str, staging: str) -> Column:
    """The URL a page is expected to have on the staging host."""
    moved = col(url)
    for prefix in ("https://", "http://"):
        moved = F.replace(moved, F.lit(prefix + origin), F.lit(prefix + staging))
    return moved


def same_host(a: Column | str, b: Column | str) -> Column:
    return host(a) == host(b)


def under_prefix(url: Column | str, prefixes: list[str]) -> Column:
    """The path starts with one of the excluded prefixes."""
    place = path_or_root(url)
    return any_of([place.startswith(p if p.startswith("/") else "/" + p) for p in prefixes])


def on_domains(url: Column | str, domains: list[str]) -> Column:
    """The host is one of `domains` or below it."""
    name = host(url)
    return any_of([(name == d) | name.endswith("." + d) for d in domains])


def in_scope(url: Column | str, excludes: list[str] | None = None, restriction: str = "",
             domains: list[str] | None = None) -> Column:
    """The URL passes the scope rules of a crawl."""
    inside = F.lit(True)
    if domains:
        inside = inside & on_domains(url, domains)
    if restriction:
        inside = inside & path(url).contains(restriction)
    if excludes:
        inside = inside & ~under_prefix(url, excludes)
    return inside
