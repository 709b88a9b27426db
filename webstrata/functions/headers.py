"""Response headers: lookup, HSTS, cache lifetime."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.expr import col, let, strip

# Headers worth storing.
ESSENTIAL = ["content-type", "content-length", "last-modified", "etag", "server"]

# Fixed value: least max-age, in seconds, that counts as a long HSTS commitment (one year).
HSTS_MIN_AGE = 31_536_000


def lower_names(headers: Column | str) -> Column:
    """The map with lower-cased names; of names differing in case only, the last one counts."""
    entries = F.map_entries(col(headers))
    lowered = F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"),
                                                         i.alias("i")))
    last = F.filter(lowered, lambda e: ~F.exists(lowered, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def header(headers: Column | str, name: str) -> Column:
    """Value of a header whatever the case of its name."""
    matching = F.filter(F.map_entries(col(headers)), lambda e: F.lower(e["key"]) == name)
    return F.get(F.reverse(F.transform(matching, lambda e: e["value"])), F.lit(0))


def essential_headers(headers: Column | str) -> Column:
    kept = F.map_filter(lower_names(headers), lambda k, _: k.isin(ESSENTIAL))
    return F.transform_values(kept, lambda _, v: strip(v))


def parse_hsts(value: Column | str) -> Column:
    """struct(max_age, include_subdomains, preload, max_age_ok, present) of a Strict-Transport-Security value."""
    value = col(value)
    directives = F.filter(F.transform(F.split(F.lower(value), ";"), strip), lambda d: d != "")

    def read(ds: Column) -> Column:
        ages = F.filter(ds, lambda d: d.startswith("max-age") & d.contains("="))
        written = F.regexp_replace(F.regexp_replace(F.element_at(ages, -1), r"^[^=]*=\s*", ""), r'^"+|"+$', "")
        age = F.when(F.size(ages) > 0, F.regexp_extract(written, r"^\s*([+-]?\d+)\s*$", 1).try_cast("bigint"))
        return F.struct(
            age.alias("max_age"),
            F.coalesce(F.array_contains(ds, "includesubdomains"), F.lit(False)).alias("include_subdomains"),
            F.coalesce(F.array_contains(ds, "preload"), F.lit(False)).alias("preload"),
            F.coalesce(age >= HSTS_MIN_AGE, F.lit(False)).alias("max_age_ok"),
            (F.coalesce(value, F.lit("")) != "").alias("present"),
        )

    return let(directives, read)


def http_date(value: Column) -> Column:
    """Epoch seconds of an HTTP date; the weekday is not needed and not read."""
    dated = F.regexp_replace(value, r"^[A-Za-z]+,\s*", "")
    return F.unix_timestamp(F.try_to_timestamp(dated, F.lit("dd MMM yyyy HH:mm:ss z")))


def cache_ttl(headers: Column | str, now: Column | int, default_ttl: int = 3600) -> Column:
    """Seconds a response stays fresh: max-age, else 0 for no-cache/no-store, else until Expires,
    else a tenth of its age since Last-Modified up to the default, else the default."""
    now = F.lit(now) if isinstance(now, int) else now
    control = F.lower(F.coalesce(header(headers, "cache-control"), F.lit("")))
    max_age = F.regexp_extract(control, r"max-age=\s*([+-]?\d+)\s*(?:,|$)", 1).try_cast("bigint")
    until = http_date(header(headers, "expires")) - now
    heuristic = F.floor((now - http_date(header(headers, "last-modified"))) * F.lit(0.1)).cast("bigint")
    zero, default = F.lit(0).cast("bigint"), F.lit(default_ttl).cast("bigint")
    return F.coalesce(
        max_age,
        F.when(control.contains("no-cache") | control.contains("no-store"), zero),
        F.when(until.isNotNull(), F.greatest(until, zero)),
        F.when(heuristic.isNotNull(), F.greatest(F.least(heuristic, default), zero)),
        default,
    )
