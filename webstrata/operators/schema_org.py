"""Structured data: schema.org items of pages, their validation, roles and references."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions import html as H
from webstrata.functions.expr import blank_to_null, let, record
from webstrata.functions.portions import portions
from webstrata.operators.pages import NODES, SOURCE, with_nodes
from webstrata.operators.skew import hottest, join_unique

# Keys that vary without making an item different.
VOLATILE_KEYS = ["@id", "discovered_at", "created_at", "updated_at", "position", "url",
                 "mainEntityOfPage", "isPartOf"]

# Types that can be what a page is about, most likely first.
MAIN_TYPES = ["WebPage", "Article", "Product", "Event", "Recipe", "Review",
              "LocalBusiness", "Organization", "Person", "WebSite"]

# Types that usually describe a part of the main entity.
PROPERTY_TYPES = ["ImageObject", "VideoObject", "BreadcrumbList", "Offer", "AggregateRating",
                  "Review", "Author", "Publisher", "Organization"]

# Properties each type must have, with the error when it is missing.
REQUIRED = {
    "article": ("Article", ["headline", "author"]),
    "product": ("Product", ["name", "offers"]),
    "organization": ("Organization", ["name"]),
    "breadcrumblist": ("BreadcrumbList", ["itemListElement"]),
    "videoobject": ("VideoObject", ["name", "description"]),
}

# Formats a stored instance may have; others count as the first.
FORMATS = ["json-ld", "microdata", "rdfa"]

LD_JSON = "application/ld+json"
SCHEMA_URL = r"(?i)https?://schema\.org/[A-Za-z]+"
ITEM_COLUMNS = ["format", "type", "raw_data", "parsed_data", "position", "ordinal",
                "validation_errors", "severity", "is_valid", "content_hash"]


# ---- the JSON step ------------------------------------------------------------------------

def _absolute(value, base: str, in_lists: bool):
    """Site-relative string values of objects made absolute, at any depth; strings that stand in a
    list only if `in_lists`."""
    if isinstance(value, str):
        return urljoin(base, value) if value.startswith("/") else value
    if isinstance(value, list):
        return [_absolute(i, base, in_lists) if in_lists or isinstance(i, dict) else i for i in value]
    if isinstance(value, dict):
        return {k: _absolute(v, base, in_lists) for k, v in value.items()}
    return value


def _stable(value):
    """An object without its volatile keys, at any depth."""
    if isinstance(value, dict):
        return {k: [_stable(i) for i in v] if isinstance(v, list) else _stable(v)
                for k, v in value.items() if k not in VOLATILE_KEYS}
    return value


def _finished(data, base: str, in_lists: bool) -> tuple[str | None, str | None]:
    """Item JSON with absolute URLs, and the SHA-256 of its canonical form; none for an empty item."""
    data = _absolute(data, base, in_lists)
    if not data:
        return None, None
    canonical = json.dumps(_stable(data), sort_keys=True, separators=(",", ":"))
    return json.dumps(data), hashlib.sha256(canonical.encode()).hexdigest()


def _type_of(data: dict) -> str:
    kind = data.get("@type", "Unknown")
    kind = str(kind[0]) if isinstance(kind, list) and kind else kind
    if not isinstance(kind, str):
        raise TypeError("@type is neither a name nor a list of names")
    # A lone surrogate cannot be stored.
    return kind.replace("https://schema.org/", "").replace("http://schema.org/", "").encode("utf-8", "replace").decode()


def _members(data):
    """The objects of a block with their places: (value, place in a list, place in a @graph)."""
    for j, value in enumerate(data) if isinstance(data, list) else [(None, data)]:
        if isinstance(value, dict):
            graph = value.get("@graph")
            if isinstance(graph, list):
                yield from ((g, j, k) for k, g in enumerate(graph) if isinstance(g, dict))
            else:
                yield value, j, None


def _read_block(text: str, base: str, place: int) -> list[dict]:
    """Items of one JSON-LD block. Text that is no JSON is one InvalidJSON item; whatever else goes wrong
    ends the block with a ParseError item and leaves the items before it."""
    try:
        block = json.loads(text)
    except json.JSONDecodeError:
        return [{"type": "InvalidJSON", "error": "JSON decode error"}]
    except Exception as e:
        return [{"type": "ParseError", "error": f"Parse error: {type(e).__name__}"}]
    out = []
    try:
        for value, j, k in _members(block):
            data, digest = _finished(value, base, in_lists=False)
            position = str(place if j is None else place * 100 + j) + ("" if k is None else f"-{k}")
            out.append({"type": _type_of(value), "data": data, "hash": digest, "position": position, "j": j or 0, "k": k or 0})
    except Exception as e:
        out.append({"type": "ParseError", "error": f"Parse error: {type(e).__name__}"})
    return out


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except Exception:
        return False
    return True


def _read_found(kind: str, text: str | None, base: str, place: int) -> list[dict]:
    if kind == "block":
        return _read_block(text, base, place)
    if kind == "unless json":
        return [] if _is_json(text) else [{}]
    if kind == "none":
        return [{}]
    try:      # annotated markup: repeated properties are lists of values, each of which may be relative
        data, digest = _finished(json.loads(text), base, in_lists=True)
        return [{"data": data, "hash": digest}]
    except Exception as e:
        return [{"type": "ParseError", "error": f"Parse error: {type(e).__name__}"}]


_READ = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "data", "hash", "position", "error")]
                     + [T.StructField(c, T.LongType()) for c in ("j", "k")])
_FOUND = pa.list_(pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in _READ]))
_NOTHING = dict.fromkeys(_READ.names)
#: Pieces of markup that are Python objects at a time.
PIECES_AT_ONCE = 1000


def _read_batches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What each found piece of markup (kind, text, base, place) holds. One reader decides what is JSON, and no text ends
    the job; a bounded part of a batch at a time becomes Python objects."""
    for columns in batches:
        for at in portions(columns[1], PIECES_AT_ONCE):
            rows = zip(*(c[at].to_pylist() for c in columns))
            yield pa.array([[{**_NOTHING, "j": 0, "k": 0, **x} for x in _read_found(*row)] for row in rows], type=_FOUND)


# Declared non-deterministic so that the optimizer evaluates it once per row.
_read = F.arrow_udf(_read_batches, T.ArrayType(_READ)).asNondeterministic()


# ---- extraction ---------------------------------------------------------------------------

def _short_type(name: Column) -> Column:
    return F.regexp_replace(name, r"https?://schema\.org/", "")


def _element(element: Column) -> Column:
    """The whole element as it stands in the page."""
    return H.source_of(SOURCE, element)


def _with(tag_or_attribute: str, by_tag: bool = False) -> Column:
    """Elements of a tag, or elements carrying an attribute."""
    if by_tag:
        return H.elements(NODES, tag_or_attribute)
    return F.filter(F.col(NODES)["elements"], lambda e: H.attr(e, tag_or_attribute).isNotNull())


def _json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substr(wrapped, F.lit(6), F.char_length(wrapped) - 6)


def _property_value(prop: Column) -> Column:
    """What an annotated element says: a media source, a link, a content attribute, a date or its text."""
    text = H.stripped_text_of(NODES, prop)
    blank = F.lit("")
    return (
        F.when(prop["tag"].isin("img", "audio", "video", "source"), F.coalesce(H.attr(prop, "src"), blank))
        .when(prop["tag"] == "a", F.coalesce(H.attr(prop, "href"), blank))
        .when(prop["tag"] == "meta", F.coalesce(H.attr(prop, "content"), blank))
        .when(prop["tag"] == "time", F.coalesce(H.attr(prop, "datetime"), text))
        .otherwise(text)
    )


def _annotated_json(item: Column, type_attr: str, prop_attr: str) -> Column:
    """JSON text of an annotated item: its type, then its properties in order of appearance."""
    named = F.filter(H.inside(NODES, item), lambda e: F.coalesce(H.attr(e, prop_attr), F.lit("")) != "")
    pairs = F.transform(named, lambda e: record(
        name=_short_type(H.attr(e, prop_attr)) if prop_attr == "property" else H.attr(e, prop_attr),
        value=_json_string(_property_value(e))))

    def assemble(ps: Column) -> Column:
        names = F.array_distinct(F.transform(ps, lambda p: p["name"]))

        def member(name: Column) -> Column:
            values = F.transform(F.filter(ps, lambda p: p["name"] == name), lambda p: p["value"])
            listed = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
            return F.concat(_json_string(name), F.lit(":"),
                            F.when(F.size(values) > 1, listed).otherwise(F.get(values, F.lit(0))))

        typed = F.concat(F.lit('"@type":'), _json_string(_short_type(H.attr(item, type_attr))))
        return F.concat(F.lit("{"), F.array_join(F.concat(F.array(typed), F.transform(names, member)), ","),
                        F.lit("}"))

    return let(pairs, assemble)


def _item(source: int, a: Column, fmt: str, kind: Column, raw: Column, reads: str = "none",
          text: Column | None = None, error: str | None = None) -> Column:
    """One found piece of markup: where it stands (`source`, then place among its like), what it is
    and how `_read` is to take its text."""
    none = F.lit(None).cast("string")
    return record(format=F.lit(fmt), type=kind, raw_data=raw, source=F.lit(source), place=a.cast("bigint"), reads=F.lit(reads),
                  text=none if text is None else text, error=none if error is None else F.lit(error))


def _annotated(fmt: str, source: int, scope_attr: str, type_attr: str, prop_attr: str) -> Column:
    scopes = F.transform(_with(scope_attr), lambda e, i: record(e=e, i=i))
    typed = F.filter(scopes, lambda s: F.coalesce(H.attr(s["e"], type_attr), F.lit("")) != "")
    return F.transform(typed, lambda s: _item(
        source, s["i"], fmt, _short_type(H.attr(s["e"], type_attr)), _element(s["e"]), "item",
        _annotated_json(s["e"], type_attr, prop_attr)))


def _microdata() -> Column:
    return _annotated("microdata", 1, "itemscope", "itemtype", "itemprop")


def _rdfa() -> Column:
    return _annotated("rdfa", 2, "typeof", "typeof", "property")


def _blocks() -> Column:
    """JSON-LD blocks, numbered."""
    return F.transform(F.filter(_with("script", by_tag=True), lambda e: H.attr(e, "type") == LD_JSON),
                       lambda e, i: record(i=i, raw=H.stripped_text_of(NODES, e)))


def _jsonld() -> Column:
    """JSON-LD blocks with text; an object, the objects of a list or those of a @graph are read from each."""
    return F.transform(F.filter(_blocks(), lambda b: b["raw"] != ""), lambda b: _item(
        0, b["i"], "json-ld", F.lit("Unknown"), b["raw"], "block", b["raw"]))


def _broken() -> Column:
    """Markup that looks like structured data but is not."""
    def numbered(found: Column) -> Column:
        return F.transform(found, lambda e, i: record(e=e, i=i))

    def value(element: Column, name: str) -> Column:
        return F.coalesce(H.attr(element, name), F.lit(""))

    def content(element: Column) -> Column:
        return H.stripped_text_of(NODES, element)

    def report(found: Column, source: int, fmt: str, kind: str, raw, error: str) -> Column:
        return F.transform(found, lambda s: _item(
            source, s["i"], fmt, F.lit(kind), raw(s["e"]), error=error))

    scripts = numbered(_with("script", by_tag=True))
    scoped, typed, metas = numbered(_with("itemscope")), numbered(_with("typeof")), numbered(_with("meta", by_tag=True))
    strings = numbered(F.filter(F.col(NODES)["texts"], lambda t: t["text"].contains("schema.org")))

    def meta_text(e: Column) -> Column:
        return F.coalesce(*[blank_to_null(H.attr(e, a)) for a in ("content", "property", "name")], F.lit(""))

    # Kept only if they turn out to be no JSON.
    suspects = F.filter(_blocks(), lambda b: b["raw"].contains("@context") & b["raw"].contains("@type")
                        & (b["raw"].contains("schema.org") | b["raw"].contains("Schema.org")))
    untyped = F.filter(scoped, lambda s: ~value(s["e"], "itemtype").contains("schema.org"))
    unbound = F.filter(typed, lambda s: (value(s["e"], "typeof") == "") | (
        ~value(s["e"], "typeof").contains("schema.org") & ~value(s["e"], "vocab").contains("schema.org")))
    in_meta = F.filter(metas, lambda s: meta_text(s["e"]).rlike(SCHEMA_URL))
    in_text = F.filter(strings, lambda s: s["e"]["text"].rlike(SCHEMA_URL))
    stray = F.filter(scripts, lambda s: let(content(s["e"]), lambda c: c.contains("@context") | c.contains("@type"))
                     & ~value(s["e"], "type").contains(LD_JSON))
    # The error texts are fixed values.
    return F.concat(
        F.transform(suspects, lambda b: _item(3, b["i"], "json-ld", F.lit("BrokenJSON-LD"), b["raw"], "unless json", b["raw"],
                                              error="Malformed JSON-LD: Invalid JSON syntax")),
        report(untyped, 4, "microdata", "BrokenMicrodata", _element,
               "Malformed microdata: itemscope without valid itemtype"),
        report(unbound, 5, "rdfa", "BrokenRDFa", _element,
               "Malformed RDFa: typeof without valid schema.org vocab"),
        report(in_meta, 6, "meta", "BrokenMetaSchema", _element,
               "Schema.org reference in meta tag without proper structure"),
        report(in_text, 7, "comment", "BrokenCommentSchema", lambda t: t["text"],
               "Schema.org reference in comment without proper structure"),
        report(stray, 8, "json-ld", "BrokenScriptSchema", content,
               "JSON-LD content in script tag without proper type attribute"),
    )


SOURCES = {"json-ld": _jsonld, "microdata": _microdata, "rdfa": _rdfa, "broken": _broken}


def found_items(sources: list[str] | None = None) -> Column:
    """Structured data of a parsed page as an array, from all sources or those named."""
    return F.concat(*[SOURCES[name]() for name in sources or SOURCES])


def items_of(pages: DataFrame) -> DataFrame:
    """One row per item of pages (url, items), normalized, hashed and validated.

    `ordinal` sorts the items of a page: by source, then as they appear.
    """
    found = pages.select("url", F.explode("items").alias("_i")).select("url", "_i.*")
    rows = found.withColumn("_n", F.explode(_read("reads", "text", "url", "place")))
    flat = rows.select(
        "url", "format", F.coalesce("_n.type", "type").alias("type"), "raw_data", F.col("_n.data").alias("parsed_data"),
        F.coalesce("_n.position", F.col("place").cast("string")).alias("position"),
        F.struct("source", "place", "_n.j", "_n.k").alias("ordinal"), F.col("_n.hash").alias("content_hash"),
        F.coalesce("_n.error", "error").alias("error"))
    return schema_validate(flat).select("url", *ITEM_COLUMNS)


def extract_schema(pages: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Structured data of pages (url, html): JSON-LD, microdata, RDFa and broken markup, or the
    `sources` named. Every page is parsed once."""
    parsed = with_nodes(pages.select("url", "html"), source=True)
    return items_of(parsed.select("url", found_items(sources).alias("items")))


# ---- validation ---------------------------------------------------------------------------

def _lacks(data: Column, key: str) -> Column:
    """The key is absent or holds nothing."""
    value = F.to_json(F.try_variant_get(data, f"$['{key}']", "variant"))
    return F.coalesce(value.isin("null", '""', "0", "0.0", "false", "[]", "{}"), F.lit(True))


def _has(data: Column, key: str) -> Column:
    return F.try_variant_get(data, f"$['{key}']", "variant").isNotNull()


def schema_validate(items: DataFrame) -> DataFrame:
    """Adds `validation_errors`, `severity` (info, warning, error, critical) and `is_valid`.

    An `error` column, if present, holds what extraction already found wrong.

    The severity is that of the last rule broken in the order the rules are listed; the two
    soft rules at the end only raise it from info.
    """
    # NaN and Infinity are numbers to the reader of items, but not to this one.
    plain = F.regexp_replace("parsed_data", r"(?<=[:,] |\[)(-?Infinity|NaN)(?=[,\]}])", '"$1"')
    data, kind = F.coalesce(F.try_parse_json("parsed_data"), F.try_parse_json(plain)), F.lower("type")
    video = kind == "videoobject"
    missing = [(f"{label} missing required '{key}' property", (kind == name) & _lacks(data, key))
               for name, (label, keys) in REQUIRED.items() for key in keys]
    embed = F.try_variant_get(data, "$.embedUrl", "string")
    upload = F.try_variant_get(data, "$.uploadDate", "variant")
    escaped = video & (embed.contains("&#038;") | embed.contains("&amp;"))
    foreign = video & ~(embed.startswith("http://") | embed.startswith("https://"))
    undated = video & upload.isNotNull() & (
        (F.schema_of_variant(upload) != "STRING") | (F.char_length(upload.cast("string")) < 10))
    no_image = video & ~_has(data, "thumbnailUrl") & ~_has(data, "image")
    no_duration = video & ~_has(data, "duration")
    # The error texts.
    rules = missing + [
        ("VideoObject embedUrl contains HTML entities that should be decoded", escaped),
        ("VideoObject embedUrl should be a valid HTTP/HTTPS URL", foreign),
        ("VideoObject uploadDate should be a valid ISO 8601 date string", undated),
        ("VideoObject missing 'thumbnailUrl' - CRITICAL for rich results eligibility", no_image),
        ("VideoObject missing 'duration' property (recommended for rich results)", no_duration),
    ]
    # Only string values of top-level keys that mention "url" are checked, in document order.
    members = F.from_json("parsed_data", "map<string,string>")
    kinds = F.try_variant_get(data, "$", "map<string,variant>")
    url_keys = F.filter(F.json_object_keys("parsed_data"), lambda k: F.lower(k).contains("url"))
    bad_keys = F.filter(url_keys, lambda k: (F.schema_of_variant(F.element_at(kinds, k)) == "STRING")
                        & ~F.element_at(members, k).rlike(r"^(?:https?://|/)"))
    bad_urls = F.transform(bad_keys, lambda k: F.concat(
        F.lit("Invalid URL format for "), k, F.lit(": "), F.element_at(members, k)))
    known = F.col("error") if "error" in items.columns else F.lit(None).cast("string")
    found = F.array_compact(F.array(known, *[F.when(broken, message) for message, broken in rules]))
    errors = F.concat(found, F.coalesce(bad_urls, F.array().cast("array<string>")))
    lacking = F.lit(False)
    for _, broken in missing:
        lacking = lacking | broken
    severity = (
        F.when(no_image, "critical").when(undated, "warning").when(foreign, "error").when(escaped, "warning")
        .when(lacking, "error").when(no_duration, "warning")
        .when(F.coalesce(F.size(bad_urls), F.lit(0)) > 0, "warning").otherwise("info"))
    return items.withColumns({"validation_errors": errors, "severity": severity}).withColumn(
        "is_valid", F.size("validation_errors") == 0)


# ---- roles, instances, references ---------------------------------------------------------

def _main_rank() -> Column:
    ranks = F.create_map(*[x for i, t in enumerate(MAIN_TYPES) for x in (F.lit(t.lower()), F.lit(i))])
    return F.coalesce(F.element_at(ranks, F.lower("type")), F.lit(len(MAIN_TYPES)))


def _main_items(items: DataFrame) -> DataFrame:
    best = F.min(F.struct(_main_rank().alias("rank"), "ordinal", "type", "content_hash"))
    return items.groupBy("url").agg(best.alias("_m"), F.count("*").alias("items"))


def schema_main_entity(items: DataFrame) -> DataFrame:
    """The item each page is mainly about: best type, then first on the page."""
    return _main_items(items).select("url", "_m.ordinal", "_m.type", "_m.content_hash")


def schema_roles(items: DataFrame) -> DataFrame:
    """Every item with its `role`: main, property or related, and the main item's ordinal.

    `items` is read twice, so it should be a stored table rather than the extraction itself.
    """
    pages = _main_items(items)
    main = pages.select("url", F.col("_m.ordinal").alias("main_ordinal"))
    is_main = F.col("ordinal") == F.col("main_ordinal")
    part = F.lower("type").isin([t.lower() for t in PROPERTY_TYPES])
    return join_unique(items, main, "url", "inner", hottest(pages, "url", "items")).withColumn(
        "role", F.when(is_main, "main").when(part, "property").otherwise("related"))


def schema_stats(items: DataFrame) -> DataFrame:
    """Totals, counts by format and by type, valid and invalid items, and every error with its
    count, as rows (measure, label, n)."""
    def label(measure: str, value: Column) -> Column:
        return record(measure=F.lit(measure), label=value)

    errors = F.when(~F.col("is_valid"), F.transform("validation_errors", lambda e: label("error", e)))
    labels = F.concat(
        F.array(label("total_schemas", F.lit("")), label("format", F.col("format")), label("type", F.col("type")),
                label("validity", F.when(F.col("is_valid"), "valid").otherwise("invalid"))),
        F.coalesce(errors, F.array().cast("array<struct<measure:string,label:string>>")))
    return items.select(F.explode(labels).alias("_l")).groupBy("_l.measure", "_l.label").agg(F.count("*").alias("n"))


def identity_hash(faithful: bool = False) -> Column:
    """What makes two items the same instance. Items without data are told apart by type, format
    and text; `faithful` lets all of them share one instance."""
    raw = F.lit("{}") if faithful else F.concat_ws("|", "type", "format", "raw_data")
    return F.coalesce("content_hash", F.sha2(raw, 256))


def schema_instances(items: DataFrame, faithful: bool = False) -> DataFrame:
    """Distinct items by content; the first occurrence supplies the details."""
    stored = items.withColumns({
        "content_hash": identity_hash(faithful),
        "format": F.when(F.col("format").isin(FORMATS), F.col("format")).otherwise(FORMATS[0])})
    details = ["type", "format", "raw_data", "parsed_data", "is_valid", "validation_errors", "severity"]
    first = F.min(F.struct("url", "ordinal", *details))
    return stored.groupBy("content_hash").agg(first.alias("_f")).select(
        "content_hash", *[f"_f.{c}" for c in details])


def schema_references(items: DataFrame, related_parent: bool = False, faithful: bool = False) -> DataFrame:
    """Which instance stands where on which page, and below which item.

    Properties hang below the main item; related items stand alone unless `related_parent`.
    """
    roles = schema_roles(items.withColumn("content_hash", identity_hash(faithful)))
    main, part = F.col("role") == "main", F.col("role") == "property"
    below = part | ~main if related_parent else part
    return roles.select(
        "url", "ordinal", "content_hash",
        F.split("position", "-")[0].cast("bigint").alias("position"),
        F.when(part, F.lower("type")).alias("property_name"),
        main.alias("is_main_entity"),
        F.when(below, F.col("main_ordinal")).alias("parent_ordinal"))
