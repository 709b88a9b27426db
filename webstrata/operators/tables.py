"""Table maintenance: upserts, dictionaries and the tables derived from fetches and content.

Tables are immutable snapshots; every operator takes frames and returns the next version.
All "latest" and "first" choices are aggregates with map-side combination, not windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.expr import blank_to_null, strip
from webstrata.functions.headers import header
from webstrata.functions.urls import classify_url, fix_protocol_relative, resolve_url
from webstrata.operators.pages import page_text
from webstrata.operators.skew import dense_index, join_unique

# Statuses whose Location header names another URL.
REDIRECT_STATUSES = [301, 302, 303, 307, 308]


def row_digest(columns: list[str]) -> Column:
    """A hash of a row's content, to put rows in an order that does not depend on where they lie."""
    return F.xxhash64(F.to_json(F.struct(*columns)))


def upsert_latest(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest `order`; a batch row wins a tie, then the content decides."""
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("_new"), row_digest(rest)))
    return both.groupBy(key).agg(latest.alias("_row")).select(key, "_row.*").select(*current.columns)


def upsert_urls(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The URL table after a batch (url, kind, classification, discovered_from, seen_at, seq).

    New URLs are added; known ones take kind and classification of their last batch row, keep
    first_seen and the first known origin, and move last_seen forward.
    """
    known = current.select("url", "kind", "classification", "discovered_from", "first_seen", "last_seen",
                           F.lit(-1).cast("bigint").alias("seq"))
    seen = batch.select("url", "kind", "classification", "discovered_from", F.col("seen_at").alias("first_seen"),
                        F.col("seen_at").alias("last_seen"), F.col("seq").cast("bigint"))
    return known.unionByName(seen).groupBy("url").agg(
        F.max_by("kind", "seq").alias("kind"),
        F.max_by("classification", "seq").alias("classification"),
        F.min_by("discovered_from", F.when(F.col("discovered_from").isNotNull(), F.col("seq"))).alias("discovered_from"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def dictionary_extend(values: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """The dictionary (id, value) with the values of `column` it lacks; new ids follow the largest one,
    in value order."""
    seen = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    if existing is None:
        return dense_index(seen, ["value"], "id").select((F.col("id") + 1).alias("id"), "value")
    # One number: the aggregate of the whole dictionary.
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = dense_index(seen.join(existing, "value", "left_anti"), ["value"], "id")
    return existing.select("id", "value").unionByName(fresh.select((F.col("id") + 1 + top).alias("id"), "value"))


def dictionary_encode(values: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """`values` with `column` replaced by `<column>_id`; a frequent value does not load one task."""
    coded = dictionary.select(F.col("value").alias(column), F.col("id").alias(f"{column}_id"))
    return join_unique(values, coded, column, "left").drop(column)


def page_metadata(fetches: DataFrame) -> DataFrame:
    """Status, target and validators of every fetch (url, final_url, status, headers, chain, fetched_at).

    `chain` holds the hops as struct(url, status, headers), the request itself first.
    """
    first = F.get("chain", F.lit(0))
    initial = F.coalesce(first["status"], F.col("status"))
    location = blank_to_null(header(first["headers"], "location"))
    return fetches.select(
        "url", initial.alias("initial_status_code"), F.col("status").alias("final_status_code"), "final_url",
        F.when(initial.isin(REDIRECT_STATUSES), resolve_url("url", location, keep_fragment=True)).alias(
            "redirect_destination_url"),
        "fetched_at",
        F.regexp_replace(blank_to_null(header("headers", "etag")), r'^"+|"+$', "").alias("etag"),
        strip(blank_to_null(header("headers", "last-modified"))).alias("last_modified"))


def redirect_table(fetches: DataFrame) -> DataFrame:
    """Redirects: fetches with more than one hop; the last fetch of a source wins, among equal times its content decides."""
    hops = F.size("chain")
    rows = fetches.where(hops > 1).select(
        F.col("url").alias("source_url"), "fetched_at",
        F.struct(F.col("final_url").alias("target_url"), "chain", (hops - 1).cast("bigint").alias("chain_length"),
                 F.col("status").alias("final_status_code")).alias("_r"))
    last = F.struct(F.col("fetched_at"), row_digest(["_r"]))
    return rows.groupBy("source_url").agg(F.max_by("_r", last).alias("_r")).select("source_url", "_r.*")


def content_table(content: DataFrame, redirects: DataFrame) -> DataFrame:
    """Content of URLs that neither redirect nor are redirected to."""
    ends = redirects.select(F.col("source_url_id").alias("url_id")).unionByName(
        redirects.select(F.col("target_url_id").alias("url_id"))).where("url_id is not null").distinct()
    return content.join(ends, "url_id", "left_anti")


def robots_directives(content: DataFrame, matches: DataFrame) -> DataFrame:
    """Long table of directives per URL and source: html_meta, http_header, robots_txt."""
    def listed(source: str, column: str) -> DataFrame:
        return content.select("url", F.lit(source).alias("source"), F.explode(column).alias("directive"),
                              F.lit(None).cast("string").alias("value")).where("directive <> ''")

    rules = matches.select("url", F.lit("robots_txt").alias("source"), F.col("rule_type").alias("directive"),
                           F.col("rule_path").alias("value"))
    return (listed("html_meta", "html_meta_directives")
            .unionByName(listed("http_header", "http_header_directives"))
            .unionByName(rules).distinct())


def canonical_edges(content: DataFrame) -> DataFrame:
    """Canonical links from page heads, resolved against the page URL."""
    declared = content.where(blank_to_null("canonical_url").isNotNull())
    return declared.select(
        "url", resolve_url("url", fix_protocol_relative("canonical_url")).alias("canonical_url"),
        F.lit("html_head").alias("source")).distinct()


def hreflang_edges_html(content: DataFrame) -> DataFrame:
    """Alternate-language links from page heads."""
    rows = content.select("url", F.explode("hreflang_urls").alias("_h"))
    pairs = rows.select("url", F.col("_h.hreflang").alias("language_code"), F.col("_h.url").alias("_href"))
    return pairs.select("url", "language_code",
                        resolve_url("url", fix_protocol_relative("_href")).alias("href_url")).distinct()


def newly_linked_urls(targets: DataFrame, urls: DataFrame, base_domain: str, from_hreflang: bool) -> DataFrame:
    """Linked URLs (column url) the URL table does not know yet, classified."""
    fresh = targets.select("url").distinct().join(urls.select("url"), "url", "left_anti")
    return fresh.select("url", F.lit("other").alias("kind"),
                        classify_url("url", base_domain, from_hreflang).alias("classification"))


def _forbids(directives: Column) -> Column:
    return F.exists(directives, lambda d: d.contains("noindex"))


def indexability(verdicts: DataFrame, metadata: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Whether each URL may be indexed, and by which source it is forbidden.

    `verdicts` has url_id, robots_txt_allows and both directive arrays. `overall_indexable` is
    false without status 200, null without any canonical, false for a foreign canonical, else
    whether all three sources allow.
    """
    self_canonical = canonicals.groupBy("url_id").agg(
        F.bool_or(F.col("canonical_url_id") == F.col("url_id")).alias("is_self_canonical"))
    status = metadata.select("url_id", "initial_status_code")
    joined = verdicts.join(status, "url_id", "left").join(self_canonical, "url_id", "left")
    meta = ~F.coalesce(_forbids(F.col("html_meta_directives")), F.lit(False))
    http = ~F.coalesce(_forbids(F.col("http_header_directives")), F.lit(False))
    not_ok = F.col("initial_status_code").isNull() | (F.col("initial_status_code") != 200)
    allowed = F.col("robots_txt_allows") & meta & http
    return joined.select(
        "url_id", "robots_txt_allows", meta.alias("html_meta_allows"), http.alias("http_header_allows"),
        F.when(F.col("robots_txt_allows"), "").otherwise("disallow").alias("robots_txt_directives"),
        F.array_join(F.coalesce("html_meta_directives", F.array().cast("array<string>")), ",").alias("html_meta_directives"),
        F.array_join(F.coalesce("http_header_directives", F.array().cast("array<string>")), ",").alias("http_header_directives"),
        F.when(not_ok, F.lit(False)).when(F.col("is_self_canonical").isNull(), F.lit(None).cast("boolean"))
        .when(~F.col("is_self_canonical"), F.lit(False)).otherwise(allowed).alias("overall_indexable"))


def winning_fetches(fetches: DataFrame, key: str = "url") -> DataFrame:
    """One fetch per key: the last that brought an answer of its own; an unchanged answer (304) only stands
    where there is nothing else. Fetches of one time are told apart by their content.

    The choice is made on times and hashes; only the fetches chosen are then read in full.
    """
    rest = [c for c in fetches.columns if c not in (key, "html")]
    told = fetches.withColumn("_at", F.struct(F.coalesce(F.col("status") != 304, F.lit(True)), F.col("fetched_at"), row_digest(rest), F.xxhash64("html")))
    best = told.groupBy(key).agg(F.max("_at").alias("_best"))
    return told.join(best, key).where("_at = _best").drop("_at", "_best").dropDuplicates([key])


def split_not_modified(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unchanged, to process): answers 304 are done without extraction."""
    unchanged = F.coalesce(F.col("status") == 304, F.lit(False))
    return fetches.where(unchanged), fetches.where(~unchanged)


# ---- embeddings ---------------------------------------------------------------------------

def embedding_inputs(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Text and its length for every page with text, without pages that already have an embedding.

    The exclusion runs before the pages are parsed.
    """
    wanted = pages.where(F.col("html").isNotNull())
    if existing is not None:
        wanted = wanted.join(existing.select("url_id"), "url_id", "left_anti")
    return page_text(wanted).where("text <> ''").withColumn("text_length", F.char_length("text").cast("bigint"))


def upsert_embeddings(current: DataFrame, new: DataFrame) -> DataFrame:
    """One embedding per url_id; a newer created_at replaces vector, model and length."""
    return upsert_latest(current, new, "url_id", "created_at")


def embed(inputs: DataFrame, embedder: Callable[[list[str]], list], batch_size: int = 64) -> DataFrame:
    """Apply a caller's batch embedder: (url_id, embedding, text_length, error), one row per input.

    A failing batch yields rows with `error` set instead of failing the job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                try:
                    vectors, error = [list(map(float, v)) for v in embedder(part["text"].tolist())], None
                except Exception as failure:  # the caller's code may raise anything
                    vectors, error = [None] * len(part), f"{type(failure).__name__}: {failure}"
                yield pd.DataFrame({"url_id": part["url_id"], "embedding": vectors,
                                    "text_length": part["text_length"], "error": error})

    return inputs.select("url_id", "text", "text_length").mapInPandas(
        run, "url_id bigint, embedding array<float>, text_length bigint, error string")


def embed_counts(embedded: DataFrame, candidates: DataFrame) -> DataFrame:
    """Processed, skipped and failed pages of an embedding run, as one row."""
    done = embedded.select(F.when(F.col("error").isNull(), 1).otherwise(0).alias("p"),
                           F.when(F.col("error").isNull(), 0).otherwise(1).alias("e"), F.lit(0).alias("c"))
    offered = candidates.select(F.lit(0).alias("p"), F.lit(0).alias("e"), F.lit(1).alias("c"))
    totals = done.unionByName(offered).agg(F.sum("p").alias("processed"), F.sum("e").alias("errors"),
                                           F.sum("c").alias("_c"))
    return totals.select("processed", (F.col("_c") - F.col("processed") - F.col("errors")).alias("skipped"), "errors")
