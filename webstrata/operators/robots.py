"""robots.txt: parse files, judge URLs, look up crawl delays and sitemaps.

A file is one row, so parsing needs no shuffle. The rules of a host stay one row with an array in file order and an
index of the prefixes they match; judging a URL is one join on the host and a binary search.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.expr import blank_to_null, strip
from webstrata.functions.urls import path
from webstrata.operators.skew import join_unique

_LINE_BREAK = r"\R|[\x1c-\x1e]"

# Places a sitemap is looked for when robots.txt names none, in order.
COMMON_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml"]


_AGENT_LINE = r"(?im)^[ \t]*user-agent[ \t]*:"


def _agent_lines(files: DataFrame) -> DataFrame:
    """domain, user_agent, block, line, key, value of every `key: value` line that has an agent.

    Splitting at user-agent lines gives each block its agent without a window: the rest of the
    split line is the agent, the lines that follow belong to it.
    """
    blocks = files.select("domain", F.posexplode(F.split("body", _AGENT_LINE)).alias("block", "text"))
    lines = blocks.where("block > 0").select("domain", "block", F.split("text", _LINE_BREAK).alias("lines"))
    rows = lines.select("domain", "block", strip(F.get("lines", F.lit(0))).alias("user_agent"),
                        F.posexplode("lines").alias("line", "raw"))
    raw = strip("raw")
    return rows.where((F.col("line") > 0) & raw.contains(":") & ~raw.startswith("#")
                      & (F.col("user_agent") != "")).select(
        "domain", "user_agent", "block", "line",
        F.lower(strip(F.substring_index(raw, ":", 1))).alias("key"),
        strip(F.substr(raw, F.instr(raw, ":") + 1)).alias("value"))


def parse_robots(files: DataFrame) -> DataFrame:
    """Allow and disallow rules of robots files (domain, body), numbered in file order."""
    lines = _agent_lines(files).where(F.col("key").isin("allow", "disallow"))
    seq = F.col("block").cast("bigint") * F.lit(1 << 32) + F.col("line")
    return lines.select("domain", "user_agent", seq.alias("seq"),
                        F.col("key").alias("rule_type"), F.col("value").alias("rule_path"))


def robots_delays(files: DataFrame) -> DataFrame:
    """Crawl delay per domain and agent; the last readable one counts."""
    lines = _agent_lines(files).where(F.col("key") == "crawl-delay")
    delay = F.col("value").try_cast("double")
    return lines.where(delay.isNotNull()).groupBy("domain", "user_agent").agg(
        F.max_by(delay, F.struct("block", "line")).alias("crawl_delay"))


def crawl_delay(hosts: DataFrame, delays: DataFrame, agent: str) -> DataFrame:
    """Delay of every host: the agent's own, else the one for `*`; 0 counts as none."""
    own = F.max(F.when(F.col("user_agent") == agent, F.col("crawl_delay")))
    general = F.max(F.when(F.col("user_agent") == "*", F.col("crawl_delay")))
    per_domain = delays.where(F.col("user_agent").isin(agent, "*")).groupBy(F.col("domain").alias("host")).agg(
        F.coalesce(F.nullif(own, F.lit(0.0)), general).alias("crawl_delay"))
    return hosts.join(per_domain, "host", "left")


_INDEX = (T.StructType().add("keys", T.ArrayType(T.StringType())).add("parent", T.ArrayType(T.IntegerType()))
          .add("own", T.ArrayType(T.ArrayType(T.IntegerType()))).add("first", T.ArrayType(T.IntegerType()))
          .add("longest", T.ArrayType(T.BooleanType())).add("depth", T.IntegerType()))
_ARROW_INDEX = pa.struct([("keys", pa.list_(pa.string())), ("parent", pa.list_(pa.int32())), ("own", pa.list_(pa.list_(pa.int32()))),
                          ("first", pa.list_(pa.int32())), ("longest", pa.list_(pa.bool_())), ("depth", pa.int32())])


def rule_index(rules: list[dict]) -> dict:
    """The rules of a domain, in the order that decides, by the prefixes they match.

    `keys` are the prefixes in order of their bytes; `own` the places of a key's rules, `parent` the longest other key that
    it starts with, or -1. Every key that a path starts with is among the last key not behind the path and that key's
    parents; so `first` (the least place) and `longest` (whether the longest rule allows) already count the parents in.
    """
    by_key: dict[bytes, list[int]] = {}
    for place, rule in enumerate(rules):
        prefix = "" if rule["rule_path"] == "/" else rule["rule_path"].removesuffix("*")
        by_key.setdefault(prefix.encode(), []).append(place)
    keys = sorted(by_key)
    parent, first, longest, nesting = [], [], [], []
    best: list[tuple[int, bool]] = []
    open_: list[int] = []
    for at, key in enumerate(keys):
        while open_ and not key.startswith(keys[open_[-1]]):
            open_.pop()
        up = open_[-1] if open_ else -1
        told = [(len(rules[p]["rule_path"]), rules[p]["rule_type"] == "allow") for p in by_key[key] if rules[p]["rule_path"]]
        best.append(max([*told, *([best[up]] if up >= 0 else [])], default=(0, True)))
        parent.append(up)
        first.append(min([by_key[key][0], *([first[up]] if up >= 0 else [])]))
        longest.append(best[-1][1])
        open_.append(at)
        nesting.append(len(open_))
    return {"keys": [k.decode() for k in keys], "parent": parent, "own": [by_key[k] for k in keys], "first": first, "longest": longest,
            "depth": max(nesting, default=0)}


def _index_batch(rules: pa.Array) -> pa.Array:
    return pa.array([rule_index(r) for r in rules.to_pylist()], type=_ARROW_INDEX)


_indexed = F.arrow_udf(_index_batch, _INDEX).asNondeterministic()


def _rule_lists(rules: DataFrame, agent: str) -> DataFrame:
    """One row per domain: the agent's rules, then those for `*`, each in file order, and their index.

    A robots file is bounded (crawlers read at most 500 KiB of it), and so are its list and index.
    """
    ranked = rules.where(F.col("user_agent").isin(agent, "*")).select(
        "domain", F.struct((F.col("user_agent") != agent).alias("general"), "seq", "rule_type", "rule_path").alias("r"))
    listed = ranked.groupBy("domain").agg(F.array_sort(F.collect_list("r")).alias("rules")).select(
        "domain", F.transform("rules", lambda r: F.struct(r["rule_type"].alias("rule_type"), r["rule_path"].alias("rule_path"))).alias("rules"))
    return listed.withColumn("index", _indexed("rules"))


def _deepest(path_: Column, index: Column) -> Column:
    """The place of the longest key that the path starts with, or -1: a binary search, then up the parents."""
    keys = index["keys"]
    n = F.coalesce(F.size(keys), F.lit(0))

    def halved(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"], 1)
        left = F.get(keys, middle) <= path_
        return (F.when(span["low"] >= span["high"], span)
                .otherwise(F.struct(F.when(left, middle + 1).otherwise(span["low"]).alias("low"), F.when(left, span["high"]).otherwise(middle).alias("high"))))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    span = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halved)
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(index["depth"], F.lit(0))), span["low"] - 1, lambda at, _: F.when(
        (at >= 0) & ~path_.startswith(F.get(keys, at)), F.get(index["parent"], at)).otherwise(at))


def _judged(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """`urls` with the rules of their domain and `_at`, the deepest key that matches, -1 for none."""
    placed = urls.withColumns({"domain": F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1), "_path": path("url")})
    joined = join_unique(placed, _rule_lists(rules, agent), "domain", "left")
    return joined.withColumn("_at", F.when(F.col("index").isNull(), F.lit(-1)).otherwise(_deepest(F.col("_path"), F.col("index"))))


def robots_verdict(urls: DataFrame, rules: DataFrame, agent: str, rfc9309: bool = False) -> DataFrame:
    """`robots_allows` for every URL: the first matching rule decides, no match allows.

    An empty path matches everything, a trailing `*` is ignored. With `rfc9309` the longest
    matching rule decides instead: allow wins a tie, an empty rule matches nothing.
    """
    judged = _judged(urls, rules, agent)
    first = F.get("rules", F.get("index.first", F.col("_at")))["rule_type"] == "allow"
    verdict = F.get("index.longest", F.col("_at")) if rfc9309 else first
    return judged.select(*urls.columns, F.when(F.col("_at") < 0, F.lit(True)).otherwise(verdict).alias("robots_allows"))


def robots_matches(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Every rule that matches a URL, one row each."""
    up = F.aggregate(F.sequence(F.lit(1), F.col("index.depth")), F.array("_at"), lambda chain, _: F.concat(
        chain, F.array(F.coalesce(F.get("index.parent", F.element_at(chain, -1)), F.lit(-1)))))
    matched = _judged(urls, rules, agent).where("_at >= 0").withColumn("_up", up)
    keys = matched.select(*urls.columns, "rules", "index", F.explode(F.array_distinct("_up")).alias("_key")).where("_key >= 0")
    places = keys.select(*urls.columns, "rules", F.explode(F.get("index.own", F.col("_key"))).alias("_place"))
    return places.select(*urls.columns, F.get("rules", F.col("_place")).alias("_m")).select(*urls.columns, "_m.rule_type", "_m.rule_path")


def sitemaps_from_robots(files: DataFrame, known_sitemaps: DataFrame) -> DataFrame:
    """Sitemaps named by each robots file; for domains that name none, the first of the common
    places that is among `known_sitemaps(sitemap_url)`."""
    lines = files.select("domain", F.posexplode(F.split("body", _LINE_BREAK)).alias("line", "raw"))
    named = lines.where(F.lower(strip("raw")).startswith("sitemap:")).select(
        "domain", F.col("line").cast("bigint").alias("position"),
        blank_to_null(strip(F.substr("raw", F.instr("raw", ":") + 1))).alias("sitemap_url")).where(
        "sitemap_url is not null")
    silent = files.select("domain").join(named.select("domain").distinct(), "domain", "left_anti")
    places = F.transform(F.array(*[F.lit(p) for p in COMMON_SITEMAPS]),
                         lambda p: F.concat(F.lit("https://"), F.col("domain"), p))
    guesses = silent.select("domain", F.posexplode(places).alias("position", "sitemap_url"))
    hits = guesses.join(known_sitemaps.select("sitemap_url").distinct(), "sitemap_url", "left_semi")
    guessed = hits.groupBy("domain").agg(F.min(F.struct("position", "sitemap_url")).alias("_g")).select(
        "domain", F.lit(0).cast("bigint").alias("position"), "_g.sitemap_url")
    return named.unionByName(guessed)
