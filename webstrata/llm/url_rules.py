"""URL rules by a sort-merge range join: prefixes become intervals, a sorted sweep keeps the stack of nested rules.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's. The canonical key of a host
and a path is `com.example.www/` followed by the path: labels reversed, and a slash, which no host contains, in between.
A rule's key is the start of the keys it covers, so it is an interval of them, and two such intervals are nested or apart.
A URL is one point for each of its host's parents that rules may name: `www.example.com/x` is a point at
`com.example.www//x`, `com.example//x`, `com//x` and `//x`.

Points and rules are sorted together over the cluster. Within a range the sweep pushes a rule when its interval begins and
pops the rules whose interval has ended, so what is on top covers the point and is the longest that does. A range starts
with the rules still open from the ranges before it: one short stack per range, the only thing the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import bloom
from webstrata.llm.frames import ascii_lower, name, whole_row, with_results
from webstrata.session import cut, cut_in_order


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#`
    or the end. Both are empty without `://` or a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a short list of rules."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _labels(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, r"\."))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _rules(rules: DataFrame) -> DataFrame:
    """One row per rule and verdict: its key and what it reports; `reversed` is the host's part of the key."""
    clean = rules.where("verdict is not null").select(
        ascii_lower(name("host")).alias("host"), F.coalesce(name("path"), F.lit("")).alias("path"), name("verdict").alias("verdict"))
    told = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host = _reversed(_labels(F.col("host")))
    return told.select(host.alias("reversed"), F.concat(host, F.lit("/"), "path").cast("binary").alias("key"),
                       F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("length"),
                       F.length("host").alias("host_length"), F.size(_labels(F.col("host"))).alias("labels"), F.length("path").alias("path_length"))


def _points(urls: DataFrame, rules: DataFrame, words: int) -> DataFrame:
    """The points (key, rid) of all URLs at parents that rules may name.

    Parents with more labels than any rule's host are not listed, and paths go no further than the longest rule's: what
    follows cannot matter. A Bloom filter of bounded size drops parents that no rule names.
    """
    most = rules.agg(F.max("labels").alias("labels"), F.max("path_length").alias("path")).first()
    labels = _labels(F.col("host"))
    count = F.size(labels)
    depths = F.sequence(F.lit(0), F.least(count, F.lit(most.labels)))
    parents = F.transform(depths, lambda n: _reversed(F.slice(labels, count - n + 1, n)))
    points = urls.select("rid", F.substring("path", 1, most.path).alias("path"), F.explode(parents).alias("reversed"))
    named = cut(bloom.build(rules.select("reversed").distinct(), F.xxhash64("reversed"), words))
    maybe = bloom.probe(points.withColumn("hashed", F.xxhash64("reversed")), "hashed", named, words).where("maybe")
    return maybe.select(F.concat("reversed", F.lit("/"), "path").cast("binary").alias("key"), "rid")


def _close(stack: list, key: bytes) -> None:
    while stack and not key.startswith(stack[-1][0]):
        stack.pop()


def _stack_at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rules of a range that are open at its last rule."""
    from pyspark import TaskContext

    stack: list[tuple] = []
    for batch in batches:
        for rule in zip(*(batch.column(c).to_pylist() for c in ("key", "rule", "verdict", "length", "host_length"))):
            _close(stack, rule[0])
            stack.append(rule)
    if stack:
        columns = [pa.array([TaskContext.get().partitionId()] * len(stack), pa.int32()), pa.array(range(len(stack)), pa.int32())]
        columns += [pa.array([r[i] for r in stack], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "key", "rule", "verdict", "length", "host_length"])


def _open_at_start(events: DataFrame) -> dict[int, list[tuple]]:
    """Per range with rules: the stack with which the next range starts.

    The rules around a point are among those around the last rule before it, so ranges without rules change nothing.
    """
    rows = events.where("kind = 0").mapInArrow(
        _stack_at_end, "part int, at int, key binary, rule string, verdict string, length int, host_length int").collect()
    own: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r.part, r["at"])):
        own.setdefault(r.part, []).append((bytes(r.key), r.rule, r.verdict, r.length, r.host_length))
    after, stack = {}, []
    for part, local in own.items():
        stack = list(stack)
        _close(stack, local[-1][0])
        stack += local
        after[part] = stack
    return after


def _sweep(after: dict[int, list[tuple]]):
    """The longest rule around every point of a range, as (rid, length, host_length, rule, verdict)."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before = [part for part in after if part < TaskContext.get().partitionId()]
        stack = list(after[max(before)]) if before else []
        for batch in batches:
            rids, found = [], []
            for key, kind, rid, *rule in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "rid", "rule", "verdict", "length", "host_length"))):
                _close(stack, key)
                if kind == 0:
                    stack.append((key, *rule))
                elif stack:
                    rids.append(rid)
                    found.append(stack[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64())] + [pa.array([f[i] for f in found], kind) for i, kind in
                                                ((3, pa.int32()), (4, pa.int32()), (1, pa.string()), (2, pa.string()))],
                names=["rid", "length", "host_length", "rule", "verdict"])
    return sweep


def longest_rules(urls: DataFrame, rules: DataFrame, words: int = bloom.WORDS) -> DataFrame:
    """(rid, rule, verdict): the longest rule that fits each of `urls` (rid, host, path), where one does.

    Longest is by the characters of host and path together, then by those of the host. A hot host or path is no hot
    range, since row numbers take part in the sort.
    """
    listed = cut(_rules(rules))
    if listed.isEmpty():
        return urls.select("rid", F.lit("").alias("rule"), F.lit("").alias("verdict")).where(F.lit(False))
    points = _points(urls, listed, words).select(
        "key", F.lit(1).alias("kind"), "rid", *[F.lit(None).cast(t).alias(c) for c, t in
                                                (("rule", "string"), ("verdict", "string"), ("length", "int"), ("host_length", "int"))])
    begins = listed.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("rid"), "rule", "verdict", "length", "host_length")
    order = ["key", "kind", "rid"]
    # Kept in order, so that both passes below see the same ranges; a lost executor reads them again.
    events = cut_in_order(points.unionByName(begins).repartitionByRange(*order).sortWithinPartitions(*order))
    found = events.mapInArrow(_sweep(_open_at_start(events)), "rid bigint, length int, host_length int, rule string, verdict string")
    best = found.groupBy("rid").agg(F.max(F.struct("length", "host_length", "rule", "verdict")).alias("best"))
    return best.select("rid", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", carry: list[str] | None = None,
          words: int = bloom.WORDS) -> DataFrame:
    """All rows of `pages` with host, path, rule and verdict.

    `rules` has host, path and verdict; null hosts and paths count as empty, a rule without host fits every URL, one
    without verdict is none, and of a rule stated twice the greater verdict holds (block before allow). Where no rule
    fits, as for most URLs without `://`, `rule` is null and the verdict is `otherwise`. Repeated rows are judged each.
    `carry` limits the input columns that are returned (default all); columns named like a result are replaced.
    """
    host, path = host_and_path(name(url_col))
    # Row numbers are written before anything is joined on them.
    rows = cut(pages.select(whole_row(pages, carry).alias("row"), host.alias("host"), path.alias("path"),
                            F.monotonically_increasing_id().alias("rid")))
    best = longest_rules(rows.select("rid", "host", "path"), rules, words)
    return with_results(rows.join(best, "rid", "left"), "row", {
        "host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": F.coalesce("verdict", F.lit(otherwise))})
