"""The registered query of every operator, with production parameters, and its expected result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build
    return register


@query()
def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.sharding import shard_rows

    return shard_rows(_table(spark, sf_dir, "documents"), [1.0] * 24)


@query("""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key
           FROM documents),
g AS (SELECT key, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY key)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, key AS text_sha256 FROM d JOIN g USING (key)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
lengths AS (SELECT DISTINCT n FROM bl),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op5_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


@query()
def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.records import encode_to_records

    return encode_to_records(_table(spark, sf_dir, "documents"))


@query()
def op9_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


@query()
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


@query()
def op7_ngram_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents")).drop("text_key", "class_number")


@query()
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.warc import derivatives

    return derivatives(_table(spark, sf_dir, "pages"))


@query()
def op6_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from webstrata.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        toxicity.rejected(model).alias("rejected"))


#: Rules of the registered query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(f"""
WITH rules AS (SELECT * FROM (VALUES {', '.join(map(str, URL_RULES))}) t(rule_host, rule_path, told)),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(told, 'allow') AS verdict
FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1
""")
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.url_rules import judge, rules_table

    return judge(_table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES), carry=["page_id"])


@query(r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part,
             CAST(len(words) < 50 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT) AS b,
             CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INT) AS c,
             CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INT) AS e FROM w),
m AS (SELECT f.*, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
      FROM f LEFT JOIN labels USING (doc_id)),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS ranks, chr(CAST(64 + p.x AS INT)) || chr(CAST(64 + q.x AS INT)) || chr(CAST(64 + r.x AS INT))
             || chr(CAST(64 + s.x AS INT)) || chr(CAST(64 + t.x AS INT)) AS filter_order
      FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, x AS step, ranks[x] AS filter, ranks[1:x - 1] AS before FROM o, l),
c AS (SELECT part, fails, n_fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY ALL),
j AS (SELECT part, filter_order, step, filter, n, n_good, n_toxic, n_fails, fails[filter] = 1 AS failed,
             len([b FOR b IN before IF fails[b] = 1]) > 0 AS gone FROM c, steps),
r AS (SELECT part, filter_order, step, filter,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (NOT gone AND failed), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND failed), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (failed AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(n_good) FILTER (NOT gone AND failed), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(n_toxic) FILTER (NOT gone AND failed), 0) AS BIGINT) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def _kmeans_sql(k: int, rounds: int) -> str:
    """Expected clusters: the rounds written out as steps."""
    parts = [f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings
           WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
v AS (SELECT vec_id, unnest(range(64)) AS i, unnest([CAST(floor(64 * c) AS BIGINT) FOR c IN x]) AS x FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM e QUALIFY k < {k}),
c0 AS (SELECT k, i, x FROM v JOIN s USING (vec_id))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, k, d FROM (SELECT vec_id, k, sum((v.x - c.x) * (v.x - c.x)) AS d
        FROM v JOIN c{r} c USING (i) GROUP BY vec_id, k) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k, i, sum(v.x) AS t, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY k, i),
c{r + 1} AS (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((t - ((t % n + n) % n)) // n AS BIGINT) END AS x
             FROM c{r} c LEFT JOIN m{r} USING (k, i))""")
    return ",\n".join(parts) + f""",
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)"""


@query(_kmeans_sql(16, 3))
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webstrata.llm.centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)
