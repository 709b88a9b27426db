from pyspark.sql import functions as F

from webstrata.operators import depth as Dp
from webstrata.operators import frontier as Fr


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url_id long")


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_url_id long, target_url_id long")


def depths(df):
    return {r.url_id: (r.depth, r.parent_id) for r in df.collect()}


def test_clicks_add_one_and_redirects_nothing(spark):
    links = edges(spark, (0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (5, 6))
    redirects = edges(spark, (2, 5), (5, 2))
    got = depths(Dp.crawl_depth(ids(spark, 0), links, redirects, max_depth=2))
    assert got == {0: (0, None), 1: (1, 0), 2: (1, 0), 5: (1, 2), 3: (2, 1), 6: (2, 5)}


def plain_search(seeds, links, hops, max_depth):
    """Level by level, each with the redirects its URLs lead to; the least discoverer is the parent."""
    def close(found):
        todo = list(found)
        while todo:
            u = todo.pop()
            v = hops.get(u)
            if v is not None and v not in seen:
                if v not in found:
                    found[v] = u
                    todo.append(v)
                else:
                    found[v] = None if found[v] is None else min(found[v], u)
        return found

    seen = {}
    level = {u: (0, p) for u, p in close(dict.fromkeys(seeds)).items()}
    seen.update(level)
    for depth in range(1, max_depth + 1):
        clicked = {}
        for a, b in links:
            if a in level and b not in seen and a != b:
                clicked[b] = min(clicked.get(b, a), a)
        level = {u: (depth, p) for u, p in close(clicked).items()}
        seen.update(level)
    return seen


def test_long_chains_and_cycles_of_redirects(spark):
    links = [(0, 1000), (0, 2000), (1049, 1), (1, 1010), (2001, 2), (2, 5), (5, 1025)]
    hops = {1000 + i: 1001 + i for i in range(50)} | {2000: 2001, 2001: 2002, 2002: 2000, 5: 6, 6: 7}
    got = depths(Dp.crawl_depth(ids(spark, 0, 6), edges(spark, *links), edges(spark, *hops.items()), max_depth=4))
    assert got == plain_search([0, 6], links, hops, 4) and got[1050] == (1, 1049)
    short = depths(Dp.crawl_depth(ids(spark, 0), edges(spark, *links), edges(spark, *hops.items()), crawlable=spark.range(1020).withColumnRenamed("id", "url_id")))
    assert short == plain_search([0], [x for x in links if x[1] < 1020], {a: b for a, b in hops.items() if b < 1020}, 3)


def test_chains_beyond_the_reach_of_what_is_solved_before(spark):
    links = [(0, 1000), (0, 3000), (1150, 1), (1, 1070), (3005, 2)]
    hops = {1000 + i: 1001 + i for i in range(300)} | {3000 + i: 3000 + (i + 1) % 150 for i in range(150)} | {5000 + i: 5001 + i for i in range(100)}
    got = depths(Dp.crawl_depth(ids(spark, 0, 5000), edges(spark, *links), edges(spark, *hops.items()), max_depth=3))
    assert got == plain_search([0, 5000], links, hops, 3)


def test_a_level_is_one_join(spark, monkeypatch):
    """However long the redirects, a level is written once."""
    written = []
    monkeypatch.setattr(Dp, "cut", lambda df, real=Dp.cut: written.append(1) or real(df))
    links, none = edges(spark, *[(i, i + 1) for i in range(6)]), edges(spark, (90, 91))
    Dp.crawl_depth(ids(spark, 0), links, none, max_depth=2).count()
    few = len(written)
    Dp.crawl_depth(ids(spark, 0), links, none, max_depth=5).count()
    assert len(written) - 2 * few == 3


def test_only_crawlable_pages_are_entered(spark):
    links = edges(spark, (0, 1), (1, 2), (0, 3))
    got = depths(Dp.crawl_depth(ids(spark, 0), links, crawlable=ids(spark, 0, 2, 3)))
    assert got == {0: (0, None), 3: (1, 0)}


def test_page_limit_and_lists(spark):
    links = edges(spark, *[(0, i) for i in range(1, 20)], (1, 30))
    assert Dp.crawl_depth(ids(spark, 0), links, max_pages=5).count() == 5
    assert depths(Dp.crawl_depth(ids(spark, 0), links, url_list=ids(spark, 7))) == {7: (0, None)}
    assert depths(Dp.crawl_depth(ids(spark, 0), links, url_list=ids(spark, 1), list_is_seed=True))[30] == (1, 1)


def test_a_source_with_most_links(spark):
    links = spark.range(1, 4000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("source_url_id"),
                                        F.col("id").alias("target_url_id"))
    assert Dp.crawl_depth(ids(spark, 0), links).count() == 1 + links.where("source_url_id = 0").count()


def test_next_batch_breaks_ties_by_id(spark):
    rows = [(i, 0, None, "queued", 5, 5, 0.5, 0.5, 0) for i in range(10)]
    frontier = spark.createDataFrame(rows, "url_id long, depth long, parent_id long, status string, enqueued_at long, updated_at long, "
                                           "priority_score double, sitemap_priority double, reset_count long")
    urls = spark.range(10).select(F.col("id").alias("url_id"), F.concat(F.lit("u"), "id").alias("url"))
    assert sorted(r.url_id for r in Fr.frontier_next(frontier, urls, 3).collect()) == [0, 1, 2]
    one = Fr.frontier_reset_pending(frontier.withColumn("status", F.lit("pending")), 9, url_id=4)
    assert one.where("status = 'queued'").count() == 1
