import random
import string

import pytest

from webstrata.llm.url_rules import judge, longest_rules, rules_table
from webstrata.session import cut

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return rest[:host].translate(LOWER), rest[host:end]


def plain(url, rules):
    """(host, path, rule, verdict) by trying every rule."""
    host, path = parts(url)
    best = None
    for rule_host, rule_path, verdict in rules:
        h, p = (rule_host or "").translate(LOWER), rule_path or ""
        if verdict is not None and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, verdict))
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, rules_table(spark, rules)).collect()}
    return [got[i] for i in range(len(urls))]


ODD = [None, "", "no scheme", "://", "http://", "http:///p", "HTTP://EXAMPLE.Net/EN/x", "http://example.net", "http://example.net?x=/en/",
       "http://example.net/en/#a", "x://y://z/en", "http://a.example.net/en/", "http://notexample.net/en/", "http://example.net./en/",
       "http://user@example.net:80/en/", "http://net/", "http://.net/", "http://a..net/é/ü", "http://exämple.net/日本", "http://example.net\n/en/\nb",
       "http://example.net/" + "en/" * 50_000, "http://" + "a." * 50_000 + "net/x", "http://example.net/en/", "http://example.net/en/"]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_odd_urls(spark):
    assert judged(spark, ODD, RULES) == [plain(u, RULES) for u in ODD]


def test_odd_rules(spark):
    rules = [(None, "/en/", "block"), ("", None, "allow"), ("NET", "", "block"), ("net", "", "allow"), ("a.example.net", None, None),
             ("example.net", "/en/", "allow"), ("example.net", "/en/", "block"), ("example.net", "/e", "allow"), ("notexample.net", "/en/x" * 999, "block")]
    assert judged(spark, ODD, rules) == [plain(u, rules) for u in ODD]


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_rules_equal_trying_every_rule(spark, seed):
    rng = random.Random(seed)

    def host():
        return ".".join(rng.choice(["a", "b", "com", "net"]) for _ in range(rng.randint(1, 4)))

    def path():
        return rng.choice(["", "/"]) + "/".join(rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["block", "allow"])) for _ in range(300)]
    urls = [f"http://{host()}{'/' if rng.random() < .9 else ''}{path().lstrip('/')}" for _ in range(1500)]
    assert judged(spark, urls, rules) == [plain(u, rules) for u in urls]


def test_rules_open_across_ranges(spark):
    """Every range of the sort but the first begins inside of rules that started before it."""
    rules = [("com", "/", "block"), ("com", "/x", "allow"), ("com", "/x/1", "block"), ("com", "/x/15", "allow")]
    urls = spark.range(4000).selectExpr("id as rid", "'h.com' as host", "concat('/x/', id % 40, '/') as path")
    rows = {(r.rid % 40, r.rule) for r in longest_rules(cut(urls), rules_table(spark, rules)).collect()}
    assert rows == {(n, "com/x/15" if n == 15 else "com/x/1" if str(n)[0] == "1" else "com/x") for n in range(40)}


def test_many_rules_on_one_hot_host(spark):
    rules = [("example.com", f"/{i}/", "block" if i % 2 else "allow") for i in range(5000)]
    urls = [f"https://www.example.com/{i * 7 % 6000}/page" for i in range(3000)]
    told = {p: v for _, p, v in rules}
    assert [r[3] for r in judged(spark, urls, rules)] == [told.get(f"/{i * 7 % 6000}/", "allow") for i in range(3000)]


def test_a_full_filter_changes_nothing(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    wide, narrow = (sorted((tuple(r) for r in judge(df, rules_table(spark, RULES), words=w).collect()), key=str) for w in (1 << 22, 1))
    assert wide == narrow


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "h", 7, "k", "row")], "page_id long, url string, host string, rid int, `key` string, `row` string")
    row = judge(df, rules_table(spark, RULES)).first()
    assert (row.host, row.rid, row["key"], row["row"], row.rule) == ("a.net", 7, "k", "row", "net/")
    assert judge(df.where("false"), rules_table(spark, RULES)).collect() == []
    assert [(r.rule, r.verdict) for r in judge(df, rules_table(spark, []), otherwise="block").collect()] == [(None, "block")]
