import datetime as dt
import random

import pytest

from webstrata.operators import hosts as Ho
from webstrata.operators import retries as Rt

START = dt.datetime(2024, 1, 1)


def random_log(n=2500, seed=3):
    rng, now = random.Random(seed), {h: START for h in "hab"}
    rows = []
    for i in range(n):
        host = rng.choice("hhhhab")
        now[host] += dt.timedelta(seconds=rng.choice([0, 1, 5, 20, 59, 60, 61, 100]))
        status = rng.choice([200, 200, 404, 429, 503, 503, 500, 0, 503, 500, 100, 304])
        rows.append((i, now[host], host, f"u{i % 37}", status))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def walk(rows, threshold=5, recovery=60):
    hosts, out = {}, {}
    for event, at, host, _, status in in_order(rows):
        s = hosts.setdefault(host, ["CLOSED", 0, None])
        if s[0] == "OPEN" and (at - s[2]).total_seconds() > recovery:
            s[0] = "HALF_OPEN"
        seen = s[0]
        if 200 <= status < 500 and status != 429:
            if s[0] != "OPEN":
                s[0], s[1] = "CLOSED", 0
        elif status >= 500 or status in (429, 0):
            s[1], s[2] = s[1] + 1, at
            if s[0] == "HALF_OPEN" or (s[0] == "CLOSED" and s[1] >= threshold):
                s[0] = "OPEN"
        out[event] = (seen, s[0])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, host string, url string, status int")


def states(df):
    return {r.event_id: (r.state_before, r.state_after) for r in df.collect()}


@pytest.mark.parametrize("threshold", [2, 5])
def test_circuit_equals_a_sequential_walk(spark, threshold):
    rows = random_log()
    assert states(Ho.host_circuit(frame(spark, rows), threshold)) == walk(rows, threshold)


def test_circuit_reads_its_events_twice(spark):
    """Once for the small rows per chunk, once for the result; what is shuffled in full is one join."""
    plan = Ho.host_circuit(frame(spark, random_log(50)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and plan.count("Exchange ") + plan.count("BroadcastExchange") <= 4 and "Window" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_chunks_of_few_events(spark, seed):
    """Chunk borders anywhere: inside runs of failures, of successes, of neutral answers."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = random_log(220, 50 + seed)
        assert states(Ho.host_circuit(frame(spark, rows), 3)) == walk(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_circuit_opens_recovers_and_reopens(spark):
    at = [0, 1, 62, 63, 64, 65, 127]
    status = [503, 503, 200, 503, 503, 200, 503]
    rows = [(i, START + dt.timedelta(seconds=s), "h", "u", c) for i, (s, c) in enumerate(zip(at, status))]
    got = states(Ho.host_circuit(frame(spark, rows), 2))
    assert [got[i] for i in range(7)] == [
        ("CLOSED", "CLOSED"), ("CLOSED", "OPEN"), ("HALF_OPEN", "CLOSED"), ("CLOSED", "CLOSED"), ("CLOSED", "OPEN"),
        ("OPEN", "OPEN"), ("HALF_OPEN", "OPEN")]


def test_stored_state_continues_the_walk(spark):
    rows = random_log()
    early, late = [r for r in rows if r[0] < 1200], [r for r in rows if r[0] >= 1200]
    state = Ho.host_circuit_latest(Ho.host_circuit(frame(spark, early)))
    events = Ho._timed(frame(spark, late)).unionByName(Ho.circuit_as_events(state))
    got = states(Ho._circuit(events, 5, 60.0).where("event_id >= 0"))
    want = walk(rows)
    assert got == {r[0]: want[r[0]] for r in late}


def delays(rows):
    out = {}
    for _, _, host, _, status in in_order(rows):
        d = out.get(host, 0.2)
        if status in (429, 502, 503, 504):
            d = min(d * 3, 10)
        elif status in (408, 420, 423, 451):
            d = min(d * 1.5, 10)
        elif status in (200, 304) and d > 0.2:
            d = max(d * 0.9, 0.2)
        out[host] = d
    return out


def test_delay_equals_a_sequential_walk(spark):
    for seed in (3, 4):
        rows = random_log(seed=seed)
        got = {r.host: r.adaptive_delay for r in Ho.host_delay(frame(spark, rows)).collect()}
        assert got == pytest.approx(delays(rows))


def test_delay_continues_and_respects_robots(spark):
    rows = random_log()
    early, late = [r for r in rows if r[0] < 1200], [r for r in rows if r[0] >= 1200]
    robots = spark.createDataFrame([("h", 30.0), ("a", None)], "host string, crawl_delay double")
    out = Ho.host_delay(frame(spark, late), robots, initial=Ho.host_delay(frame(spark, early)))
    got = {r.host: (r.adaptive_delay, r.current_delay) for r in out.collect()}
    want = delays(rows)
    assert {h: a for h, (a, _) in got.items()} == pytest.approx(want)
    assert got["h"][1] == 30.0 and got["a"][1] == pytest.approx(want["a"])


def test_failures_count_since_the_last_success_and_stay_finite(spark):
    minute = dt.timedelta(minutes=1)
    rows = [(0, START, "h", "a", 503), (1, START + minute, "h", "a", 200), (2, START + 2 * minute, "h", "a", 429),
            (3, START + 3 * minute, "h", "a", 500), (4, START, "h", "b", 404)]
    rows += [(10 + i, START, "h", "c", 0) for i in range(1500)]
    got = {r.url: r for r in Rt.failed_urls(frame(spark, rows), 1.0, 2.0).collect()}
    assert set(got) == {"a", "c"}
    a = got["a"]
    assert (a.status_code, a.retry_count, a.next_retry_at - a.last_retry_at) == (500, 1, 2)
    assert got["c"].retry_count == 1499 and got["c"].failure_reason == "Connection/timeout error"
    assert got["c"].next_retry_at is None        # beyond any time a bigint of seconds can state
    assert {r.url: r.next_retry_at - r.last_retry_at for r in Rt.failed_urls(frame(spark, rows), 1.0, 2.0, max_delay=60.0).collect()}["c"] == 60
