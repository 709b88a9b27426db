"""Per-host health from a fetch log (event_id, ts, host, status): circuit state and polite delay.

Both are folds over a host's events in time order. A host with a very large share of the log is
cut into ordered chunks, chunks are folded in parallel, and the chunk results are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions.expr import instant
from webstrata.operators.skew import chunked
from webstrata.session import cut

ORDER = ["at", "event_id"]
BLOCK_BITS = 10     # events composed as one list: 2^10

# How an answer changes the delay of its host.
SLOW_DOWN_HARD = [429, 502, 503, 504]
SLOW_DOWN = [408, 420, 423, 451]
SPEED_UP = [200, 304]


def _timed(log: DataFrame) -> DataFrame:
    """Event time as microseconds, for exact differences."""
    return log.select("event_id", "host", "status", F.unix_micros(instant(log, "ts")).alias("at"))


def is_failure(status: Column) -> Column:
    return (status >= 500) | (status == 429) | (status == 0)


def is_success(status: Column) -> Column:
    return status.between(200, 499) & (status != 429)


def host_circuit(fetch_log: DataFrame, failures: int = 5, recovery_seconds: float = 60.0) -> DataFrame:
    """State of each host's circuit at every event: as a request would see it (state_before) and
    after the outcome is recorded (state_after).

    The fold has two kinds of event after which the state no longer depends on the past: a success
    more than the recovery time after the last failure closes, and the n-th failure without a
    success in between opens. So the state follows from whichever came last. Chunks are scanned in
    parallel for what they tell alone; one small row per host and chunk is then folded in order, and
    its state completes the events of the next chunk. The log is read once.
    """
    return _circuit(_timed(fetch_log), failures, recovery_seconds)


def _local(timed: DataFrame, failures: int, recovery: int) -> DataFrame:
    """Every event with what its chunk alone tells.

    `failed` and `failed_at_ok` count the chunk's failures up to here and up to its last success, `last_failure`
    is the one before. Events that open or close the circuit whatever came before the chunk are marks. The
    chunk's first run of failures or of successes depends on what came before: those are its leads.
    """
    bad, ok = is_failure(F.col("status")), is_success(F.col("status"))
    here = F.struct("at", "event_id")
    rows = Window.partitionBy("host", "chunk").orderBy(*ORDER)
    upto, before = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
    counted = chunked(timed, "host", ORDER).withColumns({
        "failed": F.sum(bad.cast("bigint")).over(upto), "last_failure": F.max(F.when(bad, F.col("at"))).over(before)})
    counted = counted.withColumn("failed_at_ok", F.max(F.when(ok, F.col("failed"))).over(upto))
    alone = F.col("failed_at_ok").isNotNull()
    marks = {"opened": F.when(bad & alone & (F.col("failed") - F.col("failed_at_ok") >= failures), here),
             "closed": F.when(ok & (F.col("at") - F.col("last_failure") > recovery), here),
             "lead_failed": F.when(bad & ~alone, F.col("failed")),
             "lead_ok": F.when(ok & F.col("last_failure").isNull(), F.col("at"))}
    marked = counted.withColumns(marks)
    return cut(marked.withColumns({f"{m}_before": F.max(m).over(before) for m in marks}))


def _later(opened: Column, closed: Column) -> Column:
    """Whether the last mark opened the circuit."""
    return opened.isNotNull() & (closed.isNull() | (opened > closed))


def _carried(local: DataFrame, failures: int, recovery: int) -> DataFrame:
    """(host, chunk, carry): the state before each chunk, from one small row per host and chunk."""
    bad, ok = is_failure(F.col("status")), is_success(F.col("status"))
    chunks = local.groupBy("host", "chunk").agg(
        *[F.max(m).alias(m) for m in ("opened", "closed", "lead_failed", "lead_ok")],
        F.max(F.when(bad, F.col("at"))).alias("last_failure"), F.bool_or(ok).alias("any_ok"),
        (F.max("failed") - F.coalesce(F.max("failed_at_ok"), F.lit(0))).alias("tail"))
    listed = chunks.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(
        "chunk", "opened", "closed", "lead_failed", "lead_ok", "last_failure", "any_ok", "tail"))).alias("chunks"))

    def state(in_a_row: Column, last_failure: Column, is_open: Column) -> Column:
        return F.struct(in_a_row.cast("bigint").alias("in_a_row"), last_failure.cast("bigint").alias("last_failure"), is_open.alias("open"))

    def after(s: Column, c: Column) -> Column:
        opens = F.coalesce(s["in_a_row"] + c["lead_failed"] >= failures, F.lit(False))
        closes = F.coalesce(c["lead_ok"] - s["last_failure"] > recovery, F.lit(False))
        is_open = (F.when(c["opened"].isNotNull() | c["closed"].isNotNull(), _later(c["opened"], c["closed"]))
                   .when(opens, True).when(closes, False).otherwise(s["open"]))
        return state(F.when(c["any_ok"], c["tail"]).otherwise(s["in_a_row"] + c["tail"]),
                     F.coalesce(c["last_failure"], s["last_failure"]), is_open)

    start = state(F.lit(0), F.lit(None), F.lit(False))
    none = F.array().cast("array<struct<chunk:int,carry:struct<in_a_row:bigint,last_failure:bigint,open:boolean>>>")
    states = F.aggregate("chunks", F.struct(start.alias("now"), none.alias("out")), lambda acc, c: F.struct(
        after(acc["now"], c).alias("now"),
        F.concat(acc["out"], F.array(F.struct(c["chunk"].alias("chunk"), acc["now"].alias("carry")))).alias("out")))
    return listed.select("host", F.explode(states["out"]).alias("x")).select("host", "x.chunk", "x.carry")


def _circuit(timed: DataFrame, failures: int, recovery_seconds: float) -> DataFrame:
    recovery = int(recovery_seconds * 1_000_000)
    local = _local(timed, failures, recovery)
    rows = local.join(_carried(local, failures, recovery), ["host", "chunk"])
    bad, ok = is_failure(F.col("status")), is_success(F.col("status"))

    def opens(lead: str) -> Column:
        return F.coalesce(F.col("carry.in_a_row") + F.col(lead) >= failures, F.lit(False))

    def closes(lead: str) -> Column:
        return F.coalesce(F.col(lead) - F.col("carry.last_failure") > recovery, F.lit(False))

    marked = F.col("opened_before").isNotNull() | F.col("closed_before").isNotNull()
    rows = rows.withColumn("_before", F.when(marked, _later(F.col("opened_before"), F.col("closed_before")))
                           .when(opens("lead_failed_before"), True).when(closes("lead_ok_before"), False).otherwise(F.col("carry.open")))
    rows = rows.withColumn("_after", F.when(F.col("opened").isNotNull() | opens("lead_failed"), True)
                           .when(F.col("closed").isNotNull() | closes("lead_ok"), False).otherwise(F.col("_before")))
    last_failure = F.coalesce("last_failure", "carry.last_failure")
    rested = F.coalesce(F.col("at") - last_failure > recovery, F.lit(False))
    in_a_row = F.when(F.col("failed_at_ok").isNull(), F.col("carry.in_a_row") + F.col("failed")).otherwise(
        F.col("failed") - F.col("failed_at_ok"))
    before, after, neutral = F.col("_before"), F.col("_after"), ~bad & ~ok
    return rows.select(
        "event_id", "host", "status", "at", last_failure.alias("last_failure"),
        F.when(before & rested, "HALF_OPEN").when(before, "OPEN").otherwise("CLOSED").alias("state_before"),
        F.when(after & neutral & rested, "HALF_OPEN").when(after, "OPEN").otherwise("CLOSED").alias("state_after"),
        F.when(~after, in_a_row).alias("failures_in_a_row"))


def host_circuit_latest(circuit: DataFrame) -> DataFrame:
    """The last known state of every host, with the time of its last failure."""
    failed_at = F.when(is_failure(F.col("status")), F.col("at"))
    return circuit.groupBy("host").agg(
        F.max_by("state_after", F.struct("at", "event_id")).alias("state"),
        F.max_by("failures_in_a_row", F.struct("at", "event_id")).alias("failures_in_a_row"),
        F.greatest(F.max(failed_at), F.max("last_failure")).alias("last_failure"),
        F.max("at").alias("last_event"))


def circuit_as_events(state: DataFrame, failures: int = 5) -> DataFrame:
    """A stored state written as the few failures that lead to it, so that a later batch can be
    folded as if it followed the whole history."""
    count = F.when(F.col("state") == "CLOSED", F.coalesce("failures_in_a_row", F.lit(0))).otherwise(F.lit(failures))
    past = state.where((count > 0) & F.col("last_failure").isNotNull())
    return past.select(F.explode(F.sequence(F.lit(1), count.cast("int"))).alias("_i"), "host", "last_failure").select(
        (F.col("_i") - failures - 1).cast("bigint").alias("event_id"), "host", F.lit(0).cast("int").alias("status"),
        F.col("last_failure").alias("at"))


def _composed(steps: Column) -> Column:
    """Scalings (factor, low, high) applied one after the other, as one: d becomes min(max(factor * d, low), high)."""
    def scaling(factor: Column, low: Column, high: Column) -> Column:
        return F.struct(factor.alias("factor"), low.alias("low"), high.alias("high"))

    none = scaling(F.lit(1.0), F.lit(0.0), F.lit(float("inf")))
    return F.aggregate(steps, none, lambda a, b: scaling(
        a["factor"] * b["factor"], *[F.least(F.greatest(a[c] * b["factor"], b["low"]), b["high"]) for c in ("low", "high")]))


def _delay_scalings(timed: DataFrame, base: float, increase: float, decrease: float, cap: float) -> DataFrame:
    """(host, factor, low, high, last_request): all answers of a host composed in order of time.

    Composition is associative, so events are composed in blocks, blocks within their range of the sorted log, and ranges
    within their host. Only the last step lists what depends on the size of the log: one scaling per range.
    """
    hard, soft, good = (F.col("status").isin(x) for x in (SLOW_DOWN_HARD, SLOW_DOWN, SPEED_UP))
    step = F.struct("at", "event_id", F.when(hard, increase * 2).when(soft, increase).when(good, decrease).alias("factor"),
                    F.when(good, base).otherwise(0.0).alias("low"), F.when(good, float("inf")).otherwise(cap).alias("high"))
    ranged = timed.repartitionByRange("host", *ORDER).sortWithinPartitions("host", *ORDER)
    # The place in the sorted log: its upper bits are the range, so blocks of a range follow each other.
    placed = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    block = F.shiftright("place", BLOCK_BITS)
    blocks = placed.groupBy("host", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.when(hard | soft | good, step))).alias("steps"), F.max("at").alias("last_request"))
    ranges = blocks.select("host", "block", _composed(F.col("steps")).alias("s"), "last_request").groupBy(
        "host", F.shiftright("block", 33 - BLOCK_BITS).alias("range")).agg(
        F.array_sort(F.collect_list(F.struct("block", "s.*"))).alias("steps"), F.max("last_request").alias("last_request"))
    hosts = ranges.select("host", "range", _composed(F.col("steps")).alias("s"), "last_request").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("range", "s.*"))).alias("steps"), F.max("last_request").alias("last_request"))
    return hosts.select("host", _composed(F.col("steps")).alias("s"), "last_request").select("host", "s.*", "last_request")


def host_delay(fetch_log: DataFrame, robots_delays: DataFrame | None = None, initial: DataFrame | None = None,
               base: float = 0.2, increase: float = 1.5, decrease: float = 0.9, cap: float = 10.0) -> DataFrame:
    """Delay before the next request to each host: grows with overload answers, shrinks back with
    good ones, and is never below the host's robots delay (host, crawl_delay).

    Every answer is a bounded scaling of the delay; those of a host compose to one, which is applied to
    its starting delay (`initial`, else `base`).
    """
    known = _delay_scalings(_timed(fetch_log), base, increase, decrease, cap)
    if initial is not None:
        known = known.join(initial.select("host", F.col("adaptive_delay").alias("_start")), "host", "left")
    else:
        known = known.withColumn("_start", F.lit(None).cast("double"))
    adaptive = F.least(F.greatest(F.coalesce("_start", F.lit(base)) * F.col("factor"), F.col("low")), F.col("high"))
    out = known.select("host", adaptive.alias("adaptive_delay"), "last_request")
    if robots_delays is None:
        return out.withColumn("current_delay", F.col("adaptive_delay"))
    return out.join(robots_delays.select("host", "crawl_delay"), "host", "left").select(
        "host", "adaptive_delay", "last_request", F.greatest("adaptive_delay", "crawl_delay").alias("current_delay"))


def host_response_counts(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.groupBy("host", "status").agg(F.count("*").alias("n"))
