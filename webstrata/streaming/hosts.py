"""Per-host circuit state and delay over a stream of fetches (event_id, ts, host, status).

A micro-batch is folded by the same chunked operators as a batch job, starting from the state its predecessors wrote, so
a busy host is spread over tasks here too. It reads and writes the state of the hosts it touches; a silent host keeps
the row an earlier batch wrote. Batches see only what earlier batches wrote, so a replayed one gives the same rows. Event
ids are not negative, and events that arrive after a later batch was folded count from that batch's state on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from webstrata.operators.hosts import _circuit, _timed, circuit_as_events, host_circuit_latest, host_delay
from webstrata.session import cut
from webstrata.streaming.versions import SNAPSHOT_EVERY, latest, merged, snapshot_due, write_batch, write_snapshot

STATES = {
    "circuit_state": "host string, state string, failures_in_a_row bigint, last_failure bigint, last_event bigint",
    "delay_state": "host string, adaptive_delay double, last_request bigint, current_delay double"}
PER_HOST = latest(["host"])


def host_states(spark: SparkSession, out: str, table: str, batch_id: int | None = None) -> DataFrame:
    """The last state of every host after a batch (default the last one)."""
    return merged(spark, out, table, PER_HOST, batch_id, STATES[table]).drop("batch")


def _before(batch: DataFrame, out: str, table: str, batch_id: int) -> DataFrame:
    """The states of the hosts of a batch before it."""
    return cut(host_states(batch.sparkSession, out, table, batch_id - 1).join(batch.select("host").distinct(), "host", "left_semi"))


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in STATES[table].split(", ")]


def circuit_batch(batch: DataFrame, batch_id: int, out: str, failures: int = 5,
                  recovery_seconds: float = 60.0) -> None:
    """Fold one batch into the circuit states; writes the batch's events and the new states of its hosts."""
    past = circuit_as_events(_before(batch, out, "circuit_state", batch_id), failures)
    events = _timed(batch).unionByName(past.select("event_id", "host", F.col("status").cast(
        batch.schema["status"].dataType).alias("status"), "at"))
    done = cut(_circuit(events, failures, recovery_seconds))
    write_batch(done.where("event_id >= 0"), out, "circuit_events", batch_id)
    write_batch(host_circuit_latest(done).select(*_columns("circuit_state")), out, "circuit_state", batch_id)


def delay_batch(batch: DataFrame, batch_id: int, out: str, robots_delays: DataFrame | None = None) -> None:
    """Fold one batch into the host delays and write the new delays of its hosts."""
    touched = host_delay(batch, robots_delays, initial=_before(batch, out, "delay_state", batch_id))
    write_batch(touched.select(*_columns("delay_state")), out, "delay_state", batch_id)


def stream_hosts(fetch_log: DataFrame, out: str, checkpoint: str | None = None, available_now: bool = True,
                 robots_delays: DataFrame | None = None, snapshot_every: int = SNAPSHOT_EVERY) -> StreamingQuery:
    """Keep circuit states and delays of all hosts up to date."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        # Read once: the source's rows are used several times.
        rows = cut(batch)
        circuit_batch(rows, batch_id, out)
        delay_batch(rows, batch_id, out, robots_delays)
        if snapshot_due(batch_id, snapshot_every):
            for table in STATES:
                write_snapshot(rows.sparkSession, out, table, PER_HOST, batch_id)

    place = checkpoint or f"{out.rstrip('/')}/_checkpoint"
    writer = fetch_log.writeStream.option("checkpointLocation", place).foreachBatch(fold)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
