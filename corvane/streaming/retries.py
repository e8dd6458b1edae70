"""Jobs that retry by themselves: a state machine a job, with an event-time timer for its due time.

A job is tried when it comes in. A failure that can be retried sets a timer by the backoff; when
the watermark passes it, the job is tried again without any further input, until it succeeds or
has had its attempts. Timers and states live in the state store and survive restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a try gives: done, again (can be retried), or never.
DONE, AGAIN, NEVER = "done", "again", "never"
#: Times are milliseconds here; retrying gives timestamps.
OUT = "job_id string, status string, attempts int, at long, due long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def backoff_ms(attempt: int, base: float, cap: float) -> int:
    """Milliseconds to wait after the attempt of this number (from 1)."""
    return int(1000 * min(cap, base * 2 ** (attempt - 1)))


class Retries(StatefulProcessor):
    """attempt(payload, number) gives DONE, AGAIN or NEVER; it is the call of a model or service."""

    def __init__(self, attempt: Callable[[str, int], str], attempts: int, base: float, cap: float):
        self.attempt, self.attempts, self.base, self.cap = attempt, attempts, base, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, due long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = min((r.ms, r.payload or "") for r in rows)
        # A job that is known already is not started anew.
        if not self.state.exists():
            yield from self._advance(key[0], arrived[1], 0, arrived[0], max(timerValues.getCurrentWatermarkInMs(), arrived[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, tried, due, payload = self.state.get()
        # A timer of an older due time has nothing to say.
        if status == "retrying" and due <= timerValues.getCurrentWatermarkInMs():
            yield from self._advance(key[0], payload, tried, due, timerValues.getCurrentWatermarkInMs())

    def _advance(self, job: str, payload: str, tried: int, at: int, now: int) -> Iterator[Row]:
        """Try until nothing is due at `now`; due times that have passed already are caught up with."""
        while True:
            tried += 1
            outcome = self.attempt(payload, tried)
            if outcome == AGAIN and tried < self.attempts:
                due = at + backoff_ms(tried, self.base, self.cap)
                if due <= now:
                    at = due
                    continue
                status = "retrying"
                self.state.update((status, tried, due, payload))
                self.handle.registerTimer(due)
                break
            due, status = None, "embedded" if outcome == DONE else "failed"
            self.state.update((status, tried, due, payload))
            break
        yield Row(job_id=job, status=status, attempts=tried, at=at, due=due)

    def close(self) -> None:
        pass


def retrying(jobs: DataFrame, attempt: Callable[[str, int], str], attempts: int = 3, base: float = 5.0, cap: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """States of the jobs of a stream (job_id, at, payload), a row for each time a job comes to rest.

    A job comes to rest as embedded, failed, or retrying with a due time past the watermark. Rows
    of one job in a batch are one, the first by time; rows of a known job are ignored, rows later
    than the watermark are dropped.
    """
    rows = jobs.select(F.col("job_id").cast("string").alias("job_id"), F.col("at").cast("timestamp").alias("at"), F.col("payload").cast("string").alias("payload")).where("job_id IS NOT NULL AND at IS NOT NULL")
    # Rows, not a frame for each job: most jobs have few.
    rows = rows.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    out = rows.groupBy("job_id").transformWithState(Retries(attempt, attempts, base, cap), OUT, "Update", "EventTime")
    return out.withColumns({n: F.timestamp_millis(n) for n in ("at", "due")})


def settled(jobs: DataFrame, tries: Column, now: Column, attempts: int = 3, base: float = 5.0, cap: float = 300.0) -> DataFrame:
    """The same states from a table of jobs (job_id, at): what the stream has come to at the time `now`.

    tries: the number of the try that succeeds, null for none.
    """
    waits = [0]
    for n in range(1, attempts):
        waits.append(waits[-1] + backoff_ms(n, base, cap))
    moments = F.array(*[F.timestamp_millis(F.unix_millis("at") + w) for w in waits])
    last = F.least(F.coalesce(tries, F.lit(attempts)), F.lit(attempts))
    # The first try is made on arrival, the others once their time has come.
    made = F.greatest(F.lit(1), F.size(F.filter(moments, lambda m: m <= now)))
    rows = jobs.select("*", F.least(made, last).alias("attempts"), last.alias("_last"), moments.alias("_moments"), (F.coalesce(tries, F.lit(attempts + 1)) <= attempts).alias("_won"))
    rested = F.col("attempts") >= F.col("_last")
    status = F.when(rested & F.col("_won"), "embedded").when(rested, "failed").otherwise("retrying")
    return rows.select("job_id", status.alias("status"), F.col("attempts").cast("int").alias("attempts"), F.get("_moments", F.col("attempts") - 1).alias("at"), F.when(~rested, F.get("_moments", F.col("attempts"))).alias("due"))
