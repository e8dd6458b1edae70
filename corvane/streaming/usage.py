"""Usage windows, queues and dedup over streams: the batch operators' counterparts.

The reference behaviour has no rule for late data; here every stream names its watermark, and
rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.quota import DAY_ZONE, GAP_SECONDS


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: int = GAP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Requests in sessions with a gap. session_window joins events a whole gap apart, so its gap is a microsecond short."""
    w = F.session_window(ts, f"{gap - 1}.999999 seconds")
    return events.withWatermark(ts, late).groupBy(key, w).agg(F.count("*").alias("used")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "used")


def days(events: DataFrame, key: str, ts: str = "ts", zone: str = DAY_ZONE, late: str = "1 day") -> DataFrame:
    """Requests by local day; the watermark stays on the event's own time."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts), zone))
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 hour"), day.alias("day")).agg(F.count("*").alias("used")).select(key, "day", F.col("window.start").alias("hour"), "used")


def sliding(events: DataFrame, key: str, ts: str = "ts", width: str = "60 seconds", step: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Requests of the last minute, each second."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, width, step)).agg(F.count("*").alias("used")).select(key, F.col("window.end").alias("at"), "used")


def first_of_each(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Idempotent intake: one row for each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


STATE = "status string, attempts int, due double"
OUT = "job_id string, status string, attempts int, due double"


def job_states(results: DataFrame, attempts: int = 3, base: float = 5.0, cap: float = 300.0) -> DataFrame:
    """Latest state of every job from a stream of attempts (job_id, ok, retryable, at: seconds).

    ready -> embedded, or retrying with a due time by backoff, or failed after the last attempt.
    State is one small row a job; embedded and failed jobs stay what they are.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, tried, due = state.get if state.exists else ("ready", 0, None)
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            if status in ("embedded", "failed"):
                break
            tried += 1
            if row.ok:
                status, due = "embedded", None
            elif row.retryable and tried < attempts:
                status, due = "retrying", float(row.at + min(cap, base * 2 ** (tried - 1)))
            else:
                status, due = "failed", None
        state.update((status, tried, due))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [tried], "due": [due]})

    return results.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read the result.

    Each micro-batch replaces its own folder, so a batch that runs again writes the same rows.
    mode update keeps every version; with keys the last one of each is read. mode complete reads
    the last batch alone.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:06d}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch")).first()[0]
        return rows.where(F.col("_batch") == last).drop("_batch")
    if keys:
        # Later batches hold later versions; an empty key list keeps them all.
        newest = rows.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
        rows = rows.join(newest, [*keys, "_batch"])
    return rows.drop("_batch")
