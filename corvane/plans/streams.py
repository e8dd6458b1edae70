"""Streams over events, drained to what is there: their results equal batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import query, table
from corvane.shared import folder
from corvane.streaming import polls, retries, usage


def _folder(spark: SparkSession) -> str:
    return folder(spark, "stream")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/event[s].parquet")  # a glob, so that one file can be a source
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_hourly", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    out = usage.drain(rows.select("event_type", F.col("window.start").alias("hour"), "n"), _folder(spark), "complete")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_first_of_each", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.first_of_each(_stream(spark, sf_dir), ["user_id", "event_type"], late="60 days").select("user_id", "event_type")
    return usage.drain(rows, _folder(spark)).agg(F.count("*").alias("n"))


@query("stream_job_states", """
WITH e AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, min(n) FILTER (ok) AS won FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS job_id, CASE WHEN won <= 3 THEN 'embedded' ELSE 'failed' END AS status, CASE WHEN won <= 3 THEN won ELSE 3 END::INTEGER AS attempts FROM f""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts at a user's job: purchases succeed, all else can be tried again."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job_id"), (F.col("event_type") == "purchase").alias("ok"), F.lit(True).alias("retryable"), F.unix_micros("ts").cast("double").alias("at"))
    return usage.drain(usage.job_states(rows), _folder(spark), "update", ["job_id"]).select("job_id", "status", "attempts")


#: Retries of jobs wait three days first, so that some are still due when the events end.
_WAIT, _LATE = 3 * 86400.0, "1 day"


def _attempt(payload: str, number: int) -> str:
    """A service that fails so many times at a job as its payload says."""
    return retries.DONE if number > int(payload) else retries.AGAIN


@query("stream_retries", """
WITH jobs AS (SELECT user_id || ':' || event_type AS job_id, min(ts) AS at_, any_value((user_id + len(event_type)) % 5)::INTEGER AS fails FROM events GROUP BY user_id, event_type),
w AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events),
t AS (SELECT job_id, fails, at_, now, CASE WHEN at_ + INTERVAL 9 DAY <= now THEN 3 WHEN at_ + INTERVAL 3 DAY <= now THEN 2 ELSE 1 END AS made, least(fails + 1, 3) AS last_ FROM jobs, w)
SELECT job_id, CASE WHEN made < last_ THEN 'retrying' WHEN fails < 3 THEN 'embedded' ELSE 'failed' END AS status, least(made, last_)::INTEGER AS attempts,
  date_trunc('second', at_ + CASE least(made, last_) WHEN 3 THEN INTERVAL 9 DAY WHEN 2 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END) AS at, made < last_ AS waits FROM t""")
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of a user as jobs that fail up to four times: timers try them again, no further row does."""
    job = F.concat_ws(":", "user_id", "event_type")
    jobs = _stream(spark, sf_dir).select(job.alias("job_id"), F.col("ts").alias("at"), ((F.col("user_id") + F.length("event_type")) % 5).cast("string").alias("payload"))
    with retries.state_store(spark):
        out = usage.drain(retries.retrying(jobs, _attempt, base=_WAIT, cap=4 * _WAIT, late=_LATE), _folder(spark), "update", ["job_id"])
    return out.select("job_id", "status", "attempts", F.date_trunc("second", "at").cast("timestamp_ntz").alias("at"), F.col("due").isNotNull().alias("waits"))


@query("queue_polls", """
SELECT o_orderkey AS job_id, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000)::INTEGER AS batch FROM orders WHERE o_orderstatus = 'P'""")
def queue_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of a queue, 1,000 jobs each, oldest first, until none is ready; every job is claimed by one poll."""
    at = F.col("o_orderdate").cast("timestamp")
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("job_id"), F.lit("work").alias("text"), at.alias("created_at"), at.alias("updated_at"))
    return polls.poll_until_empty(jobs, 1000, _folder(spark)).select("job_id", "batch")
