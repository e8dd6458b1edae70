"""Queue and quota queries over events: users stand for models, errors for failed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import jobs, quota
from corvane.plans.registry import query, table

_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("quota_session", """
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS err, date_diff('microsecond', lag(ts) OVER w, ts) AS gap, coalesce(lag(event_type = 'error') OVER w, false) AS prev_err FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7200000000 OR err OR prev_err THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM e)
SELECT event_id, user_id, session_no::BIGINT AS session_no, (row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id))::BIGINT AS used FROM s""")
def quota_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts in sessions with a gap of two hours (the events are far apart); errors start anew."""
    rows = quota.session_counts(_events(spark, sf_dir), ["user_id"], "ts", F.lit(1), "event_id", F.col("event_type") == "error", gap=7200)
    return rows.select("event_id", "user_id", "session_no", "used")


@query("quota_daily_la", """
SELECT user_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE AS day, count(*) AS requests, round(sum(value), 4) AS amount FROM events GROUP BY 1, 2""")
def quota_daily_la(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("day", quota.local_day(F.col("ts")))
    return rows.groupBy("user_id", "day").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("amount"))


@query("quota_reset_at", """
SELECT event_id, ((date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') + INTERVAL 1 DAY) AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC') AS reset_at FROM events""")
def quota_reset_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", quota.next_local_midnight(F.col("ts")).cast("timestamp_ntz").alias("reset_at"))


@query("sliding_rpm", """
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS last_10_min, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def sliding_rpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quota.sliding_counts(_events(spark, sf_dir), ["event_type"], "ts", 600, "last_10_min")
    return quota.sliding_counts(rows, ["event_type"], "ts", 86_400, "last_day").select("event_id", "last_10_min", "last_day")


@query("model_pick", f"""
WITH s AS (SELECT user_id % 10 AS project_id, 'm' || (user_id % 7) AS model_name, count(*) AS used, max(ts) + INTERVAL 12 DAY AS reset_at FROM events GROUP BY 1, 2),
m AS (SELECT p AS project_id, 'm' || q AS model_name, q AS priority FROM range(10) t(p), range(7) u(q))
SELECT project_id, min_by(model_name, priority) AS model_name FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.project_id = m.project_id AND s.model_name = m.model_name AND used >= 140 AND reset_at > {_NOW}) GROUP BY project_id""")
def model_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("project_id"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model_name")).agg(F.count("*").alias("used"), (F.max("ts") + F.expr("INTERVAL 12 DAYS")).alias("reset_at"))
    models = spark.range(70).select((F.col("id") % 10).alias("project_id"), F.concat(F.lit("m"), F.floor(F.col("id") / 10).cast("string")).alias("model_name"), F.floor(F.col("id") / 10).alias("priority"))
    return quota.pick_model(models, state.withColumn("limit", F.lit(140)), F.expr(_NOW))


@query("usage_summary", """
WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY 1), l AS (SELECT user_id, 20 + user_id % 50 AS lim FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, lim AS "limit", least(greatest(used, 0), lim) AS shown, greatest(lim - used, 0) AS remaining, used >= lim AS exhausted FROM u JOIN l USING (user_id)""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("used")).withColumn("limit", 20 + F.col("user_id") % 50)
    return used.select("user_id", "limit", F.least(F.greatest("used", F.lit(0)), "limit").alias("shown"), F.greatest(F.col("limit") - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") >= F.col("limit")).alias("exhausted"))


@query("reset_values", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 12.0 WHEN 1 THEN 0.25 WHEN 2 THEN 3.0 WHEN 3 THEN 120.0 WHEN 4 THEN 3600.0 END::DOUBLE AS seconds FROM events""")
def reset_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("12", "250ms", "3s", "2m", " 1H ", "soon")))
    return _events(spark, sf_dir).select("event_id", quota.reset_seconds(F.get(said, (F.col("event_id") % 6).cast("int"))).alias("seconds"))


@query("usage_tokens", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN 7 + event_id % 5 ELSE 0 END AS tokens FROM events""")
def usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    payload = F.when(e % 3 == 0, F.format_string('{"totalTokenCount": %d, "promptTokenCount": 1}', e)).when(e % 3 == 1, F.format_string('{"promptTokenCount": 7, "candidatesTokenCount": %d}', e % 5)).otherwise("no json")
    return _events(spark, sf_dir).select("event_id", quota.usage_tokens(payload).alias("tokens"))


_JOBS = """
jobs AS (
  SELECT event_id AS job_id, user_id, ts AS created_at, ts + INTERVAL 1 HOUR AS updated_at, CASE event_type WHEN 'view' THEN 'ready' WHEN 'click' THEN 'retrying' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 2 DAY END AS next_attempt_at, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE props END AS text, (event_id % 4)::INTEGER AS attempt_count FROM events
)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "ready").when(kind == "click", "retrying").when(kind == "signup", "running").when(kind == "purchase", "completed").otherwise("failed")
    e = F.col("event_id")
    return _events(spark, sf_dir).select(e.alias("job_id"), "user_id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"), status.alias("status"), F.when(e % 3 != 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("next_attempt_at"), F.when(e % 11 == 0, " ").otherwise(F.col("props")).alias("text"), (e % 4).cast("int").alias("attempt_count"))


@query("queue_pending", f"""
WITH {_JOBS} SELECT job_id, status FROM jobs WHERE status IN ('ready', 'retrying') AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) AND trim(text) <> '' ORDER BY updated_at, created_at, job_id LIMIT 256""")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run takes at most 256 due jobs."""
    return jobs.pending(_jobs(spark, sf_dir), F.expr(_NOW), limit=256).select("job_id", "status")


@query("retry_backoff", f"""
WITH {_JOBS} SELECT job_id, attempt_count + 1 AS attempt_count, CASE WHEN job_id % 2 = 0 AND attempt_count + 1 < 3 THEN 'retrying' ELSE 'failed' END AS status,
  CASE WHEN job_id % 2 = 0 AND attempt_count + 1 < 3 THEN {_NOW} + to_seconds(CASE WHEN job_id % 5 = 0 THEN 42 ELSE least(300, 5 * power(2, attempt_count))::INTEGER END) END AS next_attempt_at FROM jobs WHERE status = 'failed'""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _jobs(spark, sf_dir).where("status = 'failed'").withColumns({"retryable": F.col("job_id") % 2 == 0, "retry_after_seconds": F.when(F.col("job_id") % 5 == 0, 42.0)})
    return jobs.after_failure(failed, F.expr(_NOW)).select("job_id", "attempt_count", "status", F.col("next_attempt_at").cast("timestamp_ntz").alias("next_attempt_at"))


@query("idempotent_skip", """
SELECT event_id AS block_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id AND d.props = e.props)""")
def idempotent_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "event_type", F.col("user_id").alias("block_id"), F.col("props").alias("content_hash"), F.lit("v1").alias("model_version"), F.lit("m").alias("model_name"))
    return jobs.skip_done(rows.where("event_type = 'view'"), rows.where("event_type = 'purchase'")).select(F.col("event_id").alias("block_id"))


@query("enqueue_dedup", """
SELECT DISTINCT user_id AS document_id, props AS content_hash FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events q WHERE q.event_type IN ('view', 'signup') AND q.user_id = e.user_id AND q.props = e.props)""")
def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_type", F.col("user_id").alias("document_id"), F.col("props").alias("content_hash"), F.lit(1).alias("content_version"))
    queue = rows.where("event_type IN ('view', 'signup')").withColumn("status", F.when(F.col("event_type") == "view", "pending").otherwise("running"))
    return jobs.enqueue(rows.where("event_type = 'click'"), queue).select("document_id", "content_hash")


@query("latest_state", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(_events(spark, sf_dir), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("readiness_gate", """
SELECT user_id, bool_and(event_type <> 'error') AS ready, count(*) AS n_items, count(*) FILTER (event_type <> 'error') AS n_done FROM events GROUP BY 1""")
def readiness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ready_groups(_events(spark, sf_dir), "user_id", F.col("event_type") != "error")


@query("run_diagnostics", f"""
WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS embedded, count(*) FILTER (status = 'ready' AND attempt_count = 0) AS ready, count(*) FILTER (status = 'retrying' OR (status = 'ready' AND attempt_count > 0)) AS retrying, count(*) FILTER (status = 'failed') AS failed FROM jobs""")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("status"), F.col("attempt_count")
    return _jobs(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("embedded"), F.count_if((s == "ready") & (n == 0)).alias("ready"), F.count_if((s == "retrying") | ((s == "ready") & (n > 0))).alias("retrying"), F.count_if(s == "failed").alias("failed"))


@query("latest_failures", f"""
WITH {_JOBS} SELECT job_id, user_id FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC NULLS LAST, job_id LIMIT 20""")
def latest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 20 latest failures."""
    return _jobs(spark, sf_dir).where("status = 'failed'").orderBy(F.desc_nulls_last("updated_at"), "job_id").limit(20).select("job_id", "user_id")


@query("earliest_reset", """
WITH s AS (SELECT user_id % 10 AS project_id, user_id, max(ts) + INTERVAL 1 MINUTE AS reset_at, count(*) AS used FROM events GROUP BY 1, 2)
SELECT project_id, min(reset_at) FILTER (used >= 60) AS reset_at FROM s GROUP BY 1""")
def earliest_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("project_id"), "user_id").agg((F.max("ts") + F.expr("INTERVAL 1 MINUTE")).alias("reset_at"), F.count("*").alias("used"))
    return state.groupBy("project_id").agg(F.min(F.when(F.col("used") >= 60, F.col("reset_at"))).cast("timestamp_ntz").alias("reset_at"))


@query("event_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by session_window; its gap is a microsecond short, since it joins events a whole gap apart."""
    w = F.session_window("ts", "7199.999999 seconds")
    return _events(spark, sf_dir).groupBy("user_id", w).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "events")


@query("hourly_rates", """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS amount FROM events GROUP BY 1, 2""")
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("amount"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "amount")


@query("previous_value", """
SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events""")
def previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select("event_id", (F.col("value") - F.lag("value").over(w)).alias("change"))
