"""Job queues: pending work, retries with backoff, idempotence, dedup on enqueue, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attempts, and base and cap of the backoff in seconds.
EMBED_ATTEMPTS, EMBED_BASE, EMBED_CAP = 3, 5, 300
SUMMARY_ATTEMPTS, SUMMARY_BASE, SUMMARY_CAP = 4, 10, 300


def pending(jobs: DataFrame, now: Column, statuses: tuple[str, ...] = ("ready", "retrying"), limit: int | None = None) -> DataFrame:
    """Due jobs with text, oldest first. Within one query no row is handed out twice, so no locks are needed."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    rows = jobs.where(F.col("status").isin(*statuses) & due & (F.trim("text") != "")).orderBy("updated_at", "created_at", "job_id")
    return rows.limit(limit) if limit else rows


def backoff(attempt: Column, base: float = EMBED_BASE, cap: float = EMBED_CAP, jitter: float = 0.0, key: Column | None = None) -> Column:
    """min(cap, base * 2^(attempt-1)) seconds, and up to `jitter` more by a hash of the key: reruns agree."""
    wait = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))
    return wait if key is None else wait + jitter * F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000


def after_failure(jobs: DataFrame, now: Column, attempts: int = EMBED_ATTEMPTS, base: float = EMBED_BASE, cap: float = EMBED_CAP) -> DataFrame:
    """Next state of failed jobs: retrying with a due time while attempts are left, else failed."""
    tried = F.col("attempt_count") + 1
    again = F.col("retryable") & (tried < attempts)
    wait = F.coalesce(F.col("retry_after_seconds"), backoff(tried, base, cap))
    return jobs.withColumns(
        {
            "attempt_count": tried,
            "status": F.when(again, "retrying").otherwise("failed"),
            "next_attempt_at": F.when(again, now + F.make_dt_interval(secs=wait)),
        }
    )


def skip_done(jobs: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("block_id", "content_hash", "model_version", "model_name")) -> DataFrame:
    """Jobs whose content has not been embedded by this model in this version yet."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def enqueue(wanted: DataFrame, jobs: DataFrame, keys: tuple[str, ...] = ("document_id", "content_hash", "content_version"), live: tuple[str, ...] = ("pending", "running", "completed")) -> DataFrame:
    """Wanted jobs that are not in the queue already, one for each key."""
    return wanted.dropDuplicates(list(keys)).join(jobs.where(F.col("status").isin(*live)).select(*keys), list(keys), "left_anti")


def latest_state(log: DataFrame, key: list[str], *newest_first: Column) -> DataFrame:
    """Latest version of each key of an append-only log: how upserts read."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest_first))).where("_n = 1").drop("_n")


def ready_groups(items: DataFrame, group: str, done: Column) -> DataFrame:
    """Groups all of whose items are done."""
    return items.groupBy(group).agg(F.every(F.coalesce(done, F.lit(False))).alias("ready"), F.count("*").alias("n_items"), F.count_if(done).alias("n_done"))
