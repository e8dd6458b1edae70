"""Jobs that retry by timers, and polls that bear restarts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.streaming import polls, retries, usage


def attempt(payload: str, number: int) -> str:
    if payload == "never":
        return retries.NEVER
    return retries.DONE if number > int(payload) else retries.AGAIN


def test_timers_equal_batch(spark, tmp_path):
    """Three batches; due times fire while other jobs come in, and what is due later stays retrying."""
    t = datetime(2024, 1, 1)
    batches = [[("a", 0, "0"), ("b", 1, "1"), ("c", 2, "2"), ("d", 3, "3"), ("n", 4, "never"), ("a", 9, "2"), (None, 5, "0"), ("x", None, "0")], [("e", 100, "1"), ("b", 101, "0")], [("f", 5000, "2"), ("g", 5000, "0"), ("h", 4990, "1")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(j, t + timedelta(seconds=s) if s is not None else None, p) for j, s, p in rows], "job_id string, at timestamp, payload string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={i}"))
    stream = spark.readStream.schema("job_id string, at timestamp, payload string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(retries._PROVIDER)
    with retries.state_store(spark):
        log = usage.drain(retries.retrying(stream, attempt, base=30.0, cap=100.0, late="10 seconds"), str(tmp_path / "out"), "update")
    assert spark.conf.get(retries._PROVIDER) == before
    got = {}
    for r in log.collect():
        got[r["job_id"]] = max(got.get(r["job_id"], (0,)), (r["attempts"], r["status"], r["at"], r["due"]))
    jobs = [("a", 0, 1), ("b", 1, 2), ("c", 2, 3), ("d", 3, None), ("e", 100, 2), ("f", 5000, 3), ("g", 5000, 1), ("h", 4990, 2)]
    df = spark.createDataFrame([(j, t + timedelta(seconds=s), n) for j, s, n in jobs], "job_id string, at timestamp, tries int")
    want = {r["job_id"]: (r["attempts"], r["status"], r["at"], r["due"]) for r in retries.settled(df, F.col("tries"), F.lit(t + timedelta(seconds=4990)), base=30.0, cap=100.0).collect()}
    assert got.pop("n")[:2] == (1, "failed")
    assert got == want and want["f"][1] == "retrying" and want["c"] == (3, "embedded", t + timedelta(seconds=92), None)


def queue(spark, n):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, " " if i == 3 else "text", t, t + timedelta(seconds=n - i)) for i in range(n)], "job_id int, text string, created_at timestamp, updated_at timestamp")


def test_polls_bear_a_restart(spark, tmp_path):
    """A poll that fails after its claims is run again: nothing is lost or done twice, failures come back when due."""
    jobs, folder, calls = queue(spark, 20), str(tmp_path / "q"), []

    def ticks(spark, first, last):
        for i in range(first, last):
            spark.range(1).select(F.lit(datetime(2024, 1, 1) + timedelta(seconds=15 * i)).alias("timestamp")).write.parquet(f"{folder}/ticks/tick={i:03d}")
        return spark.readStream.schema("timestamp timestamp, tick int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks")

    def run(work):
        calls.append(sorted(r["job_id"] for r in work.collect()))
        if len(calls) == 2:
            raise RuntimeError("the service is gone")
        # Jobs divisible by 5 fail twice, job 7 for good.
        bad = (F.col("job_id") % 5 == 0) & (F.col("attempt_count") < 2)
        return work.withColumns({"ok": ~bad & (F.col("job_id") != 7), "retryable": F.col("job_id") != 7, "retry_after_seconds": F.lit(None).cast("double")})

    with pytest.raises(Exception, match="service is gone"):
        polls.poll(ticks(spark, 0, 3), lambda: jobs, folder, run, 6, every=None).awaitTermination()
    polls.poll(ticks(spark, 3, 7), lambda: jobs, folder, run, 6, every=None).awaitTermination()
    assert calls[1] == calls[2]  # the claims of the failed poll
    log = polls.outcomes(spark, folder)
    last = {r["job_id"]: (r["status"], r["attempt_count"]) for r in polls.state(jobs, folder, 99).collect()}
    want = {i: ("embedded", 3 if i % 5 == 0 else 1) for i in range(20)} | {7: ("failed", 1), 3: ("ready", 0)}
    assert last == want
    assert log.groupBy("job_id", "attempt_count").count().where("count > 1").count() == 0
    assert log.groupBy("batch").count().agg(F.max("count")).first()[0] <= 6


def test_poll_of_an_empty_queue(spark, tmp_path):
    assert polls.poll_until_empty(queue(spark, 1).limit(0), 10, str(tmp_path / "q")).count() == 0


def test_polls_of_jobs_that_succeed_are_claimed_at_once(spark, tmp_path, monkeypatch):
    """The results of the stream's polls, tick by tick, without a tick for each."""
    done = {"ok": F.lit(True), "retryable": F.lit(False), "retry_after_seconds": F.lit(None).cast("double")}
    streamed = polls.poll_until_empty(queue(spark, 20), 6, str(tmp_path / "q"), lambda work: work.withColumns(done))
    monkeypatch.setattr(polls, "poll", None)
    at_once = polls.poll_until_empty(queue(spark, 20), 6, str(tmp_path / "p"))
    assert at_once.columns == streamed.columns and at_once.dtypes == streamed.dtypes
    assert sorted(at_once.collect()) == sorted(streamed.collect())
    many = polls.poll_until_empty(queue(spark, 2000), 1, str(tmp_path / "p"))
    assert many.select("batch").distinct().count() == 1999
