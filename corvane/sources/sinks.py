"""Sinks: replace by key, append-only upserts, batches for an external index, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corvane.operators.jobs import latest_state


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that df holds, and no others. One writer task a key keeps files few."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_versions(df: DataFrame, path: str, version: Column) -> None:
    """Append rows with a version: with read_latest an upsert."""
    df.withColumn("_version", version).write.mode("append").parquet(path)


def read_latest(df: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of the highest version."""
    return latest_state(df, key, F.desc("_version")).drop("_version")


def send_batches(df: DataFrame, send: Callable[[list[Row]], None], size: int = 64) -> None:
    """Hand rows to an external index in batches, from the executors. send must bear repeats: tasks can run again."""

    def run(rows: Iterable[Row]) -> None:
        batch: list[Row] = []
        for row in rows:
            batch.append(row)
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def html_report(title: str, counts: dict[str, int | str]) -> str:
    """A small page of figures that a query has counted."""
    from html import escape

    rows = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(str(v))}</td></tr>" for k, v in counts.items())
    return f"<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{rows}</table>"
