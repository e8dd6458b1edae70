"""The folder that driver and executors share, for tables that are read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str = "table") -> str:
    """A new path below spark.checkpoint.dir; an error on a cluster that does not set it.

    Only where driver and tasks are one process (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Rows of a partition that `dealt` makes, about.
ROWS = 100_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in a partition for each ROWS rows: what a task holds does not grow with the table.

    The rows are counted first, which reads no column of a Parquet table.
    """
    return df.repartition(1 + df.count() // ROWS, *keys)


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read back: lineage ends there, and lost executors cost no more than that."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
