"""Joins by range, and global positions, without all-pairs work or a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.shared import written


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Each point with each interval that holds it (ends included).

    An interval is copied to the buckets it touches, a point is in one: choose the width near the
    intervals' so that copies are few.
    """
    spans = intervals.withColumn("_b", _buckets(F.col(low), F.col(high), width))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(spans, "_b").where(F.col(point).between(F.col(low), F.col(high))).drop("_b")


def overlapping_pairs(spans: DataFrame, keys: list[str], ident: str, low: str, high: str, width: int) -> DataFrame:
    """(left_id, right_id) of spans with equal keys that overlap, each pair once.

    A pair that shares several buckets counts in the first of them, so no distinct is needed.
    """
    rows = spans.withColumn("_b", _buckets(F.col(low), F.col(high), width))
    left = rows.select(*keys, "_b", F.col(ident).alias("left_id"), F.col(low).alias("_l1"), F.col(high).alias("_h1"))
    right = rows.select(*keys, "_b", F.col(ident).alias("right_id"), F.col(low).alias("_l2"), F.col(high).alias("_h2"))
    hit = left.join(right, [*keys, "_b"]).where("left_id < right_id AND _l1 <= _h2 AND _l2 <= _h1")
    return hit.where(F.col("_b") == F.floor(F.greatest("_l1", "_l2") / width)).select("left_id", "right_id")


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """keys, left_id, right_id and overlap (area) of boxes that share more than an edge, each pair once.

    left and right: keys, id, and box (x0, y0, x1, y1). Boxes are copied to the cells of a grid that
    they touch, so a page meets by cells instead of all its pairs; a pair that shares several cells
    counts in the one with the low corner of what they share. Choose the cell near the size of the
    boxes. Boxes that are null or turned round overlap nothing.
    """

    def placed(rows: DataFrame, side: str) -> DataFrame:
        box = F.col("box")
        good = rows.where((box[0] < box[2]) & (box[1] < box[3]))
        spread = good.withColumn("_x", _buckets(box[0], box[2], cell)).withColumn("_y", _buckets(box[1], box[3], cell))
        return spread.select(*keys, "_x", "_y", F.col("id").alias(f"{side}_id"), box.alias(f"_{side}"))

    both = placed(left, "left").join(placed(right, "right"), [*keys, "_x", "_y"])
    a, b = F.col("_left"), F.col("_right")
    low = [F.greatest(a[i], b[i]) for i in (0, 1)]
    wide, high = (F.least(a[i + 2], b[i + 2]) - low[i] for i in (0, 1))
    here = (F.floor(low[0] / cell) == F.col("_x")) & (F.floor(low[1] / cell) == F.col("_y"))
    return both.where((wide > 0) & (high > 0) & here).select(*keys, "left_id", "right_id", (wide * high).alias("overlap"))


def best_overlap(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The right_id of largest overlap for each left_id; the smaller id of equals."""
    best = F.max(F.struct("overlap", (-F.col("right_id")).alias("_r"))).alias("_best")
    return pairs.groupBy(*keys, "left_id").agg(best).select(*keys, "left_id", (-F.col("_best._r")).alias("right_id"), F.col("_best.overlap").alias("overlap"))


def positions(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows from 1 in an order: range partitions are numbered apart, then shifted by the counts before them.

    Only one count a partition meets in one place. The partitions are written, as two passes over
    a range shuffle may be cut at different bounds.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    numbered = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    shift = counts.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    return numbered.join(F.broadcast(shift), "_p").withColumn(out, (F.col("_n") + F.col("_s")).cast("int")).drop("_p", "_n", "_s")
