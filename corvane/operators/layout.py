"""Page layout: regions by vertical gaps, columns by horizontal gaps, blocks in and outside of tables.

Pages are partitions of bounded size; every step is a window or an equi join on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regions(blocks: DataFrame, page: list[str], top: str, bottom: str, gap: float, *tie: str) -> DataFrame:
    """Add region (from 0): a new one starts where a block's top lies more than `gap` below all before it."""
    by = Window.partitionBy(*page).orderBy(top, *tie)
    lowest = F.max(bottom).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(top) - lowest > gap, F.lit(False)).cast("int")
    return blocks.withColumn("_fresh", fresh).withColumn("region", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def columns(blocks: DataFrame, page: list[str], x: str, gap: float, most: int = 3, *tie: str) -> DataFrame:
    """Add column (from 0): a gap in x starts a new one, up to `most`."""
    by = Window.partitionBy(*page).orderBy(x, *tie)
    fresh = F.coalesce(F.col(x) - F.lag(x).over(by) > gap, F.lit(False)).cast("int")
    return blocks.withColumn("_fresh", fresh).withColumn("column", F.least(F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(most - 1))).drop("_fresh")


def nearest_center(x: Column, centers: Column) -> Column:
    """Index (from 0) of the nearest centre; the first of equals."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def outside_boxes(blocks: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Blocks whose centre (x, y) lies in no box (x0, y0, x1, y1) of their page."""
    b = boxes.select(F.col(page).alias("_page"), "x0", "y0", "x1", "y1")
    inside = (F.col(page) == F.col("_page")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return blocks.join(b, inside, "left_anti")
