"""Boxes on pages, as Column expressions over [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_bbox(box: Column, width: Column, height: Column) -> Column:
    """Divide by the page's size and round to 6 places; boxes that are in 0..1.5 already stay."""
    scaled = F.transform(box, lambda v, i: F.round(v / F.when(i % 2 == 0, width).otherwise(height), 6))
    return F.when(F.size(box) == 4, F.when(F.array_max(box) <= 1.5, box).otherwise(scaled))


def coordinate_space(box: Column) -> Column:
    """normalized_0_1 if the lower right corner lies within 1.5, else mineru_page_units; null without four numbers."""
    near = (F.get(box, F.lit(2)) <= 1.5) & (F.get(box, F.lit(3)) <= 1.5)
    return F.when(F.size(box) == 4, F.when(near, "normalized_0_1").otherwise("mineru_page_units"))


def nearest_rank(values: Column, share: float = 0.95, above: float = 1.5) -> Column:
    """The value at place int(share * n) of the sorted values above a bound."""
    good = F.array_sort(F.filter(values, lambda v: v > above))
    n = F.size(good)
    return F.when(n > 0, F.element_at(good, F.least(n, F.floor(n * share).cast("int") + 1)))


def column_bucket(box: Column) -> Column:
    """full, left, right or center of the page; unknown without a box."""
    x0, x1 = F.get(box, F.lit(0)), F.get(box, F.lit(2))
    mid = (x0 + x1) / 2
    return F.when(F.coalesce(F.size(box), F.lit(0)) != 4, "unknown").when(x1 - x0 >= 0.72, "full").when(mid <= 0.42, "left").when(mid >= 0.58, "right").otherwise("center")


def center_distance(a: Column, b: Column) -> Column:
    """L1 distance of two boxes' centres."""
    mid = lambda box, i: (F.get(box, F.lit(i)) + F.get(box, F.lit(i + 2))) / 2
    return F.abs(mid(a, 0) - mid(b, 0)) + F.abs(mid(a, 1) - mid(b, 1))


def vertical_gap(above: Column, below: Column) -> Column:
    return F.greatest(F.lit(0.0), F.get(below, F.lit(1)) - F.get(above, F.lit(3)))
