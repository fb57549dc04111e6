"""Boxes as column expressions; coordinates grow right and down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_bbox(left: Column, top: Column, right: Column, bottom: Column, origin: Column, page_w: Column, page_h: Column):
    """struct(top, left, bottom, right) from the top-left corner, as page fractions."""
    lo_x, hi_x = F.least(left, right), F.greatest(left, right)
    lo_y, hi_y = F.least(top, bottom), F.greatest(top, bottom)
    flip = F.upper(origin).contains("BOTTOM")
    y0 = F.when(flip, page_h - hi_y).otherwise(lo_y)
    y1 = F.when(flip, page_h - lo_y).otherwise(hi_y)

    def scaled(v: Column, size: Column) -> Column:
        return F.when((v > 1.0) & (size > 0.0), v / size).otherwise(v)

    return F.struct(
        scaled(y0, page_h).alias("top"),
        scaled(lo_x, page_w).alias("left"),
        scaled(y1, page_h).alias("bottom"),
        scaled(hi_x, page_w).alias("right"),
    )


def overlap_area(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Area shared by two (left, top, right, bottom) boxes."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_ratio(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Shared area over the first box's own area."""
    own = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(own == 0, F.lit(0.0)).otherwise(overlap_area(a, b) / own)
