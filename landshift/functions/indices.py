"""Column functions of the map algebra.  Masked values are NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that are no clear ground, and the class of missing data.
SCL_INVALID = (1, 3, 7, 8, 9, 10, 11)
SCL_NODATA = 0
#: Fixed value: the machine epsilon of 32-bit floats.
EPSILON = 1.1920929e-7
#: Fixed value: hectares of a 10 m pixel.
PIXEL_HA = 0.01


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) as FLOAT, within [-1, 1]; 0 where an input is negative or the sum is no more than EPSILON."""
    a, b = a.cast("double"), b.cast("double")
    ratio = F.greatest(F.least((a - b) / (a + b), F.lit(1.0)), F.lit(-1.0))
    return F.when((a >= 0) & (b >= 0) & (a + b > EPSILON), ratio).otherwise(0.0).cast("float")


def ndvi(b08: Column, b04: Column) -> Column:
    return normalized_difference(b08, b04)


def nbr(b08: Column, b12: Column) -> Column:
    return normalized_difference(b08, b12)


def ndmi(b08: Column, b11: Column) -> Column:
    return normalized_difference(b08, b11)


def index_difference(before: Column, after: Column, valid: Column) -> Column:
    """After less before where valid, else NULL."""
    return F.when(valid, (after - before).cast("float"))


def pixel_delta(pairs: list[tuple[Column, Column]], valid: Column) -> Column:
    """Euclidean distance over (before, after) bands where valid; 0 without bands."""
    if not pairs:
        return F.when(valid, F.lit(0.0).cast("float"))
    squares = [F.pow(after.cast("double") - before.cast("double"), F.lit(2)) for before, after in pairs]
    return F.when(valid, F.sqrt(reduce(lambda x, y: x + y, squares)).cast("float"))


def exceeds(difference: Column, threshold: float = 0.15, direction: str = "absolute") -> Column:
    """Strictly beyond the threshold, downward (negative), upward (positive) or either way; NULL counts as no change."""
    d, t = F.coalesce(difference, F.lit(0.0).cast("float")), F.lit(threshold).cast("float")
    if direction == "negative":
        return d < -t
    if direction == "positive":
        return d > t
    return F.abs(d) > t


def direction_for_task(task: Column) -> Column:
    return F.when(task == "vegetation_disturbance", "negative").otherwise("absolute")


def clear_ground(scl: Column) -> Column:
    """Mask of a scene read: neither an invalid class nor missing."""
    return ~scl.isin(*SCL_INVALID) & (scl != SCL_NODATA)


def locally_valid(scl: Column) -> Column:
    """Mask of a scene's quality figure, where missing data count as valid."""
    return ~scl.isin(*SCL_INVALID)


def valid_proxy(cloud: Column) -> Column:
    return (F.lit(100.0) - cloud) / 100.0


def score(ndvi_mean: Column, delta_mean: Column) -> Column:
    """The larger of the index's share of 0.5 and three tenths of the band distance's share of 5000, each at most 1."""
    by_index = F.least(F.abs(F.coalesce(ndvi_mean, F.lit(0.0))) / 0.5, F.lit(1.0))
    by_bands = F.least(F.coalesce(delta_mean, F.lit(0.0)) / 5000.0, F.lit(1.0))
    return F.greatest(by_index, by_bands * 0.3)


def min_pixels(area_ha: Column) -> Column:
    return F.greatest(F.lit(1), (area_ha / PIXEL_HA).cast("int"))


def overlay(value: Column, changed: Column, red: bool) -> Column:
    """A changed pixel is reddened: red up by 150 (255 at most), the others cut to three tenths."""
    return F.when(changed, F.least(value + 150, F.lit(255)) if red else F.floor(value * 3 / 10).cast("int")).otherwise(value)


def reflected(index: Column, size: Column) -> Column:
    """Where an index lands when the edge mirrors it and the edge itself is not repeated."""
    period = F.greatest(size * 2 - 2, F.lit(1))
    return F.when(size <= 1, F.lit(0)).otherwise(size - 1 - F.abs(size - 1 - index % period))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(y.cast("double") - x.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cross_season(before: Column, after: Column) -> Column:
    """Four months or more between the months' numbers; the turn of the year is not considered."""
    return F.abs(F.month(after) - F.month(before)) >= 4
