"""Operators over a pixel table (grid keys, row ``r``, column ``c``, a column a band)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.functions import indices


def valid_mask(reference: Column, scl: Column | None) -> Column:
    """Data in the reference band, and clear ground where there is a scene mask."""
    data = reference != 0
    return data if scl is None else data & F.coalesce(indices.clear_ground(scl), F.lit(True))


def pair_pixels(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Both dates by grid position: an equi-join that needs no exchange when both sides lie by ``keys``."""
    return before.join(after, [*keys, "r", "c"])


def pair_summary(pixels: DataFrame, keys: list[str], valid: str = "valid") -> DataFrame:
    """Valid fraction (0 if empty), and whether the pair is usable: 0.30 valid and 10 pixels each way."""
    return usability(pixels.groupBy(*keys).agg(*validity(valid)))


def validity(valid: str = "valid") -> list[Column]:
    """The aggregates of a grid that ``usability`` judges."""
    return [
        F.count("*").alias("n_pixels"),
        F.coalesce(F.avg(F.col(valid).cast("int")), F.lit(0.0)).alias("valid_fraction"),
        F.least(F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1).alias("shorter_side"),
        F.bool_or(valid).alias("any_valid"),
    ]


def usability(grids: DataFrame) -> DataFrame:
    large = F.col("shorter_side") >= 10
    return grids.withColumn("valid_fraction", F.when(large, F.col("valid_fraction")).otherwise(0.0)).withColumn("usable", large & (F.col("valid_fraction") >= 0.30))


def median_composite(scenes: DataFrame, keys: list[str], bands: list[str], valid: str = "valid", rank: str | None = None, max_scenes: int = 3) -> DataFrame:
    """Median of the valid values of each pixel over at most ``max_scenes`` scenes, and the union of their masks."""
    if rank:
        scenes = scenes.where(F.col(rank) <= max_scenes)
    medians = [F.median(F.when(F.col(valid), F.col(b))).cast("float").alias(b) for b in bands]
    return scenes.groupBy(*keys, "r", "c").agg(*medians, F.bool_or(valid).alias(valid))


def percent_clip(pixels: DataFrame, keys: list[str], band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The band's 8-bit stretch between two exact percentiles of its grid, ``<band>_8bit``.

    The percentiles are one row a grid and come back by an equi-join on the grid's keys.
    """
    cut = pixels.groupBy(*keys).agg(F.percentile(band, F.array(F.lit(low), F.lit(high))).alias("_cut"))
    cut = cut.select(*keys, F.col("_cut")[0].alias("_lo"), F.col("_cut")[1].alias("_hi"))
    flat, dark = F.col("_hi") - F.col("_lo") < 1, F.col("_hi") < 1
    lo = F.when(flat, 0.0).otherwise(F.col("_lo"))
    hi = F.when(flat, 1.0).otherwise(F.col("_hi"))
    value = (F.coalesce(F.col(band).cast("double"), F.col("_lo")) - lo) / (hi - lo) * 255
    scaled = F.when(flat & dark, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int"))
    return pixels.join(cut, keys).withColumn(f"{band}_8bit", scaled).drop("_lo", "_hi")


def stretched(pixels: DataFrame, keys: list[str], bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``percent_clip`` of several bands: one aggregate and one join for all of them."""
    cuts = pixels.groupBy(*keys).agg(*(F.percentile(b, F.array(F.lit(low), F.lit(high))).alias(f"_{b}") for b in bands))
    out = pixels.join(cuts, keys)
    for b in bands:
        low_, high_ = F.col(f"_{b}")[0], F.col(f"_{b}")[1]
        flat = high_ - low_ < 1
        lo, hi = F.when(flat, 0.0).otherwise(low_), F.when(flat, 1.0).otherwise(high_)
        value = (F.coalesce(F.col(b).cast("double"), low_) - lo) / (hi - lo) * 255
        scaled = F.when(flat & (low_ <= 0), F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("int"))
        out = out.withColumn(f"{b}_8bit", F.coalesce(scaled, F.lit(0)))
    return out.drop(*(f"_{b}" for b in bands))


def resample_half(pixels: DataFrame, coarse: DataFrame, keys: list[str], factor: int = 2) -> DataFrame:
    """Nearest resample of a coarser grid onto a finer one by integer division of the position."""
    fine = pixels.withColumns({"_r": F.expr(f"r div {factor}"), "_c": F.expr(f"c div {factor}")})
    coarse = coarse.withColumnsRenamed({"r": "_r", "c": "_c"})
    return fine.join(coarse, [*keys, "_r", "_c"]).drop("_r", "_c")


def bilinear(target: DataFrame, source: DataFrame, keys: list[str], band: str) -> DataFrame:
    """Band values at fractional source positions (``y``, ``x``) of target pixels: a weighted sum over four neighbours.

    Neighbours outside the source grid count with nothing; the weights that are left are scaled to one.
    """
    corner = F.explode(F.expr("array(struct(0 AS i, 0 AS j), struct(0 AS i, 1 AS j), struct(1 AS i, 0 AS j), struct(1 AS i, 1 AS j))"))
    near = target.withColumn("_k", corner).withColumns({"_r": (F.floor("y") + F.col("_k.i")).cast("long"), "_c": (F.floor("x") + F.col("_k.j")).cast("long")})
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    weight = F.when(F.col("_k.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.j") == 1, fx).otherwise(1 - fx)
    values = source.select(*keys, F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), F.col(band).alias("_v"))
    met = near.withColumn("_w", weight).join(values, [*keys, "_r", "_c"]).where("_w > 0 AND _v IS NOT NULL")
    return met.groupBy(*keys, "r", "c").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).cast("float").alias(band))
