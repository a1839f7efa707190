"""Fixed-size chips: origins, mirrored padding, stitching, feature distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from landshift.functions.indices import l2


def chip_grid(grids: DataFrame, size: int) -> DataFrame:
    """A row for each chip origin of grids with ``height`` and ``width``; none where either is not positive."""
    steps = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / size).cast("int") - 1)
    grids = grids.where("height > 0 AND width > 0")
    return grids.withColumn("_i", F.explode(steps("height"))).withColumn("_j", F.explode(steps("width"))).withColumns({"top": F.col("_i") * size, "left": F.col("_j") * size}).drop("_i", "_j")


def places(at: str, n: str, size: int) -> Column:
    """Where a row (or column) of a grid of ``n`` comes to lie in chips of ``size`` each way: itself, and as often as the edge mirrors it."""
    last, turn = F.ceil(F.col(n) / size).cast("long") * size - 1, (F.col(n) * 2 - 2).cast("long")
    every = lambda first, step: F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<long>"))
    mirrored = F.when((F.col(at) == 0) | (F.col(at) == F.col(n) - 1), F.array().cast("array<long>")).otherwise(every(turn - F.col(at), turn))
    return F.when(F.col(n) == 1, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.concat(every(F.col(at), turn), mirrored))


def padded_chips(pixels: DataFrame, grids: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Every cell of every chip with its pixel; cells beyond the grid mirror it at the bottom and right.

    Each pixel names the cells that take it, so only pixels and grids meet in a join.  Cells made
    from the grids would look as small as the grids do to Spark, which then sends them all to every task.
    """
    cells = pixels.withColumns({c: F.col(c).cast("long") for c in ("r", "c")}).join(grids, keys).where("r >= 0 AND r < height AND c >= 0 AND c < width")
    cells = cells.withColumn("_y", F.explode(places("r", "height", size))).withColumn("_x", F.explode(places("c", "width", size)))
    cells = cells.withColumns({"top": F.expr(f"int(_y div {size} * {size})"), "left": F.expr(f"int(_x div {size} * {size})"), "i": F.expr(f"int(_y % {size})"), "j": F.expr(f"int(_x % {size})")})
    own = [c for c in grids.columns if c not in keys]
    return cells.select(*keys, "r", "c", *own, "top", "left", "i", "j", *(c for c in pixels.columns if c not in (*keys, "r", "c")))


def stitched(patches: DataFrame, grids: DataFrame, keys: list[str], patch: int) -> DataFrame:
    """Pixels of patch values (by ``pr``, ``pc``), clipped to the grid."""
    cells = patches.join(grids, keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(patch - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(patch - 1))))
    cells = cells.withColumns({"r": F.col("pr") * patch + F.col("_i"), "c": F.col("pc") * patch + F.col("_j")})
    return cells.where("r < height AND c < width").drop("_i", "_j", "pr", "pc", "height", "width")


def feature_distance(before: Column, after: Column) -> Column:
    return l2(before, after)


def min_max(values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``<column>_norm`` within each group; a range under 1e-8 gives 0.  Extremes are one row a group and join back."""
    span = values.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo") >= 1e-8
    norm = F.when(wide, F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return values.join(span, keys).withColumn(f"{column}_norm", norm).drop("_lo", "_hi")


class MeanStdModel:
    """A stand-in for a learned encoder: mean and deviation of each band.  The protocol is ``features(chip: (bands, cells)) -> vector``."""

    version, bands = "mean-std-1", ("b04", "b08")

    def features(self, chip: np.ndarray) -> np.ndarray:
        return np.concatenate([chip.mean(axis=1), chip.std(axis=1)])


def embed(chips: DataFrame, model: Callable[[], MeanStdModel]) -> DataFrame:
    """``features`` of rows whose ``data`` holds a chip's bands, flat and in turn; the model is built once a task."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model()
        for data in batches:
            yield pd.Series([None if x is None else m.features(np.asarray(x, float).reshape(len(m.bands), -1)) for x in data])

    return chips.withColumn("features", run("data"))


def bands_of(pairs: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Of each pair's band lists ``before_bands`` and ``after_bands``: the common ones, and the required ones that either lacks."""
    common = F.array_intersect("before_bands", "after_bands")
    return pairs.withColumns({"common": F.array_sort(common), "missing": F.array_sort(F.array_except(F.array(*map(F.lit, required)), common))})


def compared(cells: DataFrame, keys: list[str], model: Callable[[], MeanStdModel], before: list[str], after: list[str], size: int) -> DataFrame:
    """``distance`` of the features before and after of each chip, ``distance_norm`` within its grid, and ``covered``, the pixels of the grid that it stands for.

    ``cells`` are those of ``padded_chips``, with the bands' columns in the model's order.
    """
    at = [*keys, "top", "left"]
    chip = cells.groupBy(*at).agg(F.first("height").alias("height"), F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("i", "j", *before, *after))).alias("_cells"))  # size x size of them

    def band(name: str) -> Column:
        return F.transform("_cells", lambda x: x[name].cast("double"))

    for side, names in (("_before", before), ("_after", after)):
        flat = F.concat(*map(band, names))
        chip = embed(chip.withColumn("data", flat), model).withColumnRenamed("features", side)
    covered = F.least(F.lit(size), F.col("height") - F.col("top")) * F.least(F.lit(size), F.col("width") - F.col("left"))
    out = chip.select(*at, covered.cast("long").alias("covered"), feature_distance(F.col("_before"), F.col("_after")).alias("distance"))
    return min_max(out, keys, "distance")


def branch_summary(scored: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a grid: chips, mean and largest score over its pixels, and the model that gave them."""
    mean = F.sum(F.col("distance_norm") * F.col("covered")) / F.sum("covered")
    return scored.groupBy(*keys).agg(F.count("*").alias("chip_count"), mean.alias("change_score_mean"), F.max("distance_norm").alias("change_score_max")).withColumn("adapter_version", F.lit(version))


class PatchStats:
    """A stand-in for a learned encoder of patches: mean and deviation of each band in each patch.

    The protocol is ``features(chip: (bands, rows, columns)) -> (patches, numbers)``, the patches
    row by row; ``version``, ``bands`` and ``patch``, its pixels each way, say what it takes.
    """

    version, bands, patch = "patch-stats-1", ("b04", "b08"), 8

    def features(self, chip: np.ndarray) -> np.ndarray:
        n, h, w = chip.shape
        p = self.patch
        blocks = chip.reshape(n, h // p, p, w // p, p).transpose(1, 3, 0, 2, 4).reshape(-1, n, p * p)
        return np.concatenate([blocks.mean(axis=2), blocks.std(axis=2)], axis=1)


def patch_tensors(cells: DataFrame, keys: list[str], model: Callable[[], PatchStats], before: list[str], after: list[str], size: int) -> DataFrame:
    """Each chip's features of both dates, a binary of (patches x numbers) doubles each, with ``n_patches``, and the ``distances`` of its patches.

    ``cells`` are those of ``padded_chips``; a chip is one group of size x size cells.  The model is built once a group.
    """
    at = [*keys, "top", "left"]
    fields = StructType([*(cells.schema[k] for k in at), StructField("n_patches", IntegerType()), StructField("before", BinaryType()), StructField("after", BinaryType()), StructField("distances", ArrayType(DoubleType()))])
    to = to_arrow_schema(fields)

    def one(rows: pa.Table) -> pa.Table:
        m = model()
        order = np.lexsort((rows["j"].to_numpy(), rows["i"].to_numpy()))
        stack = lambda names: np.stack([rows[b].cast(pa.float64()).to_numpy()[order].reshape(size, size) for b in names])
        a, b = np.asarray(m.features(stack(before)), float), np.asarray(m.features(stack(after)), float)
        cols = {k: [rows[k][0].as_py()] for k in at} | {"n_patches": [len(a)], "before": [a.tobytes()], "after": [b.tobytes()], "distances": [np.sqrt(((b - a) ** 2).sum(axis=1)).tolist()]}
        return pa.Table.from_arrays([pa.array(cols[f.name], f.type) for f in to], schema=to)

    return cells.groupBy(*at).applyInArrow(one, fields)


def patch_map(tensors: DataFrame, grids: DataFrame, keys: list[str], patch: int, size: int) -> DataFrame:
    """The patches of all chips on their grid: ``pr``, ``pc``, ``distance`` and ``covered``, the pixels of the grid that a patch stands for; patches beyond the grid go.  ``stitched`` gives the pixels."""
    per = size // patch
    each = tensors.select(*keys, "top", "left", F.posexplode("distances").alias("_k", "distance"))
    each = each.select(*keys, F.expr(f"top div {patch} + _k div {per}").alias("pr"), F.expr(f"left div {patch} + _k % {per}").alias("pc"), "distance").join(grids, keys)
    inside = lambda n, at: F.greatest(F.lit(0), F.least(F.lit(patch), F.col(n) - F.col(at) * patch))
    return each.withColumn("covered", (inside("height", "pr") * inside("width", "pc")).cast("long")).where("covered > 0").drop("height", "width")


def ai_outcomes(pairs: DataFrame, pixels: DataFrame, grids: DataFrame, keys: list[str], model: Callable[[], PatchStats], before: list[str], after: list[str], size: int) -> DataFrame:
    """The branch of a learned encoder, whole: a row a pair with its chips and scores, or ``abstain`` and the reason.

    ``pairs`` has the bands' names of both dates (``before_bands``, ``after_bands``).  Pairs that
    lack a band of the model are told so and take no further part: their pixels are cut to no
    chips.  The others' patches are compared, laid on their grid, brought to 0..1 there, and
    summed over its pixels; a grid without rows or columns has nothing to say.
    """
    m = model()
    asked = bands_of(pairs, m.bands)
    able = asked.where(F.size("missing") == 0).select(*keys)
    cells = padded_chips(pixels.join(able, keys, "left_semi"), grids.join(able, keys, "left_semi"), keys, size)
    tensors = patch_tensors(cells.select(*keys, "top", "left", "i", "j", *before, *after), keys, model, before, after, size)
    scored = min_max(patch_map(tensors, grids, keys, m.patch, size), keys, "distance")
    mean = F.sum(F.col("distance_norm") * F.col("covered")) / F.sum("covered")
    told = scored.groupBy(*keys).agg(mean.alias("change_score_mean"), F.max("distance_norm").alias("change_score_max"))
    chips = chip_grid(grids.join(able, keys, "left_semi"), size).groupBy(*keys).agg(F.count("*").alias("chip_count"))
    reason = F.when(F.size("missing") > 0, F.concat(F.lit("missing bands: "), F.concat_ws(", ", "missing"))).when(F.col("change_score_max").isNull(), "no pixels")
    out = asked.join(told, keys, "left").join(chips, keys, "left").withColumn("abstain_reason", reason)
    return out.select(*keys, F.when(reason.isNull(), F.lit(m.version)).alias("adapter_version"), "chip_count", "change_score_mean", "change_score_max", F.col("abstain_reason").isNotNull().alias("abstain"), "abstain_reason")
