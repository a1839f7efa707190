"""The common grid of two windows, and pixels warped onto it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType, LongType, StructField, StructType

from landshift.functions.geometry import GEOGRAPHIC, KM_PER_DEGREE, warp

#: Metres of a pixel; the fewest rows and columns of a usable grid; rows and columns of a block of source pixels that one task holds.
RESOLUTION, LEAST, BLOCK = 10.0, 10, 512
SIDES = ("minx", "miny", "maxx", "maxy")


def in_target(crs: Column, box: Column, target: Column) -> Column:
    """A box (minx, miny, maxx, maxy) in the target's coordinates: as it is, or by two of its corners; null where a system is not known."""
    sides = {k: box[k].cast("double") for k in SIDES}
    same = F.struct(*(v.alias(k) for k, v in sides.items()))
    a, b = (warp(sides[x], sides[y], crs, target) for x, y in (("minx", "miny"), ("maxx", "maxy")))
    turned = F.struct(F.least(a["x"], b["x"]).alias("minx"), F.least(a["y"], b["y"]).alias("miny"), F.greatest(a["x"], b["x"]).alias("maxx"), F.greatest(a["y"], b["y"]).alias("maxy"))
    return F.when(crs == target, same).when(a["x"].isNotNull() & b["x"].isNotNull(), turned)


def common_grid(pairs: DataFrame, target: str | None = None, resolution: float = RESOLUTION) -> DataFrame:
    """Of each pair's windows the common grid: crs, box, height, width, affine, ``fast`` (both already on it), ``usable`` and ``problem``.

    ``pairs`` has before and after, structs of crs, minx, miny, maxx, maxy, height, width.  The
    target is the one asked for, else that of before, of after, or degrees; a degree has 111 km,
    so that a pixel of a geographic grid has about the metres asked for.  Without overlap, or
    where a box cannot be brought to the target, the grid is empty, and ``problem`` says why.
    """
    b, a = F.col("before"), F.col("after")
    crs = F.coalesce(F.lit(target).cast("string"), F.nullif(b["crs"], F.lit("")), F.nullif(a["crs"], F.lit("")), F.lit(GEOGRAPHIC[0]))
    out = pairs.withColumn("crs", crs).withColumns({"_b": in_target(b["crs"], b, F.col("crs")), "_a": in_target(a["crs"], a, F.col("crs"))})
    x = lambda f, k: f(f"_b.{k}", f"_a.{k}")
    out = out.withColumns({"minx": x(F.greatest, "minx"), "miny": x(F.greatest, "miny"), "maxx": x(F.least, "maxx"), "maxy": x(F.least, "maxy")})
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    meets = F.coalesce(known & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")), F.lit(False))
    fast = meets & (b["crs"] == a["crs"]) & (b["crs"] == F.col("crs")) & (b["height"] == a["height"]) & (b["width"] == a["width"])
    for k in SIDES:
        fast = fast & (b[k] == a[k])
    step = F.when(F.col("crs").isin(*GEOGRAPHIC), F.lit(resolution / (1000 * KM_PER_DEGREE))).otherwise(F.lit(resolution))
    count = lambda lo, hi: F.greatest(F.lit(1), F.rint((F.col(hi) - F.col(lo)) / step)).cast("long")
    out = out.withColumns({"fast": fast, "_known": known, "_meets": meets}).withColumns(
        {
            "height": F.when(~F.col("_meets"), F.lit(0)).when(F.col("fast"), b["height"]).otherwise(count("miny", "maxy")).cast("long"),
            "width": F.when(~F.col("_meets"), F.lit(0)).when(F.col("fast"), b["width"]).otherwise(count("minx", "maxx")).cast("long"),
        }
    )
    affine = F.array((F.col("maxx") - F.col("minx")) / F.col("width"), F.lit(0.0), F.col("minx"), F.lit(0.0), -(F.col("maxy") - F.col("miny")) / F.col("height"), F.col("maxy"))
    out = out.withColumn("affine", F.when(F.col("width") > 0, affine)).withColumn("usable", (F.col("height") >= LEAST) & (F.col("width") >= LEAST))
    problem = F.when(~F.col("_known"), "unknown coordinate system").when(~F.col("_meets"), "no overlap").when(~F.col("usable"), "grid too small")
    boxed = {k: F.when(F.col("width") > 0, F.col(k)) for k in SIDES}
    return out.withColumns(boxed | {"problem": problem}).drop("_a", "_b", "_known", "_meets")


def positions(grids: DataFrame, side: str, key: str) -> DataFrame:
    """The cells (``r``, ``c``) of usable grids with the place of their centres in one window's pixels, ``y`` and ``x``: 0 is the middle of its first row or column."""
    cells = grids.where("usable").select(key, side, "crs", "affine", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"))
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at, w = F.col("affine"), F.col(side)
    there = warp(at[2] + (F.col("c") + 0.5) * at[0], at[5] + (F.col("r") + 0.5) * at[4], F.col("crs"), w["crs"])
    cells = cells.withColumn("_w", there)
    y = (w["maxy"] - F.col("_w.y")) / ((w["maxy"] - w["miny"]) / w["height"]) - 0.5
    x = (F.col("_w.x") - w["minx"]) / ((w["maxx"] - w["minx"]) / w["width"]) - 0.5
    return cells.select(key, "r", "c", y.alias("y"), x.alias("x"), w["height"].alias("_h"), w["width"].alias("_wd"))


def placed(grids: DataFrame, pixels: DataFrame, side: str, key: str, values: list[str]) -> DataFrame:
    """The grid's cells (r, c) with the nearest pixel's values of one window in the grid's own crs.

    Each cell's centre names the window's row and column, so pixels meet cells in an equi-join;
    a cell outside the window has none.
    """
    w = F.col(side)
    cells = grids.where("usable").select(key, side, "affine", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"))
    cells = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = F.col("affine")
    x, y = at[2] + (F.col("c") + 0.5) * at[0], at[5] + (F.col("r") + 0.5) * at[4]
    row = F.floor((w["maxy"] - y) / ((w["maxy"] - w["miny"]) / w["height"]))
    col = F.floor((x - w["minx"]) / ((w["maxx"] - w["minx"]) / w["width"]))
    cells = cells.select(key, "r", "c", row.alias("_r"), col.alias("_c"))
    return cells.join(pixels.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), *values), [key, "_r", "_c"], "left").drop("_r", "_c")


def resampled(grids: DataFrame, pixels: DataFrame, side: str, key: str, bilinear: list[str], nearest: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The grid's cells with one window's values, whatever the window's system: bands ``bilinear`` (as FLOAT), masks ``nearest``.

    The four pixels around a cell's centre give a weighted mean; those outside the window or
    null count with nothing, and a cell without any has null.  Cells go to the block of source
    pixels that holds the pixel above and to the left of them, and pixels to the blocks that
    need them, so a window of any size is spread over many tasks and nothing is multiplied by four.
    """
    nearest = nearest or []
    kinds = {f.name: f.dataType for f in pixels.schema.fields}
    cells = positions(grids, side, key)
    base = lambda v, n: F.greatest(F.lit(0), F.least(F.floor(v), F.col(n) - 1)).cast("long")
    near = (F.col("y") > -1) & (F.col("x") > -1) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_wd"))
    cells = cells.withColumns({"_i": F.floor(base("y", "_h") / block), "_j": F.floor(base("x", "_wd") / block), "_near": near}).drop("_h", "_wd")
    to_rows = F.array_distinct(F.array(F.floor(F.col("r") / block), F.floor((F.greatest(F.col("r"), F.lit(1)) - 1) / block)))
    to_cols = F.array_distinct(F.array(F.floor(F.col("c") / block), F.floor((F.greatest(F.col("c"), F.lit(1)) - 1) / block)))
    sent = pixels.select(F.col(key).alias(key), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *bilinear, *nearest).withColumn("_i", F.explode(to_rows)).withColumn("_j", F.explode(to_cols))
    fields = StructType([StructField(key, kinds[key]), StructField("r", LongType()), StructField("c", LongType()), *(StructField(b, FloatType()) for b in bilinear), *(StructField(b, kinds[b]) for b in nearest)])
    to = to_arrow_schema(fields)

    def one(cell: pa.Table, source: pa.Table) -> pa.Table:
        if not cell.num_rows:
            return to.empty_table()
        top, left = cell["_i"][0].as_py() * block, cell["_j"][0].as_py() * block
        y, x, on = cell["y"].to_numpy() - top, cell["x"].to_numpy() - left, cell["_near"].to_numpy().astype(bool)
        y, x = np.where(on, y, 0.0), np.where(on, x, 0.0)
        r, c = source["r"].to_numpy() - top, source["c"].to_numpy() - left
        place = np.full((block + 3, block + 3), -1, np.int64)  # one row and column of nothing on each side
        place[r + 1, c + 1] = np.arange(len(r))
        i, j = np.floor(y).astype(int), np.floor(x).astype(int)
        around = [(place[i + 1 + a, j + 1 + b], np.where(a, y - i, 1 - (y - i)) * np.where(b, x - j, 1 - (x - j))) for a in (0, 1) for b in (0, 1)]
        cols = {key: cell[key], "r": cell["r"], "c": cell["c"]}
        for band in bilinear:
            have = source[band].is_valid().to_numpy().astype(bool)
            value = source[band].cast(pa.float64()).fill_null(0.0).to_numpy()
            total, weight = np.zeros(len(y)), np.zeros(len(y))
            for at, w in around:
                w = np.where(on & (at >= 0) & have[at], w, 0.0) if len(have) else np.zeros(len(y))
                total += w * (value[at] if len(value) else 0.0)
                weight += w
            cols[band] = pa.array(np.divide(total, weight, out=np.zeros(len(y)), where=weight > 0), mask=weight <= 0)
        at = place[np.floor(y + 0.5).astype(int) + 1, np.floor(x + 0.5).astype(int) + 1]
        for band in nearest:
            cols[band] = source[band].combine_chunks().take(pa.array(at, mask=~(on & (at >= 0))))
        return pa.Table.from_arrays([cols[f.name].cast(f.type) for f in to], schema=to)

    return cells.groupBy(key, "_i", "_j").cogroup(sent.groupBy(key, "_i", "_j")).applyInArrow(one, fields)


def prepared(grids: DataFrame, before: DataFrame, after: DataFrame, key: str, bands: list[str], mask: str = "valid") -> DataFrame:
    """Both dates on the common grid: ``before_<band>``, ``after_<band>`` and ``valid``, where both masks are set; a cell outside a window is not valid."""
    def side(name: str, pixels: DataFrame) -> DataFrame:
        out = resampled(grids, pixels, name, key, bands, [mask])
        return out.select(key, "r", "c", *(F.col(b).alias(f"{name}_{b}") for b in bands), F.col(mask).alias(f"_{name}"))

    both = side("before", before).join(side("after", after), [key, "r", "c"])
    return both.withColumn("valid", F.coalesce("_before", F.lit(False)) & F.coalesce("_after", F.lit(False))).drop("_before", "_after")
