"""Regions of a change mask: closing, connected components, statistics, ranking, hulls, seasonal test."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from landshift.functions import indices
from landshift.operators.pixels import usability, validity
from landshift.operators.storage import stored

#: Rows and columns of a block that one task closes or labels.
BLOCK = 512


def filled(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every place of each grid's box; the other columns are null where a pixel is missing."""
    box = pixels.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = box.withColumn("r", F.explode(F.sequence("r0", "r1")))
    return rows.select(*keys, "r", F.explode(F.sequence("c0", "c1")).alias("c")).join(pixels, [*keys, "r", "c"], "left")


def closing(pixels: DataFrame, keys: list[str], mask: str, size: int = 25, dense: bool = True) -> DataFrame:
    """Binary closing with a square of ``size``; ``mask`` is replaced.

    Dilation and erosion are each two one-dimensional windows.  Outside counts as unset, so
    the erosion clears the border.  A grid that may lack pixels is filled first (``dense``
    False); its missing pixels come back as rows.  One exchange on the grid's keys serves all
    four windows.
    """
    if not dense:
        pixels = filled(pixels, keys)
    half = size // 2
    across = Window.partitionBy(*keys, "r").orderBy("c").rowsBetween(-half, half)
    down = Window.partitionBy(*keys, "c").orderBy("r").rowsBetween(-half, half)

    def eroded(at: Column, w) -> Column:
        return F.when(F.count("*").over(w) == size, F.min(at).over(w)).otherwise(0)

    out = pixels.repartition(*keys).withColumn("_m", F.coalesce(F.col(mask).cast("int"), F.lit(0)))
    for step in (lambda: F.max("_m").over(across), lambda: F.max("_m").over(down), lambda: eroded(F.col("_m"), across), lambda: eroded(F.col("_m"), down)):
        out = out.withColumn("_m", step())
    return out.withColumn(mask, F.col("_m") == 1).drop("_m")


def around(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Set pixels among the ``size`` around each along an axis, by running sums; outside counts as unset."""
    half = size // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half + 1, half)
    run = np.cumsum(np.pad(mask, pad), axis=axis, dtype=np.int32)
    n = run.shape[axis]
    return np.take(run, range(size, n), axis) - np.take(run, range(n - size), axis)


def in_block(block: int) -> list[Column]:
    return [F.floor(F.col("r") / block).cast("long").alias("_i"), F.floor(F.col("c") / block).cast("long").alias("_j")]


def closing_by_blocks(pixels: DataFrame, keys: list[str], mask: str, size: int = 25, block: int = BLOCK, dense: bool = True) -> DataFrame:
    """The same closing for grids of any size: no task holds more than a block and what lies around it.

    A set pixel is also sent to the blocks that it can reach: what a pixel becomes depends on
    those within twice half the square.  The grid's box, a row a block, comes by the same
    exchange, so a grid of many blocks is spread over many tasks.
    """
    if not dense:
        pixels = filled(pixels, keys)
    reach = 2 * (size // 2)
    fields = StructType([f if f.name != mask else StructField(mask, BooleanType()) for f in pixels.schema])
    to = to_arrow_schema(fields)
    span = lambda x: F.sequence(F.floor((F.col(x) - reach) / block), F.floor((F.col(x) + reach) / block))
    place = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    met = F.flatten(F.transform(span("r"), lambda i: F.transform(span("c"), lambda j: place(i, j))))
    own = F.array(place(F.floor(F.col("r") / block), F.floor(F.col("c") / block)))
    sent = pixels.withColumn("_at", F.explode(F.when(F.coalesce(F.col(mask), F.lit(False)), met).otherwise(own))).withColumns({"_i": F.col("_at.i"), "_j": F.col("_at.j")}).drop("_at")
    box = pixels.groupBy(*keys).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    edge = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / block).cast("long"), F.floor(F.col(b) / block).cast("long")))
    boxes = box.withColumn("_i", edge("r0", "r1")).withColumn("_j", edge("c0", "c1"))
    boxes = boxes.select(*(F.col(x).alias(x) for x in boxes.columns))  # columns of its own, whatever the pixels come from

    def one(rows: pa.Table, about: pa.Table) -> pa.Table:
        if not about.num_rows:
            return to.empty_table()  # beyond the grid
        a = {k: about[k][0].as_py() for k in ("_i", "_j", "r0", "r1", "c0", "c1")}
        top, left = a["_i"] * block - reach, a["_j"] * block - reach
        r, c = rows["r"].to_numpy() - top, rows["c"].to_numpy() - left
        on = rows[mask].fill_null(False).to_numpy().astype(bool)
        wide = block + 2 * reach
        grid = np.zeros((wide, wide), bool)
        grid[r[on], c[on]] = True
        for axis in (1, 0):
            grid = around(grid, size, axis) > 0
        grid[: max(a["r0"] - top, 0)] = grid[max(a["r1"] + 1 - top, 0) :] = False
        grid[:, : max(a["c0"] - left, 0)] = grid[:, max(a["c1"] + 1 - left, 0) :] = False
        for axis in (1, 0):
            grid = around(grid, size, axis) == size
        mine = (r >= reach) & (r < reach + block) & (c >= reach) & (c < reach + block)
        kept, value = rows.filter(pa.array(mine)), pa.array(grid[r[mine], c[mine]])
        return pa.Table.from_arrays([value if f.name == mask else kept[f.name].cast(f.type) for f in to], schema=to)

    at = [*keys, "_i", "_j"]
    return sent.groupBy(*at).cogroup(boxes.groupBy(*at)).applyInArrow(one, fields)


def labels_of(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """4-connected components of set pixels by union-find over runs; a component's label is its first pixel's place in scan order."""
    order = np.lexsort((cols, rows))
    r, c = rows[order], cols[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1
    row, begin, end = r[first], c[first], c[last]
    parent = list(range(len(first)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = np.searchsorted(row, row - 1)
    stops = np.searchsorted(row, row)
    for k in range(len(first)):
        i = starts[k] + np.searchsorted(end[starts[k] : stops[k]], begin[k])
        while i < stops[k] and begin[i] <= end[k]:
            a, b = root(i), root(k)
            parent[max(a, b)] = min(a, b)
            i += 1
    roots = np.array([root(k) for k in range(len(first))], int)
    out = np.empty(len(r), np.int64)
    out[order] = np.repeat(first[roots] if len(first) else first, last - first + 1)
    return out


def components(pixels: DataFrame, keys: list[str], mask: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Set pixels with ``label``: r * 2^32 + c of the component's first pixel in scan order.  A grid (an AOI of bounded area) is one group.

    The columns of ``carry`` come along, so that statistics of the regions need no join back to the pixels.
    """
    kept, more = (", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in names) for names in (keys, carry))
    fields = f"{kept}, r long, c long, {more + ', ' if more else ''}label long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        order = np.lexsort((c, r))
        at = order[labels_of(r, c)] if len(r) else order
        return pdf[[*keys, "r", "c", *carry]].assign(label=r[at] * (1 << 32) + c[at])

    return pixels.where(mask).select(*keys, "r", "c", *carry).groupBy(*keys).applyInPandas(one, fields)


def components_by_runs(pixels: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """The same labels without gathering a grid: runs of a row (gaps and islands), joined to overlapping runs of the next row.

    For grids beyond one task's memory.  Labels merge until none touches a smaller one; each
    round is a checkpoint in the cluster's shared folder.
    """
    w = Window.partitionBy(*keys, "r").orderBy("c")
    on = pixels.where(mask).select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    on = on.withColumn("_island", F.col("c") - F.row_number().over(w))
    runs = on.groupBy(*keys, "r", "_island").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    runs = runs.withColumn("label", F.col("r") * (1 << 32) + F.col("a")).withColumn("run", F.col("label"))
    below = runs.select(*keys, (F.col("r") - 1).alias("r"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("run").alias("run2"))
    touch = runs.join(below, [*keys, "r"]).where("a <= b2 AND a2 <= b").select(*keys, F.col("run").alias("u"), F.col("run2").alias("v"))
    edges = touch.union(touch.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    now = least_labels(runs.select(*keys, "run", "label").checkpoint(), edges, keys)
    placed = on.join(runs.select(*keys, "r", "_island", "run"), [*keys, "r", "_island"]).join(now, [*keys, "run"])
    return placed.select(*keys, "r", "c", "label")


def least_labels(now: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``run`` and ``label``, the least run that it is joined to by ``edges`` (u, v, both ways).  Both tables are stored ones."""
    while True:
        # A label's runs take together the least label that any of them touches; so labels at least halve where they meet.
        ends = edges.join(now.select(*keys, F.col("run").alias("v"), F.col("label").alias("there")), [*keys, "v"]).join(now.select(*keys, F.col("run").alias("u"), "label"), [*keys, "u"])
        better = stored(ends.where("there < label").groupBy(*keys, "label").agg(F.min("there").alias("least")))
        if better.isEmpty():
            return now
        new = now.join(better, [*keys, "label"], "left").select(*keys, "run", F.coalesce("least", "label").alias("label"))
        # A label names a run, whose own label is a step further.
        jump = new.select(*keys, F.col("run").alias("label"), F.col("label").alias("further"))
        now = stored(new.join(jump, [*keys, "label"]).select(*keys, "run", F.col("further").alias("label")))


def components_by_blocks(pixels: DataFrame, keys: list[str], mask: str, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The same labels for grids of any size: each block labels its own pixels, and only pixels along the blocks' borders are joined.

    Labels of a block that touch another's are merged until none touches a smaller one; all
    others are final at once.
    """
    on = pixels.where(mask).select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *carry, *in_block(block))
    fields = StructType([*(f for f in on.schema if f.name not in ("_i", "_j")), StructField("label", LongType())])
    to = to_arrow_schema(fields)

    def one(rows: pa.Table) -> pa.Table:
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        order = np.lexsort((c, r))
        first = order[labels_of(r, c)]
        return pa.Table.from_arrays([pa.array(r[first] * (1 << 32) + c[first]) if f.name == "label" else rows[f.name].cast(f.type) for f in to], schema=to)

    labelled = stored(on.groupBy(*keys, "_i", "_j").applyInArrow(one, fields))
    across = None
    for axis in ("r", "c"):
        last = labelled.where(F.col(axis) % block == block - 1).select(*keys, *(F.col(x) + 1 if x == axis else x for x in ("r", "c")), F.col("label").alias("u")).toDF(*keys, "r", "c", "u")
        first = labelled.where(F.col(axis) % block == 0).select(*keys, "r", "c", F.col("label").alias("v"))
        met = last.join(first, [*keys, "r", "c"]).select(*keys, "u", "v")
        across = met if across is None else across.union(met)
    across = across.distinct()
    edges = stored(across.union(across.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))))
    names = stored(edges.select(*keys, F.col("u").alias("run"), F.col("u").alias("label")).distinct())
    final = least_labels(names, edges, keys).select(*keys, F.col("run").alias("label"), F.col("label").alias("_least"))
    return labelled.join(final, [*keys, "label"], "left").withColumn("label", F.coalesce("_least", "label")).select(*keys, "r", "c", *carry, "label")


def findings(labelled: DataFrame, pixels: DataFrame | None, keys: list[str], min_pixels: int = 50, use_pixel_delta: bool = False) -> DataFrame:
    """Per component: pixel count (masked ones too), area, mean index difference (masked ones out), score; small ones and those without a score go.

    ``pixels`` is None where the labelled ones carry ``ndvi_diff`` (and ``pixel_delta``).
    ``ends`` has the first and last pixel of each of a component's rows, which its hull is made of.
    """
    if pixels is not None:
        labelled = labelled.join(pixels, [*keys, "r", "c"])
    measured = ["ndvi_diff", "pixel_delta"] if use_pixel_delta else ["ndvi_diff"]
    sums = [f(c).alias(f"_{f.__name__}_{c}") for c in measured for f in (F.sum, F.count)]
    by_row = labelled.groupBy(*keys, "label", "r").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("_n"), *sums)
    mean = lambda c: F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}"))
    delta = mean("pixel_delta") if use_pixel_delta else F.lit(0.0)
    out = by_row.groupBy(*keys, "label").agg(
        F.sum("_n").alias("valid_pixels"), mean("ndvi_diff").alias("ndvi_delta_mean"), F.coalesce(delta, F.lit(0.0)).alias("pixel_delta_mean"), F.collect_list(F.struct("a", "b", "r")).alias("ends")
    )
    out = out.where(F.col("valid_pixels") >= min_pixels).withColumn("area_ha", F.col("valid_pixels") * indices.PIXEL_HA)
    return out.withColumn("ndvi_delta_mean", F.coalesce("ndvi_delta_mean", F.lit(0.0))).withColumn("score", indices.score(F.col("ndvi_delta_mean"), F.col("pixel_delta_mean"))).where("score > 0")


def top(found: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The ``limit`` best of each grid by score, ties in scan order, with their 1-based ``finding_id``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "label")
    return found.withColumn("finding_id", F.row_number().over(w)).where(F.col("finding_id") <= limit)


def hull(points: np.ndarray) -> list[list[float]]:
    """Closed ring of the convex hull of (x, y) points; of collinear ones, the ring of their bounding box."""
    p = sorted(map(tuple, np.unique(points, axis=0).tolist()))

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = half(p), half(p[::-1])
    ring = lower[:-1] + upper[:-1]
    if len(ring) < 3:
        (x0, y0), (x1, y1) = np.min(p, axis=0).tolist(), np.max(p, axis=0).tolist()
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [[float(x), float(y)] for x, y in [*ring, ring[0]]]


def hulls(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Ring of each component's convex hull over (c, r).  Only the ends of each row can be corners, so only they are gathered."""
    ends = labelled.groupBy(*keys, "label", "r").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    fields = ", ".join(f"{k} {labelled.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate([pdf[["a", "r"]].to_numpy(float), pdf[["b", "r"]].to_numpy(float)])
        return pdf[[*keys, "label"]].head(1).assign(ring=[hull(points)])

    return ends.groupBy(*keys, "label").applyInPandas(one, f"{fields}, label long, ring array<array<double>>")


def outlined(found: DataFrame) -> DataFrame:
    """Findings with the ``ring`` of their hull instead of their ``ends``, as ``hulls`` gives it."""

    @F.pandas_udf("array<array<double>>")
    def ring(ends: pd.Series) -> pd.Series:
        return ends.map(lambda rows: hull(np.array([p for x in rows for p in ((x["a"], x["r"]), (x["b"], x["r"]))], float)))

    return found.withColumn("ring", ring("ends")).drop("ends")


def seasonal(pixels: DataFrame, keys: list[str], mask: str = "changed", valid: str = "valid") -> DataFrame:
    """Spatial variance of the changed pixels' difference: NULLs below 50 of them; abstain if uniform over more than half of the valid ones."""
    return uniformity(pixels.groupBy(*keys).agg(*spread(mask, valid)))


def assessed(pixels: DataFrame, keys: list[str], mask: str = "changed", valid: str = "valid", raw: str | None = None) -> DataFrame:
    """What ``pair_summary`` and ``seasonal`` say, from one aggregate of the pixels; ``any_changed`` by the mask before its closing (``raw``)."""
    changed = F.bool_or(F.coalesce(F.col(raw or mask), F.lit(False))).alias("any_changed")
    return usability(uniformity(pixels.groupBy(*keys).agg(*validity(valid), *spread(mask, valid), changed)))


def spread(mask: str, valid: str) -> list[Column]:
    """The aggregates of a grid that ``uniformity`` judges."""
    on = F.col(mask) & F.col(valid)
    d = F.when(on, F.col("ndvi_diff").cast("double"))
    return [F.count_if(on).alias("n_changed"), F.count_if(F.col(valid)).alias("n_valid"), F.avg(d).alias("_mean"), F.stddev_pop(d).alias("_std")]


def uniformity(out: DataFrame) -> DataFrame:
    enough = F.col("n_changed") >= 50
    cv = F.when(F.abs("_mean") <= 1e-6, F.lit(0.0)).otherwise(F.try_divide("_std", F.abs("_mean")))
    out = out.withColumns({"cv": F.when(enough, cv), "coverage": F.when(enough, F.try_divide("n_changed", "n_valid"))})
    out = out.withColumn("is_uniform", F.col("cv") < 0.3)
    return out.withColumn("should_abstain", F.col("is_uniform") & (F.col("coverage") > 0.5)).drop("_mean", "_std")


def outcomes(grids: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row a grid that was ``assessed``: the first reason to abstain along the stages, or the findings' number."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n_findings"))
    counted = F.when(F.col("status") == "abstained", F.lit(0)).otherwise(F.coalesce("n_findings", F.lit(0)))
    return verdicts(grids).join(n, keys, "left").withColumn("n_findings", counted)


def granted(found: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """The findings of the grids that don't abstain: an abstained run has none."""
    return found.join(told.where("status <> 'abstained'").select(*keys), keys, "left_semi")


def verdicts(grids: DataFrame) -> DataFrame:
    """``status`` and ``reason`` of each grid that was ``assessed``.

    Whether anything changed is asked before the closing: a change that the closing clears, as
    at the border, is no reason to abstain, though nothing may be found.
    """
    reason = (
        F.when(~F.col("usable"), "insufficient valid pixels")
        .when(~F.col("any_changed"), "no significant change detected")
        .when(F.coalesce("should_abstain", F.lit(False)), "seasonal pattern")
    )
    return grids.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "review_recommended").otherwise("abstained"))
