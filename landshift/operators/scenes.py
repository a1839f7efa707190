"""Catalog scenes: search, period, ranking, common tile, footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.functions.geometry import bbox, intersects, is_box
from landshift.operators.requests import once, salted


def mgrs_tile(scene_id: Column) -> Column:
    """The second part of the id if it has five characters."""
    part = F.get(F.split(scene_id, "_"), F.lit(1))
    return F.when(F.length(part) == 5, part)


def period(ts: Column, before: tuple[str, str], after: tuple[str, str]) -> Column:
    """By date, both ends inclusive; before wins."""
    day = F.to_date(ts)
    inside = lambda w: day.between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))
    return F.when(inside(before), "before").when(inside(after), "after").otherwise("unknown")


def search(scenes: DataFrame, before: tuple[str, str], after: tuple[str, str], limit: int = 50) -> DataFrame:
    """At most ``limit`` scenes of each window, newest first, both windows' rows together (no dedupe)."""
    out = None
    for name, w in (("before", before), ("after", after)):
        day = F.to_date("ts")
        hits = scenes.where(day.between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date"))).orderBy(F.desc("ts"), "scene_id").limit(limit).withColumn("window", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return out


def clear_or_all(scenes: DataFrame, by: list[str], max_cloud: float) -> DataFrame:
    """Scenes within the cloud limit; all of a group that has none."""
    clear = F.col("cloud") <= max_cloud
    return scenes.withColumn("_clear", F.count_if(clear).over(Window.partitionBy(*by))).where(clear | (F.col("_clear") == 0)).drop("_clear")


def ranked(scenes: DataFrame, by: list[str], keep: int = 3) -> DataFrame:
    """The ``keep`` least cloudy scenes of each group; ties newest first."""
    w = Window.partitionBy(*by).orderBy("cloud", F.desc("ts"), "scene_id")
    return scenes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def common_tiles(scenes: DataFrame) -> DataFrame:
    """Tiles of both periods with the sum of their least clouds, best first by ``tile_rank``."""
    least = scenes.where("tile IS NOT NULL").groupBy("tile").agg(F.min(F.when(F.col("period") == "before", F.col("cloud"))).alias("b"), F.min(F.when(F.col("period") == "after", F.col("cloud"))).alias("a"))
    both = least.where("a IS NOT NULL AND b IS NOT NULL").select("tile", (F.col("a") + F.col("b")).alias("cloud_sum"))
    return both.withColumn("tile_rank", F.row_number().over(Window.orderBy("cloud_sum", "tile")))  # one row a tile of the catalog's grid


def plain(ring: Column, box: Column) -> Column:
    """Whether a ring is its box: five finite corners along the box's sides."""
    finite = (box["minx"] > float("-inf")) & (box["miny"] > float("-inf")) & (box["maxx"] < float("inf")) & (box["maxy"] < float("inf"))
    return F.coalesce(is_box(F.array(F.array(ring))) & finite & F.forall(ring, lambda p: F.size(p) == 2), F.lit(False))


def over_areas(scenes: DataFrame, areas: DataFrame, cell: float = 1.0, crowd: int = 2000) -> DataFrame:
    """Scenes and areas whose rings intersect: an equi-join on grid cells of the boxes, then boxes, then the exact test where a ring is not its own box.

    A pair is kept in the first cell that both boxes share, so no pair comes twice and no distinct
    is needed.  A cell with more than ``crowd`` scenes is dealt to several salts.  Pairs may be far
    more than rows, so cells are dealt to all partitions, however small they are.
    """
    parts = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["_x", "_y"]

    def celled(df: DataFrame, ring: str, p: str) -> DataFrame:
        df = once(df, p, bbox(F.col(ring))).where(F.col(p)["minx"].isNotNull())
        xs = F.sequence(F.floor(F.col(p)["minx"] / cell), F.floor(F.col(p)["maxx"] / cell))
        ys = F.sequence(F.floor(F.col(p)["miny"] / cell), F.floor(F.col(p)["maxy"] / cell))
        df = once(df, f"{p}p", plain(F.col(ring), F.col(p)))
        return df.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))

    def met(s: DataFrame, a: DataFrame, *more: str) -> DataFrame:
        first = (F.col("_x") == F.floor(F.greatest("_s.minx", "_a.minx") / cell)) & (F.col("_y") == F.floor(F.greatest("_s.miny", "_a.miny") / cell))
        boxes = (F.col("_s.minx") <= F.col("_a.maxx")) & (F.col("_a.minx") <= F.col("_s.maxx")) & (F.col("_s.miny") <= F.col("_a.maxy")) & (F.col("_a.miny") <= F.col("_s.maxy"))
        # Cells look as few as the rings that they are made from: without the hint Spark may broadcast them.
        return s.join(a.hint("merge"), [*at, *more]).where(first & boxes).drop(*at, *more, "_s", "_a", "_sp", "_ap")

    s, a = celled(scenes, "footprint", "_s"), celled(areas, "ring", "_a")
    dealt = (x.repartition(parts, *at, "_salt") for x in salted(s.where("_sp"), a.where("_ap"), at, crowd, *scenes.columns))
    exact = met(s.where("NOT _sp"), a).unionByName(met(s.where("_sp"), a.where("NOT _ap"))).where(intersects("footprint", "ring"))
    return met(*dealt, "_salt").unionByName(exact)


def needs_composite(valid_fraction: Column, n_scenes: Column, force: bool = False) -> Column:
    return (F.lit(force) | (valid_fraction < 0.7)) & (n_scenes > 1)
