"""Scenes that events stand for (ts the acquisition, value % 100 the cloud), and polygons that customers stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.functions import geometry, indices
from landshift.operators import scenes
from landshift.plans.registry import query, table

BEFORE, AFTER = ("2024-01-01", "2024-01-10"), ("2024-01-20", "2024-01-30")
SC = """WITH sc AS (SELECT event_id, ts, 'S2A_' || CASE WHEN user_id % 13 = 0 THEN '10' ELSE '10T' || CAST(user_id % 9 AS VARCHAR) || CAST(user_id % 7 AS VARCHAR) END || '_' || CAST(event_id AS VARCHAR) AS scene_id,
  round(value, 2) % 100 AS cloud, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN 'before' WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-30' THEN 'after' ELSE 'unknown' END AS period FROM events),
st AS (SELECT *, CASE WHEN length(split_part(scene_id, '_', 2)) = 5 THEN split_part(scene_id, '_', 2) END AS tile FROM sc)
"""
POLY = """WITH po AS (SELECT c_custkey AS id, (c_custkey * 37) % 40 - 20 + (c_custkey % 10) / 16.0e0 AS lon, (c_custkey * 53) % 30 - 15 + (c_custkey % 7) / 16.0e0 AS lat, 1 + c_custkey % 12 AS km FROM customer)
"""


def catalog(spark, sf_dir) -> DataFrame:
    user, part = F.col("user_id"), F.col("event_id").cast("string")
    tile = F.when(user % 13 == 0, "10").otherwise(F.concat(F.lit("10T"), (user % 9).cast("string"), (user % 7).cast("string")))
    sc = table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("_", F.lit("S2A"), tile, part).alias("scene_id"), (F.round("value", 2) % 100).alias("cloud"))
    return sc.withColumns({"period": scenes.period(F.col("ts"), BEFORE, AFTER), "tile": scenes.mgrs_tile(F.col("scene_id"))})


def polygons(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 40 - 20 + k % 10 / 16.0).alias("lon"), (k * 53 % 30 - 15 + k % 7 / 16.0).alias("lat"), (k % 12 + 1).alias("km"))


def boxes(spark, sf_dir) -> DataFrame:
    return polygons(spark, sf_dir).select("id", geometry.square(F.col("lat"), F.col("lon"), F.col("km").cast("double")).alias("ring"))


@query(
    SC
    + """SELECT * FROM (SELECT event_id, period AS "window", round(cloud, 4) AS cloud FROM st WHERE period = 'before' ORDER BY ts DESC, scene_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT event_id, period AS "window", round(cloud, 4) AS cloud FROM st WHERE period = 'after' ORDER BY ts DESC, scene_id LIMIT 50)"""
)
def scene_search(spark, sf_dir):
    return scenes.search(catalog(spark, sf_dir), BEFORE, AFTER, 50).select("event_id", "window", F.round("cloud", 4).alias("cloud"))


@query(
    SC
    + """, f AS (SELECT *, count_if(cloud <= 15) OVER (PARTITION BY tile, period) AS clear FROM st WHERE period <> 'unknown' AND tile IS NOT NULL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile, period ORDER BY cloud, ts DESC, scene_id) AS INTEGER) AS rank FROM f WHERE cloud <= 15 OR clear = 0)
SELECT tile, period, rank, event_id, round((100 - cloud) / 100, 6) AS local_valid_fraction FROM k WHERE rank <= 3"""
)
def scene_rank(spark, sf_dir):
    sc = catalog(spark, sf_dir).where("period <> 'unknown' AND tile IS NOT NULL")
    out = scenes.ranked(scenes.clear_or_all(sc, ["tile", "period"], 15.0), ["tile", "period"])
    return out.select("tile", "period", "rank", "event_id", F.round(indices.valid_proxy(F.col("cloud")), 6).alias("local_valid_fraction"))


@query(
    SC
    + """, t AS (SELECT tile, min(CASE WHEN period = 'before' THEN cloud END) + min(CASE WHEN period = 'after' THEN cloud END) AS cloud_sum FROM st WHERE tile IS NOT NULL GROUP BY tile)
SELECT tile, round(cloud_sum, 6) AS cloud_sum, CAST(row_number() OVER (ORDER BY cloud_sum, tile) AS INTEGER) AS tile_rank FROM t WHERE cloud_sum IS NOT NULL"""
)
def common_tile(spark, sf_dir):
    return scenes.common_tiles(catalog(spark, sf_dir)).select("tile", F.round("cloud_sum", 6).alias("cloud_sum"), "tile_rank")


@query(SC + "SELECT event_id, tile, period FROM st")
def mgrs_tile(spark, sf_dir):
    return catalog(spark, sf_dir).select("event_id", "tile", "period")


@query(
    SC
    + """, r AS (SELECT tile, period, count(*) AS n, max((100 - cloud) / 100) AS best FROM st WHERE period <> 'unknown' AND tile IS NOT NULL GROUP BY tile, period)
SELECT tile, period, n, best < 0.7 AND n > 1 AS composite FROM r"""
)
def composite_decision(spark, sf_dir):
    sc = catalog(spark, sf_dir).where("period <> 'unknown' AND tile IS NOT NULL")
    per = sc.groupBy("tile", "period").agg(F.count("*").alias("n"), F.max(indices.valid_proxy(F.col("cloud"))).alias("best"))
    return per.select("tile", "period", "n", scenes.needs_composite(F.col("best"), F.col("n")).alias("composite"))


@query("SELECT o_orderkey, abs(month(o_orderdate + INTERVAL 120 DAY) - month(o_orderdate)) >= 4 AS cross_season FROM orders")
def cross_season(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", indices.cross_season(day, F.date_add(day, 120)).alias("cross_season"))


@query(
    POLY
    + """, b AS (SELECT id, round(lon - km / (cos(radians(lat)) * 111.0e0), 6) AS w, round(lon + km / (cos(radians(lat)) * 111.0e0), 6) AS e, round(lat - km / 111.0e0, 6) AS s, round(lat + km / 111.0e0, 6) AS n FROM po)
SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND p.w <= q.e AND q.w <= p.e AND p.s <= q.n AND q.s <= p.n"""
)
def scene_intersects(spark, sf_dir):
    rings = boxes(spark, sf_dir)
    a = rings.select(F.col("id").alias("a"), F.col("ring").alias("footprint"))
    b = rings.select(F.col("id").alias("b"), "ring")
    return scenes.over_areas(a, b).where("a < b").select("a", "b")


@query(POLY + "SELECT id, round(lon - km / (cos(radians(lat)) * 111.0e0), 6) AS minx, round(lat - km / 111.0e0, 6) AS miny, round(lon + km / (cos(radians(lat)) * 111.0e0), 6) AS maxx, round(lat + km / 111.0e0, 6) AS maxy FROM po")
def polygon_bbox(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", geometry.bbox(F.col("ring")).alias("b")).select("id", "b.*")


@query(
    POLY
    + """, b AS (SELECT id, round(lon - km / (cos(radians(lat)) * 111.0e0), 6) AS w, round(lon + km / (cos(radians(lat)) * 111.0e0), 6) AS e, round(lat - km / 111.0e0, 6) AS s, round(lat + km / 111.0e0, 6) AS n FROM po)
SELECT id, round((e - w) * (n - s) * 111.0e0 * 111.0e0 * 100.0e0, 3) AS area_ha, (e - w) * (n - s) * 111.0e0 * 111.0e0 * 100.0e0 <= 50000 AS allowed FROM b"""
)
def aoi_area(spark, sf_dir):
    area = geometry.area_ha(F.col("ring"))
    return boxes(spark, sf_dir).select("id", F.round(area, 3).alias("area_ha"), (area <= geometry.MAX_AREA_HA).alias("allowed"))


@query(POLY + "SELECT id, CAST(5 AS INTEGER) AS corners, round(lon - km / (cos(radians(lat)) * 111.0e0), 6) AS first_x, round(lat - km / 111.0e0, 6) AS first_y FROM po")
def aoi_box(spark, sf_dir):
    ring = F.col("ring")
    return boxes(spark, sf_dir).select("id", F.size(ring).alias("corners"), ring[0][0].alias("first_x"), ring[0][1].alias("first_y"))


@query(
    POLY
    + """, b AS (SELECT id, round(lon * 9.4e0 - km / (cos(radians(lat)) * 111.0e0), 6) AS w, round(lon * 9.4e0 + km / (cos(radians(lat)) * 111.0e0), 6) AS e, round(lat * 6.2e0 - km / 111.0e0, 6) AS s, round(lat * 6.2e0 + km / 111.0e0, 6) AS n FROM po)
SELECT id, w >= -180 AND e <= 180 AND s >= -90 AND n <= 90 AS valid FROM b"""
)
def validate_geometry(spark, sf_dir):
    po = polygons(spark, sf_dir)
    dx = F.col("km") / (F.cos(F.radians("lat")) * 111.0)
    lon, lat, dy = F.col("lon") * 9.4, F.col("lat") * 6.2, F.col("km") / 111.0
    w, e, s, n = (F.round(x, 6) for x in (lon - dx, lon + dx, lat - dy, lat + dy))
    ring = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    return po.select("id", geometry.coordinates_valid(ring).alias("valid"))


@query(POLY + "SELECT id, id % 3 <> 0 AS simple FROM po")
def polygon_simple(spark, sf_dir):
    """Every third ring has two corners changed over, so it meets itself."""
    r = F.col("ring")
    twisted = F.when(F.col("id") % 3 == 0, F.array(r[0], r[2], r[1], r[3], r[0])).otherwise(r)
    return boxes(spark, sf_dir).select("id", geometry.is_simple(twisted).alias("simple"))


@query("SELECT o_orderkey, CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS window_start FROM orders")
def default_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), -1).alias("window_start"))


@query("SELECT o_orderkey, greatest(1, CAST(trunc((o_orderkey % 500) / 100e0 / 0.01e0) AS INTEGER)) AS min_pixels FROM orders")
def min_pixels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", indices.min_pixels(F.col("o_orderkey") % 500 / 100.0).alias("min_pixels"))
