"""Queries over a raster that orders stand for: tiles of 50 x 50 pixels by o_orderkey, with a speckled clearing in each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions import geometry, indices
from landshift.operators import chips, pixels, regions
from landshift.plans.registry import query, table

PX = """
WITH p0 AS (SELECT o_orderkey // 2500 AS tile, (o_orderkey % 2500) // 50 AS r, o_orderkey % 50 AS c, o_custkey AS u,
  ((o_orderkey % 2500) // 50 BETWEEN 14 AND 24 AND o_orderkey % 50 BETWEEN 14 AND 33 AND o_custkey % 4 <> 0) AS loss FROM orders),
px AS (SELECT tile, r, c, u, 3000 + u % 400 AS b08b, 400 + (u * 7) % 120 AS b04b, 900 + (u * 5) % 150 AS b11b, 600 + (u * 11) % 130 AS b12b,
  CASE WHEN loss THEN 1500 + u % 300 ELSE 3000 + u % 400 END AS b08a, CASE WHEN loss THEN 900 + (u * 3) % 200 ELSE 400 + (u * 7) % 120 END AS b04a,
  CASE WHEN loss THEN 1500 + (u * 3) % 150 ELSE 900 + (u * 5) % 150 END AS b11a, CASE WHEN loss THEN 1200 + (u * 9) % 130 ELSE 600 + (u * 11) % 130 END AS b12a,
  CASE WHEN u % 23 = 0 THEN 9 ELSE 4 END AS sclb, CASE WHEN u % 29 = 0 THEN 8 WHEN u % 31 = 0 THEN 0 ELSE 5 END AS scla FROM p0),
nd AS (SELECT *, (sclb NOT IN (0,1,3,7,8,9,10,11) AND scla NOT IN (0,1,3,7,8,9,10,11)) AS valid,
  CAST((b08b - b04b) / CAST(b08b + b04b AS DOUBLE) AS FLOAT) AS ndvi_b, CAST((b08a - b04a) / CAST(b08a + b04a AS DOUBLE) AS FLOAT) AS ndvi_a,
  CAST((b08b - b12b) / CAST(b08b + b12b AS DOUBLE) AS FLOAT) AS nbr_b, CAST((b08a - b12a) / CAST(b08a + b12a AS DOUBLE) AS FLOAT) AS nbr_a,
  CAST((b08b - b11b) / CAST(b08b + b11b AS DOUBLE) AS FLOAT) AS ndmi_b, CAST((b08a - b11a) / CAST(b08a + b11a AS DOUBLE) AS FLOAT) AS ndmi_a FROM px),
base AS (SELECT *, CASE WHEN valid THEN CAST(ndvi_a - ndvi_b AS FLOAT) END AS ndvi_diff,
  CASE WHEN valid THEN CAST(sqrt(CAST((b04a - b04b) * (b04a - b04b) + (b08a - b08b) * (b08a - b08b) AS DOUBLE)) AS FLOAT) END AS pixel_delta FROM nd)
"""
#: The raster's clearing and clouds, and what they are where tiles take turns: a change of the whole view, one at the border only, clouds, no change.
LOSS_SQL, CLOUD_SQL = "((o_orderkey % 2500) // 50 BETWEEN 14 AND 24 AND o_orderkey % 50 BETWEEN 14 AND 33 AND o_custkey % 4 <> 0) AS loss", "CASE WHEN u % 23 = 0 THEN 9 ELSE 4 END AS sclb"
LOSS_CASES = "CASE (o_orderkey // 2500) % 6 WHEN 1 THEN true WHEN 2 THEN (o_orderkey % 2500) // 50 < 4 WHEN 4 THEN false ELSE " + LOSS_SQL.removesuffix(" AS loss") + " END AS loss"
CLOUD_CASES = "CASE WHEN tile % 6 = 1 AND NOT (r BETWEEN 10 AND 39 AND c BETWEEN 10 AND 39) THEN 9 WHEN tile % 6 = 3 AND u % 5 <> 0 THEN 9 WHEN u % 23 = 0 THEN 9 ELSE 4 END AS sclb"


def cased(sql: str) -> str:
    """SQL over the raster where tiles take turns."""
    return sql.replace(LOSS_SQL, LOSS_CASES).replace(CLOUD_SQL, CLOUD_CASES)


MASK = PX + """, m0 AS (SELECT tile, r, c, valid, ndvi_diff, pixel_delta, CASE WHEN coalesce(ndvi_diff, 0) < CAST(-0.15 AS FLOAT) THEN 1 ELSE 0 END AS m FROM base)"""
CLOSED = MASK + """, m1 AS (SELECT *, max(m) OVER (PARTITION BY tile, r ORDER BY c ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS d1 FROM m0),
m2 AS (SELECT *, max(d1) OVER (PARTITION BY tile, c ORDER BY r ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS d2 FROM m1),
m3 AS (SELECT *, CASE WHEN count(*) OVER w = 25 THEN min(d2) OVER w ELSE 0 END AS e1 FROM m2 WINDOW w AS (PARTITION BY tile, r ORDER BY c ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
closed AS (SELECT *, CASE WHEN count(*) OVER w = 25 THEN min(e1) OVER w ELSE 0 END AS e2 FROM m3 WINDOW w AS (PARTITION BY tile, c ORDER BY r ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))"""
LABELS = CLOSED.replace("WITH p0", "WITH RECURSIVE p0") + """, on_ AS (SELECT tile, r, c, r * 4294967296 + c AS id FROM closed WHERE e2 = 1),
reach(tile, r, c, id) AS (SELECT tile, r, c, id FROM on_ UNION SELECT o.tile, o.r, o.c, h.id FROM reach h JOIN on_ o ON o.tile = h.tile AND abs(o.r - h.r) + abs(o.c - h.c) = 1 AND h.id < o.id + 4294967296 * 100),
lab AS (SELECT tile, r, c, min(id) AS label FROM reach GROUP BY tile, r, c)"""
FOUND = LABELS + """, f0 AS (SELECT l.tile, l.label, count(*) AS valid_pixels, coalesce(avg(CAST(b.ndvi_diff AS DOUBLE)), 0) AS ndvi_delta_mean FROM lab l JOIN base b USING (tile, r, c) GROUP BY l.tile, l.label),
found AS (SELECT *, valid_pixels * 0.01e0 AS area_ha, least(abs(ndvi_delta_mean) / 0.5e0, 1e0) AS score FROM f0 WHERE valid_pixels >= 50 AND abs(ndvi_delta_mean) > 0)"""
SEASON = CLOSED + """, s0 AS (SELECT tile, CAST(count_if(e2 = 1 AND valid) AS BIGINT) AS n_changed, CAST(count_if(valid) AS BIGINT) AS n_valid, avg(CASE WHEN e2 = 1 AND valid THEN CAST(ndvi_diff AS DOUBLE) END) AS mean_, stddev_pop(CASE WHEN e2 = 1 AND valid THEN CAST(ndvi_diff AS DOUBLE) END) AS std_ FROM closed GROUP BY tile),
season AS (SELECT tile, n_changed, n_valid, CASE WHEN n_changed >= 50 THEN CASE WHEN abs(mean_) <= 1e-6 THEN 0e0 ELSE std_ / abs(mean_) END END AS cv, CASE WHEN n_changed >= 50 THEN n_changed / CAST(n_valid AS DOUBLE) END AS coverage FROM s0)"""


#: Where the raster lies: metres of UTM zone 33 north.
AFFINE, CRS = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), "EPSG:32633"


def warped(table_: str, x: str, y: str, names: str, zone: int = 33) -> str:
    """SQL that gives the rows of a table their lon and lat from UTM metres by the series of the inverse projection."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    scale = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    cosh, sinh = (lambda e, s=s: f"((exp({e}) {s} exp(-({e}))) / 2)" for s in "+-")
    terms = [(f"CAST({v!r} AS DOUBLE)", 2 * j) for j, v in enumerate(beta, 1)]
    xi0 = "xi" + "".join(f" - sin(xi * {m}) * {cosh(f'eta * {m}')} * {v}" for v, m in terms)
    eta0 = "eta" + "".join(f" - cos(xi * {m}) * {sinh(f'eta * {m}')} * {v}" for v, m in terms)
    lat = "chi" + "".join(f" + sin(chi * {2 * j}) * CAST({v!r} AS DOUBLE)" for j, v in enumerate(delta, 1))
    return f"""(SELECT {names}, {zone * 6 - 183} + degrees(atan2({sinh('eta0')}, cos(xi0))) AS lon, degrees({lat}) AS lat
FROM (SELECT *, asin(sin(xi0) / {cosh('eta0')}) AS chi FROM (SELECT *, {xi0} AS xi0, {eta0} AS eta0 FROM (SELECT *, ({y}) / CAST({scale!r} AS DOUBLE) AS xi, (({x}) - 500000e0) / CAST({scale!r} AS DOUBLE) AS eta FROM {table_}))))"""


def forward(table_: str, lon: str, lat: str, names: str, zone: int) -> str:
    """SQL that gives the rows of a table their easting ``e`` and northing ``n`` in a UTM zone by the series of the projection."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    scale, e = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    cosh, sinh = (lambda v, s=s: f"((exp({v}) {s} exp(-({v}))) / 2)" for s in "+-")
    atanh = lambda v: f"(0.5e0 * ln((1 + ({v})) / (1 - ({v}))))"
    number = lambda v: f"CAST({v!r} AS DOUBLE)"
    north = "xi" + "".join(f" + sin(xi * {2 * j}) * {cosh(f'eta * {2 * j}')} * {number(v)}" for j, v in enumerate(alpha, 1))
    east = "eta" + "".join(f" + cos(xi * {2 * j}) * {sinh(f'eta * {2 * j}')} * {number(v)}" for j, v in enumerate(alpha, 1))
    return f"""(SELECT {names}, 500000 + {number(scale)} * ({east}) AS e, {number(scale)} * ({north}) AS n
FROM (SELECT *, atan2(t, cos(far)) AS xi, {atanh('sin(far) / sqrt(1 + t * t)')} AS eta FROM (SELECT *, {sinh('q')} AS t FROM (SELECT *, {atanh('sine')} - {number(e)} * {atanh(f'{number(e)} * sine')} AS q
FROM (SELECT *, radians(({lon}) - {zone * 6 - 183}) AS far, sin(radians({lat})) AS sine FROM {table_})))))"""


def raster(spark: SparkSession, sf_dir: str, cases: bool = False) -> DataFrame:
    """The pixel table, before and after side by side; with ``cases`` tiles take turns as ``cased`` says."""
    u = F.col("u")
    px = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 2500").alias("tile"), F.expr("(o_orderkey % 2500) div 50").alias("r"), F.expr("o_orderkey % 50").alias("c"), F.col("o_custkey").alias("u"))
    loss = F.col("r").between(14, 24) & F.col("c").between(14, 33) & (u % 4 != 0)
    cloud = F.when(u % 23 == 0, 9).otherwise(4)
    if cases:
        turn, inside = F.col("tile") % 6, F.col("r").between(10, 39) & F.col("c").between(10, 39)
        loss = F.when(turn == 1, True).when(turn == 2, F.col("r") < 4).when(turn == 4, False).otherwise(loss)
        cloud = F.when(((turn == 1) & ~inside) | ((turn == 3) & (u % 5 != 0)), 9).otherwise(cloud)
    return px.select(
        "tile", "r", "c", "u",
        (u % 400 + 3000).alias("b08b"), (u * 7 % 120 + 400).alias("b04b"), (u * 5 % 150 + 900).alias("b11b"), (u * 11 % 130 + 600).alias("b12b"),
        F.when(loss, u % 300 + 1500).otherwise(u % 400 + 3000).alias("b08a"), F.when(loss, u * 3 % 200 + 900).otherwise(u * 7 % 120 + 400).alias("b04a"),
        F.when(loss, u * 3 % 150 + 1500).otherwise(u * 5 % 150 + 900).alias("b11a"), F.when(loss, u * 9 % 130 + 1200).otherwise(u * 11 % 130 + 600).alias("b12a"),
        cloud.alias("sclb"), F.when(u % 29 == 0, 8).when(u % 31 == 0, 0).otherwise(5).alias("scla"),
    )


def baselines(px: DataFrame) -> DataFrame:
    """The pair's valid mask, index differences and band distance."""
    c = F.col
    valid = pixels.valid_mask(c("b04b"), c("sclb")) & pixels.valid_mask(c("b04a"), c("scla"))
    px = px.withColumn("valid", valid)
    return px.withColumns(
        {
            "ndvi_diff": indices.index_difference(indices.ndvi(c("b08b"), c("b04b")), indices.ndvi(c("b08a"), c("b04a")), c("valid")),
            "nbr_diff": indices.index_difference(indices.nbr(c("b08b"), c("b12b")), indices.nbr(c("b08a"), c("b12a")), c("valid")),
            "ndmi_diff": indices.index_difference(indices.ndmi(c("b08b"), c("b11b")), indices.ndmi(c("b08a"), c("b11a")), c("valid")),
            "pixel_delta": indices.pixel_delta([(c("b04b"), c("b04a")), (c("b08b"), c("b08a"))], c("valid")),
        }
    )


def six(name: str):
    return F.round(F.col(name).cast("double"), 6).alias(name)


def closed(spark: SparkSession, sf_dir: str, threshold: float = 0.15, cases: bool = False) -> DataFrame:
    """The closed change mask, and ``raw``, the mask before its closing."""
    base = baselines(raster(spark, sf_dir, cases)).select("tile", "r", "c", "valid", "ndvi_diff", "pixel_delta")
    base = base.withColumn("changed", indices.exceeds(F.col("ndvi_diff"), threshold, "negative")).withColumn("raw", F.col("changed"))
    return regions.closing_by_blocks(base, ["tile"], "changed")


def labelled(px: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return regions.components_by_blocks(px, ["tile"], "changed", carry)


def all_findings(px: DataFrame) -> DataFrame:
    return regions.findings(labelled(px, ("ndvi_diff", "pixel_delta")), None, ["tile"])


@query(PX + "SELECT tile, r, c, round(CAST(ndvi_a AS DOUBLE), 6) AS ndvi, round(CAST(ndvi_diff AS DOUBLE), 6) AS ndvi_diff FROM base")
def ndvi(spark, sf_dir):
    px = baselines(raster(spark, sf_dir))
    return px.select("tile", "r", "c", F.round(indices.ndvi(F.col("b08a"), F.col("b04a")).cast("double"), 6).alias("ndvi"), six("ndvi_diff"))


@query(PX + "SELECT tile, r, c, round(CAST(nbr_a AS DOUBLE), 6) AS nbr, round(CAST(CASE WHEN valid THEN CAST(nbr_a - nbr_b AS FLOAT) END AS DOUBLE), 6) AS nbr_diff FROM base")
def nbr(spark, sf_dir):
    px = baselines(raster(spark, sf_dir))
    return px.select("tile", "r", "c", F.round(indices.nbr(F.col("b08a"), F.col("b12a")).cast("double"), 6).alias("nbr"), six("nbr_diff"))


@query(PX + "SELECT tile, r, c, round(CAST(ndmi_a AS DOUBLE), 6) AS ndmi, round(CAST(CASE WHEN valid THEN CAST(ndmi_a - ndmi_b AS FLOAT) END AS DOUBLE), 6) AS ndmi_diff FROM base")
def ndmi(spark, sf_dir):
    px = baselines(raster(spark, sf_dir))
    return px.select("tile", "r", "c", F.round(indices.ndmi(F.col("b08a"), F.col("b11a")).cast("double"), 6).alias("ndmi"), six("ndmi_diff"))


@query(PX + "SELECT tile, r, c, round(CAST(pixel_delta AS DOUBLE), 3) AS pixel_delta FROM base")
def pixel_delta(spark, sf_dir):
    return baselines(raster(spark, sf_dir)).select("tile", "r", "c", F.round(F.col("pixel_delta").cast("double"), 3).alias("pixel_delta"))


def _threshold(direction: str, sql: str):
    def run(spark, sf_dir):
        px = baselines(raster(spark, sf_dir)).withColumn("changed", indices.exceeds(F.col("ndvi_diff"), 0.15, direction))
        return px.groupBy("tile").agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n_pixels"))

    run.__name__ = f"threshold_{direction}"
    query(PX + f"SELECT tile, CAST(count_if({sql}) AS BIGINT) AS n_changed, count(*) AS n_pixels FROM base GROUP BY tile")(run)


_threshold("negative", "coalesce(ndvi_diff, 0) < CAST(-0.15 AS FLOAT)")
_threshold("positive", "coalesce(ndvi_diff, 0) > CAST(0.15 AS FLOAT)")
_threshold("absolute", "abs(coalesce(ndvi_diff, 0)) > CAST(0.15 AS FLOAT)")


@query(PX + "SELECT tile, r, c, b04b <> 0 AND sclb NOT IN (0,1,3,7,8,9,10,11) AS valid_before, b04a <> 0 AND scla NOT IN (0,1,3,7,8,9,10,11) AS valid_after FROM px")
def valid_mask(spark, sf_dir):
    px = raster(spark, sf_dir)
    return px.select("tile", "r", "c", pixels.valid_mask(F.col("b04b"), F.col("sclb")).alias("valid_before"), pixels.valid_mask(F.col("b04a"), F.col("scla")).alias("valid_after"))


@query(PX + "SELECT tile, r, c, valid FROM base")
def pair_mask(spark, sf_dir):
    px = raster(spark, sf_dir)
    before = px.select("tile", "r", "c", pixels.valid_mask(F.col("b04b"), F.col("sclb")).alias("vb"))
    after = px.select("tile", "r", "c", pixels.valid_mask(F.col("b04a"), F.col("scla")).alias("va"))
    return pixels.pair_pixels(before, after, ["tile"]).select("tile", "r", "c", (F.col("vb") & F.col("va")).alias("valid"))


@query(PX + "SELECT tile, count_if(scla NOT IN (1,3,7,8,9,10,11)) / CAST(count(*) AS DOUBLE) AS local_valid_fraction FROM px GROUP BY tile")
def local_valid_fraction(spark, sf_dir):
    return raster(spark, sf_dir).groupBy("tile").agg((F.count_if(indices.locally_valid(F.col("scla"))).cast("double") / F.count("*")).alias("local_valid_fraction"))


@query(
    PX
    + """SELECT tile, count(*) AS n_pixels, round(CASE WHEN least(max(r) - min(r) + 1, max(c) - min(c) + 1) >= 10 THEN avg(CASE WHEN valid THEN 1 ELSE 0 END) ELSE 0 END, 9) AS valid_fraction,
  least(max(r) - min(r) + 1, max(c) - min(c) + 1) AS shorter_side, bool_or(valid) AS any_valid, least(max(r) - min(r) + 1, max(c) - min(c) + 1) >= 10 AND avg(CASE WHEN valid THEN 1 ELSE 0 END) >= 0.3 AS usable FROM base GROUP BY tile"""
)
def valid_fraction(spark, sf_dir):
    return pixels.pair_summary(baselines(raster(spark, sf_dir)), ["tile"]).withColumn("valid_fraction", F.round("valid_fraction", 9))


@query(
    PX
    + """, stack AS (SELECT tile, r, c, b08b + (u * (s + 3)) % 50 AS b08, b04b + (u * (s + 5)) % 40 AS b04, (u + s) % 7 <> 0 AND (u + s) % 5 <> 1 AS valid FROM px, (SELECT unnest([0, 1, 2]) AS s))
SELECT tile, r, c, CAST(median(CASE WHEN valid THEN b08 END) AS DOUBLE) AS b08, CAST(median(CASE WHEN valid THEN b04 END) AS DOUBLE) AS b04, bool_or(valid) AS valid FROM stack GROUP BY tile, r, c"""
)
def median_composite(spark, sf_dir):
    px = raster(spark, sf_dir).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    u, s = F.col("u"), F.col("s")
    stack = px.select("tile", "r", "c", (F.col("b08b") + u * (s + 3) % 50).alias("b08"), (F.col("b04b") + u * (s + 5) % 40).alias("b04"), (((u + s) % 7 != 0) & ((u + s) % 5 != 1)).alias("valid"))
    out = pixels.median_composite(stack, ["tile"], ["b08", "b04"])
    return out.select("tile", "r", "c", F.col("b08").cast("double").alias("b08"), F.col("b04").cast("double").alias("b04"), "valid")


STRETCH = PX + """, q AS (SELECT tile, quantile_cont(CAST(b04a AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(b04a AS DOUBLE), 0.98) AS hi FROM px GROUP BY tile),
st AS (SELECT tile, r, c, CAST(floor(greatest(0e0, least(255e0, (b04a - lo) / (hi - lo) * 255))) AS INTEGER) AS red, b.ndvi_diff FROM base b JOIN q USING (tile))"""


@query(STRETCH + "SELECT tile, r, c, red AS b04a_8bit FROM st")
def percent_clip(spark, sf_dir):
    return pixels.percent_clip(raster(spark, sf_dir).select("tile", "r", "c", "b04a"), ["tile"], "b04a").select("tile", "r", "c", "b04a_8bit")


@query(
    STRETCH
    + """SELECT tile, r, c, CASE WHEN abs(coalesce(ndvi_diff, 0)) > CAST(0.15 AS FLOAT) THEN least(red + 150, 255) ELSE red END AS red,
  CASE WHEN abs(coalesce(ndvi_diff, 0)) > CAST(0.15 AS FLOAT) THEN red * 3 // 10 ELSE red END AS green FROM st"""
)
def overlay_rgb(spark, sf_dir):
    px = pixels.percent_clip(baselines(raster(spark, sf_dir)), ["tile"], "b04a").withColumn("changed", indices.exceeds(F.col("ndvi_diff")))
    v = F.col("b04a_8bit")
    return px.select("tile", "r", "c", indices.overlay(v, F.col("changed"), True).alias("red"), indices.overlay(v, F.col("changed"), False).alias("green"))


@query(CLOSED + "SELECT tile, r, c, e2 = 1 AS changed FROM closed")
def closing(spark, sf_dir):
    return closed(spark, sf_dir).select("tile", "r", "c", "changed")


@query(LABELS + "SELECT tile, r, c, label FROM lab")
def components(spark, sf_dir):
    return labelled(closed(spark, sf_dir))


@query(FOUND + "SELECT tile, label, valid_pixels, round(ndvi_delta_mean, 6) AS ndvi_delta_mean, round(area_ha, 6) AS area_ha, round(score, 6) AS score FROM found")
def findings(spark, sf_dir):
    found = all_findings(closed(spark, sf_dir))
    return found.select("tile", "label", "valid_pixels", six("ndvi_delta_mean"), six("area_ha"), six("score"))


@query(
    FOUND
    + """, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY tile ORDER BY score DESC, label) AS INTEGER) AS finding_id FROM found)
SELECT tile, finding_id, label, valid_pixels, round(score, 6) AS score, 0e0 AS nbr_delta_mean FROM k WHERE finding_id <= 20"""
)
def top_findings(spark, sf_dir):
    found = all_findings(closed(spark, sf_dir))
    return regions.top(found, ["tile"]).select("tile", "finding_id", "label", "valid_pixels", six("score"), F.lit(0.0).alias("nbr_delta_mean"))


@query(
    LABELS
    + """SELECT tile, label, CAST(min(c) AS DOUBLE) AS minx, CAST(min(r) AS DOUBLE) AS miny, CAST(max(c) AS DOUBLE) AS maxx, CAST(max(r) AS DOUBLE) AS maxy FROM lab GROUP BY tile, label"""
)
def hull(spark, sf_dir):
    rings = regions.hulls(labelled(closed(spark, sf_dir)), ["tile"])
    return rings.select("tile", "label", geometry.bbox(F.col("ring")).alias("b")).select("tile", "label", "b.*")


@query()
def hull_area(spark, sf_dir):
    rings = regions.hulls(labelled(closed(spark, sf_dir)), ["tile"])
    return rings.select("tile", "label", geometry.shoelace(F.col("ring")).alias("area"), (F.size("ring") - 1).alias("corners"))


@query(
    LABELS
    + ", b AS (SELECT tile, label, min(c) AS x0, min(r) AS y0, max(c) AS x1, max(r) AS y1 FROM lab GROUP BY tile, label)"
    + f""" SELECT p.tile, p.label, round(p.lon, 7) AS west, round(p.lat, 7) AS north, round(q.lon, 7) AS east, round(q.lat, 7) AS south
FROM {warped('b', '500000 + 10e0 * x0', '4600000 - 10e0 * y0', 'tile, label')} p JOIN {warped('b', '500000 + 10e0 * x1', '4600000 - 10e0 * y1', 'tile, label')} q ON p.tile = q.tile AND p.label = q.label"""
)
def findings_wgs84(spark, sf_dir):
    """Two corners of each finding's box in longitudes and latitudes."""
    rings = regions.hulls(labelled(closed(spark, sf_dir)), ["tile"]).withColumn("b", geometry.bbox(F.col("ring")))
    corner = lambda x, y: F.array(F.col(f"b.{x}"), F.col(f"b.{y}"))
    at = geometry.ring_to_wgs84(F.array(corner("minx", "miny"), corner("maxx", "maxy")), AFFINE, CRS)
    places = {"west": at[0][0], "north": at[0][1], "east": at[1][0], "south": at[1][1]}
    return rings.select("tile", "label", *(F.round(v, 7).alias(k) for k, v in places.items()))


@query(FOUND + " SELECT tile, round(avg(ndvi_delta_mean), 6) AS golden_mean, count(*) AS n_findings FROM found GROUP BY tile")
def golden_mean(spark, sf_dir):
    """Mean over a tile's findings of their mean differences, whatever their size."""
    found = all_findings(closed(spark, sf_dir))
    return found.groupBy("tile").agg(F.round(F.avg("ndvi_delta_mean"), 6).alias("golden_mean"), F.count("*").alias("n_findings"))


@query(
    PX
    + """, g AS (SELECT tile, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY tile),
cells AS (SELECT tile, h, w, t * 25 AS top, l * 25 AS left_, i, j FROM g, (SELECT unnest(range(0, 10)) AS t), (SELECT unnest(range(0, 10)) AS l), (SELECT unnest(range(0, 25)) AS i), (SELECT unnest(range(0, 25)) AS j) WHERE t < ceil(h / 25.0) AND l < ceil(w / 25.0)),
ch AS (SELECT x.tile, top, left_, least(25, h - top) * least(25, w - left_) AS covered, sqrt((avg(b04a) - avg(b04b)) ** 2 + (avg(b08a) - avg(b08b)) ** 2 + (stddev_pop(b04a) - stddev_pop(b04b)) ** 2 + (stddev_pop(b08a) - stddev_pop(b08b)) ** 2) AS d
 FROM cells x JOIN px p ON p.tile = x.tile AND p.r = h - 1 - abs(h - 1 - (top + i) % (2 * h - 2)) AND p.c = w - 1 - abs(w - 1 - (left_ + j) % (2 * w - 2)) GROUP BY x.tile, h, w, top, left_),
s AS (SELECT tile, min(d) AS lo, max(d) AS hi FROM ch GROUP BY tile), n AS (SELECT tile, covered, CASE WHEN hi - lo >= 1e-8 THEN (d - lo) / (hi - lo) ELSE 0e0 END AS score FROM ch JOIN s USING (tile))
SELECT tile, count(*) AS chip_count, round(sum(score * covered) / sum(covered), 5) AS change_score_mean, round(max(score), 5) AS change_score_max, 'mean-std-1' AS adapter_version FROM n GROUP BY tile"""
)
def ai_branch(spark, sf_dir):
    """Chips of both dates, their features, distances, and the summary of each tile."""
    px = raster(spark, sf_dir).select("tile", "r", "c", "b04b", "b08b", "b04a", "b08a")
    cells = chips.padded_chips(px, grids(spark, sf_dir), ["tile"], 25)
    scored = chips.compared(cells, ["tile"], chips.MeanStdModel, ["b04b", "b08b"], ["b04a", "b08a"], 25)
    out = chips.branch_summary(scored, ["tile"], chips.MeanStdModel.version)
    return out.withColumns({c: F.round(c, 5) for c in ("change_score_mean", "change_score_max")})


@query(
    PX
    + """, g AS (SELECT tile, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY tile), ok AS (SELECT * FROM g WHERE tile % 4 <> 3),
cells AS (SELECT tile, h, w, pr, pc, pr * 8 + i AS y, pc * 8 + j AS x FROM ok, (SELECT unnest(range(0, 20)) AS pr), (SELECT unnest(range(0, 20)) AS pc), (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j) WHERE pr * 8 < h AND pc * 8 < w),
pt AS (SELECT x.tile, pr, pc, least(8, h - pr * 8) * least(8, w - pc * 8) AS covered, sqrt((avg(b04a) - avg(b04b)) ** 2 + (avg(b08a) - avg(b08b)) ** 2 + (stddev_pop(b04a) - stddev_pop(b04b)) ** 2 + (stddev_pop(b08a) - stddev_pop(b08b)) ** 2) AS d
 FROM cells x JOIN px p ON p.tile = x.tile AND p.r = h - 1 - abs(h - 1 - y % (2 * h - 2)) AND p.c = w - 1 - abs(w - 1 - x % (2 * w - 2)) GROUP BY x.tile, h, w, pr, pc),
s AS (SELECT tile, min(d) AS lo, max(d) AS hi FROM pt GROUP BY tile), n AS (SELECT tile, covered, CASE WHEN hi - lo >= 1e-8 THEN (d - lo) / (hi - lo) ELSE 0e0 END AS score FROM pt JOIN s USING (tile))
SELECT g.tile, any_value(CASE WHEN g.tile % 4 <> 3 THEN 'patch-stats-1' END) AS adapter_version, any_value(CASE WHEN g.tile % 4 <> 3 THEN CAST(ceil(g.h / 32.0) * ceil(g.w / 32.0) AS BIGINT) END) AS chip_count, round(sum(score * covered) / sum(covered), 5) AS change_score_mean, round(max(score), 5) AS change_score_max,
 g.tile % 4 = 3 AS abstain, CASE WHEN g.tile % 4 = 3 THEN 'missing bands: b08' END AS abstain_reason FROM g LEFT JOIN n ON n.tile = g.tile GROUP BY g.tile"""
)
def ai_patches(spark, sf_dir):
    """The whole branch: chips of 32 pixels, patches of 8, and the outcome of tiles whose second date lacks a band."""
    px = raster(spark, sf_dir).select("tile", "r", "c", "b04b", "b08b", "b04a", "b08a")
    sizes = grids(spark, sf_dir)
    names = F.array(F.lit("b04"), F.lit("b08"))
    pairs = sizes.select("tile", names.alias("before_bands"), F.when(F.col("tile") % 4 == 3, F.array(F.lit("b04"))).otherwise(names).alias("after_bands"))
    out = chips.ai_outcomes(pairs, px, sizes, ["tile"], chips.PatchStats, ["b04b", "b08b"], ["b04a", "b08a"], 32)
    return out.withColumns({c: F.round(c, 5) for c in ("change_score_mean", "change_score_max")})


@query(
    """WITH b AS (SELECT p_partkey AS id, list_filter(['B02', 'B04', 'B08', 'B11', 'SCL'], lambda x, i: (p_partkey + i) % 4 <> 0) AS before_, list_filter(['B02', 'B04', 'B08', 'B11', 'SCL'], lambda x, i: (p_size + i) % 6 <> 0) AS after_ FROM part),
c AS (SELECT id, list_sort(list_intersect(before_, after_)) AS common FROM b)
SELECT id, array_to_string(common, ',') AS common, array_to_string(list_filter(['B04', 'B08'], lambda x: NOT list_contains(common, x)), ',') AS missing,
 len(list_filter(['B04', 'B08'], lambda x: NOT list_contains(common, x))) > 0 AS abstain FROM c"""
)
def common_bands(spark, sf_dir):
    """Bands that both windows of a pair have, and those that the model would miss; parts stand for pairs."""
    names = F.array(*map(F.lit, ("B02", "B04", "B08", "B11", "SCL")))
    have = lambda c, n: F.filter(names, lambda x, i: (F.col(c) + i + 1) % n != 0)
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), have("p_partkey", 4).alias("before_bands"), have("p_size", 6).alias("after_bands"))
    out = chips.bands_of(pairs, ("B04", "B08"))
    return out.select("id", F.concat_ws(",", "common").alias("common"), F.concat_ws(",", "missing").alias("missing"), (F.size("missing") > 0).alias("abstain"))


@query(
    SEASON
    + "SELECT tile, n_changed, n_valid, round(cv, 6) AS cv, round(coverage, 6) AS coverage, cv < 0.3 AS is_uniform, cv < 0.3 AND coverage > 0.5 AS should_abstain FROM season"
)
def seasonal_assessment(spark, sf_dir):
    return regions.seasonal(closed(spark, sf_dir), ["tile"]).select("tile", "n_changed", "n_valid", six("cv"), six("coverage"), "is_uniform", "should_abstain")


@query(
    PX
    + """, g AS (SELECT tile, max(r) + 1 AS height, max(c) + 1 AS width FROM px GROUP BY tile)
SELECT tile, top * 16 AS top, l * 16 AS left_ FROM g, (SELECT unnest(range(0, 100)) AS top), (SELECT unnest(range(0, 100)) AS l) WHERE top < ceil(height / 16.0) AND l < ceil(width / 16.0)"""
)
def chip_grid(spark, sf_dir):
    return chips.chip_grid(grids(spark, sf_dir), 16).select("tile", F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left_"))


def grids(spark, sf_dir):
    return raster(spark, sf_dir).groupBy("tile").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


@query(
    PX
    + """, g AS (SELECT tile, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY tile),
cells AS (SELECT tile, h, w, t * 32 AS top, l * 32 AS left_, i, j FROM g, (SELECT unnest(range(0, 10)) AS t), (SELECT unnest(range(0, 10)) AS l), (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 32)) AS j) WHERE t < ceil(h / 32.0) AND l < ceil(w / 32.0))
SELECT x.tile, x.top, x.left_, CAST(sum(p.b08a * (x.i * 32 + x.j + 1)) AS BIGINT) AS weighted, count(*) AS cells FROM cells x JOIN px p ON p.tile = x.tile
 AND p.r = h - 1 - abs(h - 1 - (top + i) % (2 * h - 2)) AND p.c = w - 1 - abs(w - 1 - (left_ + j) % (2 * w - 2)) GROUP BY x.tile, x.top, x.left_"""
)
def reflect_pad(spark, sf_dir):
    cells = chips.padded_chips(raster(spark, sf_dir).select("tile", "r", "c", "b08a"), grids(spark, sf_dir), ["tile"], 32)
    weight = F.col("i") * 32 + F.col("j") + 1
    return cells.groupBy("tile", F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left_")).agg(F.sum(F.col("b08a") * weight).alias("weighted"), F.count("*").alias("cells"))


@query(
    PX
    + """, g AS (SELECT tile, max(r) + 1 AS h, max(c) + 1 AS w FROM px GROUP BY tile), pt AS (SELECT tile, r // 8 AS pr, c // 8 AS pc, sum(b08a) AS v FROM px GROUP BY tile, r // 8, c // 8)
SELECT px.tile, px.r, px.c, CAST(v AS BIGINT) AS v FROM px JOIN pt ON pt.tile = px.tile AND pt.pr = px.r // 8 AND pt.pc = px.c // 8"""
)
def stitch(spark, sf_dir):
    px = raster(spark, sf_dir)
    patches = px.groupBy("tile", F.expr("r div 8").alias("pr"), F.expr("c div 8").alias("pc")).agg(F.sum("b08a").alias("v"))
    return chips.stitched(patches, grids(spark, sf_dir), ["tile"], 8).select("tile", "r", "c", "v")


@query(
    """SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[2] AS DOUBLE) - CAST(p[1] AS DOUBLE)) ** 2))), 5) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def feature_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(chips.feature_distance(F.col("embedding"), F.col("after")), 5).alias("distance"))


@query(PX + ", s AS (SELECT tile, min(pixel_delta) AS lo, max(pixel_delta) AS hi FROM base GROUP BY tile) SELECT tile, r, c, round((CAST(pixel_delta AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo), 5) AS norm FROM base JOIN s USING (tile)")
def minmax_norm(spark, sf_dir):
    px = baselines(raster(spark, sf_dir)).select("tile", "r", "c", F.col("pixel_delta").cast("double").alias("v"))
    return chips.min_max(px, ["tile"], "v").select("tile", "r", "c", F.round(F.when(F.col("v").isNotNull(), F.col("v_norm")), 5).alias("norm"))


@query(PX + "SELECT tile, round(avg(CAST(pixel_delta AS DOUBLE)), 4) AS mean_score, round(max(CAST(pixel_delta AS DOUBLE)), 4) AS max_score FROM base GROUP BY tile")
def ai_summary(spark, sf_dir):
    return baselines(raster(spark, sf_dir)).groupBy("tile").agg(F.round(F.avg(F.col("pixel_delta").cast("double")), 4).alias("mean_score"), F.round(F.max(F.col("pixel_delta").cast("double")), 4).alias("max_score"))


@query(PX + "SELECT tile, r, c, round(500000 + 10e0 * c, 6) AS x, round(4600000 - 10e0 * r, 6) AS y FROM px")
def pixel_to_world(spark, sf_dir):
    x, y = geometry.to_world(F.col("c"), F.col("r"), (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0))
    return raster(spark, sf_dir).select("tile", "r", "c", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(PX + f"SELECT tile, r, c, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {warped('px', '500000 + 10e0 * c', '4600000 - 10e0 * r', 'tile, r, c')}")
def utm_to_wgs84(spark, sf_dir):
    x, y = geometry.to_world(F.col("c"), F.col("r"), (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0))
    lon, lat = geometry.utm_to_wgs84(x, y, 33)
    return raster(spark, sf_dir).select("tile", "r", "c", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(PX + "SELECT f.tile, f.r, f.c, g.v FROM px f JOIN (SELECT tile, r, c, b11a AS v FROM px WHERE r < 25 AND c < 25) g ON g.tile = f.tile AND g.r = f.r // 2 AND g.c = f.c // 2")
def resample_nearest(spark, sf_dir):
    px = raster(spark, sf_dir)
    coarse = px.where("r < 25 AND c < 25").select("tile", "r", "c", F.col("b11a").alias("v"))
    return pixels.resample_half(px.select("tile", "r", "c"), coarse, ["tile"]).select("tile", "r", "c", "v")


@query(
    PX
    + """, t AS (SELECT tile, r, c, r * 0.5e0 AS y, c * 0.5e0 AS x FROM px), n AS (SELECT t.*, s.b11a AS v, (1 - abs(s.r - y)) * (1 - abs(s.c - x)) AS w FROM t JOIN px s ON s.tile = t.tile AND abs(s.r - y) < 1 AND abs(s.c - x) < 1)
SELECT tile, r, c, round(CAST(CAST(sum(v * w) / sum(w) AS FLOAT) AS DOUBLE), 3) AS b11a FROM n GROUP BY tile, r, c"""
)
def resample_bilinear(spark, sf_dir):
    px = raster(spark, sf_dir)
    target = px.select("tile", "r", "c", (F.col("r") * 0.5).alias("y"), (F.col("c") * 0.5).alias("x"))
    return pixels.bilinear(target, px, ["tile"], "b11a").select("tile", "r", "c", F.round(F.col("b11a").cast("double"), 3).alias("b11a"))
