"""Requests that orders and nations stand for, their scenes, and the common grids of pairs that customers stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.functions import geometry, indices
from landshift.operators import grids, requests
from landshift.operators.storage import stored
from landshift.plans.raster_queries import PX, forward, raster, warped
from landshift.plans.registry import query, table
from landshift.plans.scene_queries import SC, boxes, catalog

RQ = """WITH rq AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS bf, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) AS bt, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 70 AS INTEGER) AS af, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS at_,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 13) / 10e0 END AS cloud, CASE o_orderkey % 11 WHEN 0 THEN 'Point' WHEN 1 THEN NULL WHEN 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, CASE o_orderkey % 19 WHEN 0 THEN 'flood' WHEN 1 THEN 'vegetation_disturbance' END AS task FROM orders)
"""


def bodies(spark, sf_dir):
    """Request texts with all kinds of faults."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    later = lambda n: F.date_add(day, n.cast("int")).cast("string")
    kind = F.when(k % 11 == 0, "Point").when(k % 11 == 1, None).when(k % 11 == 2, "MultiPolygon").otherwise("Polygon")
    window = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    body = F.struct(
        F.struct(kind.alias("type")).alias("geometry"), window(F.when(k % 17 == 0, "2024-02-30").otherwise(day.cast("string")), later(k % 40 - 5)).alias("before"), window(later(k % 70), later(k % 90)).alias("after"),
        F.when(k % 19 == 0, "flood").when(k % 19 == 1, "vegetation_disturbance").alias("task"), F.when(k % 3 == 0, k % 13 / 10.0).alias("max_cloud_fraction"), F.when(k % 5 == 0, True).alias("use_ai"),
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.to_json(body).alias("body"))


@query(
    RQ
    + """SELECT id, coalesce(task, 'vegetation_disturbance') AS task, coalesce(cloud, 0.15e0) AS max_cloud_fraction, id % 5 = 0 AS use_ai, 0.3e0 AS min_valid_pixels,
 CASE WHEN kind IS NULL THEN 'geometry without type' WHEN kind = 'Point' THEN 'geometry type' WHEN id % 17 = 0 THEN 'bad date' WHEN bf > bt OR af > at_ THEN 'window reversed' WHEN bt >= af THEN 'windows overlap' WHEN coalesce(cloud, 0.15e0) > 1 THEN 'bad cloud fraction' WHEN task = 'flood' THEN 'unsupported task' END AS error FROM rq"""
)
def request_parse(spark, sf_dir):
    return requests.parsed(bodies(spark, sf_dir)).select("id", "task", "max_cloud_fraction", "use_ai", "min_valid_pixels", "error")


#: Boxes that customers ask for, a second one three degrees to the east for every seventh, with a hole in the middle of every fifth, and their windows.
ASKED = SC + """, po AS (SELECT c_custkey AS id, (c_custkey * 37) % 40 - 20 + (c_custkey % 10) / 16.0e0 AS lon, (c_custkey * 53) % 30 - 15 + (c_custkey % 7) / 16.0e0 AS lat, 1 + c_custkey % 12 AS km FROM customer),
b AS (SELECT id, round(lon - km / (cos(radians(lat)) * 111.0e0), 6) AS w, round(lon + km / (cos(radians(lat)) * 111.0e0), 6) AS e, round(lat - km / 111.0e0, 6) AS s, round(lat + km / 111.0e0, 6) AS n FROM po),
a AS (SELECT * FROM b UNION ALL SELECT id, w + 3, e + 3, s, n FROM b WHERE id % 7 = 0),
q AS (SELECT id, DATE '2024-01-01' + CAST(id % 9 AS INTEGER) AS bf, DATE '2024-01-01' + CAST(id % 9 + id % 5 AS INTEGER) AS bt, DATE '2024-01-01' + CAST(id % 9 + id % 5 + 1 AS INTEGER) AS af, DATE '2024-01-01' + CAST(id % 9 + id % 5 + 1 + id % 11 AS INTEGER) AS at_ FROM b),
w AS (SELECT id, 'before' AS "window", bf AS first_, bt AS last_ FROM q UNION ALL SELECT id, 'after', af, at_ FROM q)
"""
BOXES = """, f AS (SELECT st.*, fw, fs, CASE WHEN user_id % 6 = 0 THEN fw + 4 ELSE fw + 1.1e0 END AS fe, CASE WHEN user_id % 6 = 0 THEN fs + 4 ELSE fs + 1.1e0 END AS fn, user_id % 6 = 0 AS holed FROM st JOIN (SELECT event_id, user_id, (user_id * 37) % 40 - 20.5e0 AS fw, (user_id * 53) % 30 - 15.5e0 AS fs FROM events) USING (event_id)),
p AS (SELECT DISTINCT w.id, "window", f.event_id, f.ts, f.scene_id FROM w JOIN a ON a.id = w.id JOIN f ON CAST(f.ts AS DATE) BETWEEN first_ AND last_ AND fw <= a.e AND a.w <= fe AND fs <= a.n AND a.s <= fn
  AND NOT (holed AND a.w > fw + 0.5e0 AND a.e < fw + 3.5e0 AND a.s > fs + 0.5e0 AND a.n < fs + 3.5e0)),
m AS (SELECT id AS request, "window", event_id, CAST(row_number() OVER (PARTITION BY id, "window" ORDER BY ts DESC, scene_id) AS INTEGER) AS place FROM p)"""


def box_ring(w, s, e, n):
    return F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))


def asked_bodies(spark, sf_dir):
    """Request texts with areas: a box a customer, a MultiPolygon of two for every seventh."""
    k, ring = F.col("id").cast("int"), F.col("ring")
    east = F.transform(ring, lambda p: F.array(p[0] + 3.0, p[1]))
    one, two = F.to_json(F.array(ring)), F.to_json(F.array(F.array(ring), F.array(east)))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("string")
    window = lambda a, b: F.concat(F.lit('{"from":"'), day(a), F.lit('","to":"'), day(b), F.lit('"}'))
    area = F.when(k % 7 == 0, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), two, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), one, F.lit("}")))
    start = k % 9 + k % 5
    body = F.concat(F.lit('{"geometry":'), area, F.lit(',"before":'), window(k % 9, start), F.lit(',"after":'), window(start + 1, start + 1 + k % 11), F.lit("}"))
    return boxes(spark, sf_dir).select(F.col("id").alias("request"), body.alias("body"))


def footprints(spark, sf_dir):
    """Scenes with their footprint: a box of about a degree, or a larger one with a hole."""
    u = F.col("_user")
    w, s, wide = u * 37 % 40 - F.lit(20.5), u * 53 % 30 - F.lit(15.5), u % 6 == 0
    side = F.when(wide, 4.0).otherwise(1.1)
    rings = F.when(wide, F.array(box_ring(w, s, w + side, s + side), box_ring(w + 0.5, s + 0.5, w + 3.5, s + 3.5))).otherwise(F.array(box_ring(w, s, w + side, s + side)))
    shapes = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("_user"))
    return catalog(spark, sf_dir).join(shapes, "event_id").withColumn("footprint", F.array(rings)).drop("_user")


@query(ASKED + BOXES + "SELECT * FROM m WHERE place <= 50")
def request_scenes(spark, sf_dir):
    """From request texts to the scenes of every request's area and windows, in one plan."""
    asked = requests.parsed(asked_bodies(spark, sf_dir)).where("error IS NULL")
    return requests.scenes_of(asked, footprints(spark, sf_dir), "request").select("request", "window", "event_id", "place")


@query(ASKED + "SELECT q.id AS request, bf AS before_from, at_ AS after_to, count(*) AS n_polygons, round(min(w), 6) AS minx, round(min(s), 6) AS miny, round(max(e), 6) AS maxx, round(max(n), 6) AS maxy, round((max(e) - min(w)) * (max(n) - min(s)) * 1232100e0, 2) AS area_ha, true AS valid FROM q JOIN a ON a.id = q.id GROUP BY 1, 2, 3")
def request_areas(spark, sf_dir):
    """The areas that survive the parsing of requests: their polygons, box, hectares and validity."""
    q = requests.parsed(asked_bodies(spark, sf_dir)).withColumn("p", geometry.points(F.col("area"))).withColumn("b", geometry.bbox(F.col("p")))
    valid = geometry.area_valid(F.col("area")) & geometry.coordinates_valid(F.col("p"))
    return q.select("request", "before_from", "after_to", F.size("area").cast("long").alias("n_polygons"), *(F.round(F.col("b")[c], 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")), F.round(geometry.area_ha(F.col("p")), 2).alias("area_ha"), valid.alias("valid"))


@query(SC + ", p AS (SELECT user_id AS event_id, avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) AS f FROM events GROUP BY user_id) SELECT event_id, round(coalesce(f, (100 - cloud) / 100), 6) AS valid_fraction FROM st LEFT JOIN p USING (event_id)")
def scene_quality(spark, sf_dir):
    """Scenes with probed pixels where a user has the scene's number; the rest by their cloud cover."""
    probed = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), (F.col("event_type") == "view").alias("valid"))
    return requests.quality(catalog(spark, sf_dir).select("event_id", "cloud"), probed, "event_id").select("event_id", F.round("valid_fraction", 6).alias("valid_fraction"))


@query(SC + "SELECT event_id, sha256(scene_id || '|B04,B08,SCL|{\"type\": \"Polygon\"}') AS cache_key FROM st")
def window_cache_key(spark, sf_dir):
    bands = F.array(*map(F.lit, ("SCL", "B08", "B04")))
    return catalog(spark, sf_dir).select("event_id", requests.cache_key(F.col("scene_id"), bands, F.lit('{"type": "Polygon"}')).alias("cache_key"))


def pairs(spark, sf_dir):
    """Two windows a customer: the second is moved, of another size, or the same."""
    k = F.col("c_custkey")
    x, y = 500000.0 + k % 50 * 10, 4600000.0 - k % 30 * 10
    dx, dy = k % 5 * 37.0 - 40, k % 7 * 23.0 - 60
    same = k % 6 == 0

    def window(x0, y0, w, h):
        return F.struct(F.lit("EPSG:32633").alias("crs"), x0.alias("minx"), y0.alias("miny"), (x0 + w * 10.0).alias("maxx"), (y0 + h * 10.0).alias("maxy"), h.alias("height"), w.alias("width"))

    w, h = k % 20 + 3, k % 15 + 3
    moved = window(x + F.when(same, 0.0).otherwise(dx), y + F.when(same, 0.0).otherwise(dy), w, h)
    return table(spark, sf_dir, "customer").select(k.alias("id"), window(x, y, w, h).alias("before"), moved.alias("after"))


@query(
    """WITH w AS (SELECT c_custkey AS id, c_custkey % 6 = 0 AS same, 500000e0 + c_custkey % 50 * 10 AS x, 4600000e0 - c_custkey % 30 * 10 AS y, c_custkey % 20 + 3 AS w, c_custkey % 15 + 3 AS h, CASE WHEN c_custkey % 6 = 0 THEN 0e0 ELSE c_custkey % 5 * 37e0 - 40 END AS dx, CASE WHEN c_custkey % 6 = 0 THEN 0e0 ELSE c_custkey % 7 * 23e0 - 60 END AS dy FROM customer),
b AS (SELECT *, greatest(x, x + dx) AS minx, greatest(y, y + dy) AS miny, least(x, x + dx) + w * 10e0 AS maxx, least(y, y + dy) + h * 10e0 AS maxy FROM w), m AS (SELECT *, minx < maxx AND miny < maxy AS meets FROM b),
g AS (SELECT *, meets AND dx = 0 AND dy = 0 AS fast FROM m),
s AS (SELECT *, CAST(CASE WHEN NOT meets THEN 0 WHEN fast THEN h ELSE greatest(1, round_even((maxy - miny) / 10, 0)) END AS BIGINT) AS height, CAST(CASE WHEN NOT meets THEN 0 WHEN fast THEN w ELSE greatest(1, round_even((maxx - minx) / 10, 0)) END AS BIGINT) AS width FROM g)
SELECT id, 'EPSG:32633' AS crs, fast, height, width, height >= 10 AND width >= 10 AS usable, CASE WHEN meets THEN minx END AS minx, CASE WHEN meets THEN maxy END AS maxy, CASE WHEN meets THEN round((maxx - minx) / width, 6) END AS step FROM s"""
)
def common_grid(spark, sf_dir):
    out = grids.common_grid(pairs(spark, sf_dir))
    return out.select("id", "crs", "fast", "height", "width", "usable", "minx", "maxy", F.round(F.col("affine")[0], 6).alias("step"))


ZONES = (
    """WITH k AS (SELECT c_custkey AS id, c_custkey % 3 AS kind, c_custkey % 20 + 12 AS w, c_custkey % 15 + 12 AS h, c_custkey % 50 * 40 AS dx, c_custkey % 30 * 30 AS dy FROM customer),
bw AS (SELECT *, CASE WHEN kind = 1 THEN 15e0 + dx / 90000e0 ELSE 500000e0 + dx END AS minx, CASE WHEN kind = 1 THEN 41.55e0 - dy / 120000e0 ELSE 4600000e0 - dy END AS miny, CASE WHEN kind = 1 THEN 15.003e0 + dx / 90000e0 ELSE 500000e0 + dx + w * 10 END AS maxx, CASE WHEN kind = 1 THEN 41.5525e0 - dy / 120000e0 ELSE 4600000e0 - dy + h * 10 END AS maxy FROM k),
aw AS (SELECT *, CASE WHEN kind = 0 THEN 1000480e0 + dx ELSE 500040e0 + dx END AS minx, CASE WHEN kind = 0 THEN 4617400e0 - dy ELSE 4599950e0 - dy END AS miny FROM k),
ac AS (SELECT id, kind, minx AS x, miny AS y FROM aw UNION ALL SELECT id, kind, minx + w * 10, miny + h * 10 FROM aw),
ab AS (SELECT id, min(e) AS minx, min(n) AS miny, max(e) AS maxx, max(n) AS maxy FROM """
    + forward(warped("(SELECT * FROM ac WHERE kind = 0)", "x", "y", "id", 32), "lon", "lat", "id", 33)
    + " GROUP BY id UNION ALL SELECT id, min(lon), min(lat), max(lon), max(lat) FROM "
    + warped("(SELECT * FROM ac WHERE kind = 1)", "x", "y", "id", 33)
    + """ GROUP BY id),
m AS (SELECT b.id, kind, greatest(b.minx, a.minx) AS minx, greatest(b.miny, a.miny) AS miny, least(b.maxx, a.maxx) AS maxx, least(b.maxy, a.maxy) AS maxy FROM bw b JOIN ab a USING (id)),
g AS (SELECT *, minx < maxx AND miny < maxy AS meets, CASE WHEN kind = 1 THEN 10 / 111000e0 ELSE 10e0 END AS step FROM m),
z AS (SELECT *, CAST(CASE WHEN meets THEN greatest(1, round_even((maxy - miny) / step, 0)) ELSE 0 END AS BIGINT) AS height, CAST(CASE WHEN meets THEN greatest(1, round_even((maxx - minx) / step, 0)) ELSE 0 END AS BIGINT) AS width FROM g)
"""
)


def system_pairs(spark, sf_dir):
    """Two windows a customer: of two zones, of degrees and a zone, or of a zone and a system that nobody knows."""
    k = F.col("c_custkey")
    kind, w, h, dx, dy = k % 3, k % 20 + 12, k % 15 + 12, k % 50 * 40, k % 30 * 30
    names = lambda crs, *sides: F.struct(crs.alias("crs"), *(v.cast("double").alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), sides, strict=True)), h.alias("height"), w.alias("width"))
    pick = lambda a, b, n=1: F.when(kind == n, a).otherwise(b)
    x, y = pick(dx / 90000.0 + 15.0, dx + 500000.0), pick(F.lit(41.55) - dy / 120000.0, F.lit(4600000.0) - dy)
    before = names(pick(F.lit("EPSG:4326"), F.lit("EPSG:32633")), x, y, pick(dx / 90000.0 + 15.003, dx + 500000.0 + w * 10), pick(F.lit(41.5525) - dy / 120000.0, F.lit(4600000.0) - dy + h * 10))
    x, y = pick(dx + 1000480.0, dx + 500040.0, 0), pick(F.lit(4617400.0) - dy, F.lit(4599950.0) - dy, 0)
    after = names(F.when(kind == 0, "EPSG:32632").when(kind == 1, "EPSG:32633").otherwise("EPSG:3857"), x, y, x + w * 10, y + h * 10)
    return table(spark, sf_dir, "customer").select(k.alias("id"), before.alias("before"), after.alias("after"))


@query(
    ZONES
    + """SELECT id, CASE WHEN kind = 1 THEN 'EPSG:4326' ELSE 'EPSG:32633' END AS crs, height, width, height >= 10 AND width >= 10 AS usable, CASE WHEN NOT meets THEN 'no overlap' WHEN NOT (height >= 10 AND width >= 10) THEN 'grid too small' END AS problem,
 CASE WHEN meets THEN round(minx, CASE WHEN kind = 1 THEN 7 ELSE 2 END) END AS minx, CASE WHEN meets THEN round(maxy, CASE WHEN kind = 1 THEN 7 ELSE 2 END) END AS maxy FROM z
UNION ALL SELECT id, 'EPSG:32633', 0, 0, false, 'unknown coordinate system', NULL, NULL FROM k WHERE kind = 2"""
)
def common_grid_zones(spark, sf_dir):
    """Common grids of windows in two zones, or in degrees and a zone; a system that is not known is told."""
    out = grids.common_grid(system_pairs(spark, sf_dir))
    near = lambda c: F.when(F.col("crs") == "EPSG:4326", F.round(c, 7)).otherwise(F.round(c, 2)).alias(c)
    return out.select("id", "crs", "height", "width", "usable", "problem", near("minx"), near("maxy"))


#: The raster's tiles as windows: the second date lies in another zone, beside the first, or under one in degrees.
PLACED = (
    PX
    + """, tl AS (SELECT DISTINCT tile, tile % 3 AS kind FROM px),
bw AS (SELECT tile, kind, CASE WHEN kind = 2 THEN 15e0 + 0.0072e0 * tile ELSE 500000e0 + 600 * tile END AS minx, CASE WHEN kind = 2 THEN 41.5455e0 ELSE 4599500e0 END AS miny, CASE WHEN kind = 2 THEN 15.006e0 + 0.0072e0 * tile ELSE 500500e0 + 600 * tile END AS maxx, CASE WHEN kind = 2 THEN 41.55e0 ELSE 4600000e0 END AS maxy FROM tl),
aw AS (SELECT tile, kind, CASE kind WHEN 0 THEN 1000490e0 + 598 * tile WHEN 1 THEN 500003e0 + 600 * tile ELSE 500000e0 + 600 * tile END AS minx, CASE kind WHEN 0 THEN 4616910e0 + 42 * tile WHEN 1 THEN 4599507e0 ELSE 4599500e0 END AS miny FROM tl),
ac AS (SELECT tile, kind, minx AS x, miny AS y FROM aw UNION ALL SELECT tile, kind, minx + 500, miny + 500 FROM aw),
ab AS (SELECT tile, min(e) AS minx, min(n) AS miny, max(e) AS maxx, max(n) AS maxy FROM """
    + forward(warped("(SELECT * FROM ac WHERE kind = 0)", "x", "y", "tile", 32), "lon", "lat", "tile", 33)
    + " GROUP BY tile UNION ALL SELECT tile, minx, miny, minx + 500, miny + 500 FROM aw WHERE kind = 1 UNION ALL SELECT tile, min(lon), min(lat), max(lon), max(lat) FROM "
    + warped("(SELECT * FROM ac WHERE kind = 2)", "x", "y", "tile", 33)
    + """ GROUP BY tile),
gm AS (SELECT tile, kind, greatest(b.minx, a.minx) AS minx, greatest(b.miny, a.miny) AS miny, least(b.maxx, a.maxx) AS maxx, least(b.maxy, a.maxy) AS maxy, CASE WHEN kind = 2 THEN 10 / 111000e0 ELSE 10e0 END AS step FROM bw b JOIN ab a USING (tile)),
gg AS (SELECT *, CAST(greatest(1, round_even((maxy - miny) / step, 0)) AS BIGINT) AS h, CAST(greatest(1, round_even((maxx - minx) / step, 0)) AS BIGINT) AS w FROM gm WHERE minx < maxx AND miny < maxy),
cl AS (SELECT tile, kind, r, c, minx + (c + 0.5e0) * ((maxx - minx) / w) AS x, maxy - (r + 0.5e0) * ((maxy - miny) / h) AS y FROM (SELECT *, unnest(range(w)) AS c FROM (SELECT *, unnest(range(h)) AS r FROM gg WHERE h >= 10 AND w >= 10))),
bp AS (SELECT cl.tile, r, c, (maxy - y) / ((maxy - miny) / 50) - 0.5e0 AS y, (x - minx) / ((maxx - minx) / 50) - 0.5e0 AS x FROM cl JOIN bw USING (tile)),
at_ AS (SELECT tile, r, c, e AS x, n AS y FROM """
    + forward(warped("(SELECT * FROM cl WHERE kind = 0)", "x", "y", "tile, r, c", 33), "lon", "lat", "tile, r, c", 32)
    + " UNION ALL SELECT tile, r, c, x, y FROM cl WHERE kind = 1 UNION ALL SELECT tile, r, c, e, n FROM "
    + forward("(SELECT * FROM cl WHERE kind = 2)", "x", "y", "tile, r, c", 33)
    + """),
ap AS (SELECT at_.tile, r, c, (miny + 500 - y) / 10 - 0.5e0 AS y, (x - minx) / 10 - 0.5e0 AS x FROM at_ JOIN aw USING (tile)),
bv AS (SELECT t.tile, t.r, t.c, CAST(CAST(sum(s.b04b * (1 - abs(s.r - y)) * (1 - abs(s.c - x))) / sum((1 - abs(s.r - y)) * (1 - abs(s.c - x))) AS FLOAT) AS DOUBLE) AS v FROM bp t JOIN px s ON s.tile = t.tile AND s.r IN (floor(y), floor(y) + 1) AND s.c IN (floor(x), floor(x) + 1) AND abs(s.r - y) < 1 AND abs(s.c - x) < 1 GROUP BY 1, 2, 3),
av AS (SELECT t.tile, t.r, t.c, CAST(CAST(sum(s.b04a * (1 - abs(s.r - y)) * (1 - abs(s.c - x))) / sum((1 - abs(s.r - y)) * (1 - abs(s.c - x))) AS FLOAT) AS DOUBLE) AS v FROM ap t JOIN px s ON s.tile = t.tile AND s.r IN (floor(y), floor(y) + 1) AND s.c IN (floor(x), floor(x) + 1) AND abs(s.r - y) < 1 AND abs(s.c - x) < 1 GROUP BY 1, 2, 3),
bm AS (SELECT t.tile, t.r, t.c, s.sclb NOT IN (0,1,3,7,8,9,10,11) AS ok FROM bp t JOIN px s ON s.tile = t.tile AND s.r = floor(y + 0.5) AND s.c = floor(x + 0.5)),
am AS (SELECT t.tile, t.r, t.c, s.scla NOT IN (0,1,3,7,8,9,10,11) AS ok FROM ap t JOIN px s ON s.tile = t.tile AND s.r = floor(y + 0.5) AND s.c = floor(x + 0.5))
SELECT cl.tile, cl.r, cl.c, round(bv.v, 1) AS before_b04, round(av.v, 1) AS after_b04, coalesce(bm.ok, false) AND coalesce(am.ok, false) AS valid FROM cl LEFT JOIN bv USING (tile, r, c) LEFT JOIN av USING (tile, r, c) LEFT JOIN bm USING (tile, r, c) LEFT JOIN am USING (tile, r, c)"""
)


@query(PLACED)
def prepared_pair(spark, sf_dir):
    """Both dates of each tile on their common grid: bands bilinear, masks nearest, over zones and degrees."""
    px = raster(spark, sf_dir)
    t = F.col("tile")
    kind = t % 3
    box = lambda crs, x0, y0, x1, y1: F.struct(crs.alias("crs"), *(v.cast("double").alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), (x0, y0, x1, y1), strict=True)), F.lit(50).cast("long").alias("height"), F.lit(50).cast("long").alias("width"))
    far = lambda deg, metres: F.when(kind == 2, deg).otherwise(metres)
    before = box(far(F.lit("EPSG:4326"), F.lit("EPSG:32633")), far(t * 0.0072 + 15.0, t * 600 + 500000.0), far(F.lit(41.5455), F.lit(4599500.0)), far(t * 0.0072 + 15.006, t * 600 + 500500.0), far(F.lit(41.55), F.lit(4600000.0)))
    x = F.when(kind == 0, t * 598 + 1000490.0).when(kind == 1, t * 600 + 500003.0).otherwise(t * 600 + 500000.0)
    y = F.when(kind == 0, t * 42 + 4616910.0).when(kind == 1, F.lit(4599507.0)).otherwise(F.lit(4599500.0))
    after = box(F.when(kind == 0, "EPSG:32632").otherwise("EPSG:32633"), x, y, x + 500.0, y + 500.0)
    both = stored(grids.common_grid(stored(px.select("tile").distinct().select("tile", before.alias("before"), after.alias("after")))))
    side = lambda band, scl: px.select("tile", "r", "c", F.col(band).alias("b04"), indices.clear_ground(F.col(scl)).alias("valid"))
    out = grids.prepared(both, side("b04b", "sclb"), side("b04a", "scla"), "tile", ["b04"])
    tenth = lambda c: F.round(F.col(c).cast("double"), 1).alias(c)
    return out.select("tile", "r", "c", tenth("before_b04"), tenth("after_b04"), "valid")
