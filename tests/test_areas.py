"""Areas with holes, batch search, warps between systems and block resampling."""

import time
from datetime import date, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.operators import grids, requests, scenes


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


HOLED = [[square(0.0, 0.0, 10.0), square(2.0, 2.0, 6.0)]]


def test_areas_of_texts(spark):
    rows = [("Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]"), ("Point", "[1,2]"), ("Polygon", "[]"), ("Polygon", None), ("Polygon", "nonsense")]
    df = spark.createDataFrame(rows, "kind string, coordinates string").select(geometry.area_from(F.col("kind"), F.col("coordinates")).alias("a"))
    got = [r["a"] for r in df.collect()]
    assert got[0] == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]] and len(got[1]) == 2 and got[2:] == [None] * 4
    box = df.select(geometry.bbox(geometry.points(F.col("a"))).alias("b")).collect()[1]["b"]
    assert tuple(box) == (0.0, 0.0, 6.0, 6.0)


def test_holes_count(spark):
    cases = [(HOLED, [[square(4.0, 4.0, 1.0)]], False), (HOLED, [[square(1.0, 1.0, 2.0)]], True), (HOLED, [[square(0.5, 0.5, 0.5)]], True), (HOLED, [[square(-5.0, -5.0, 30.0)]], True), (HOLED, [[square(20.0, 0.0, 1.0)], [square(9.0, 9.0, 5.0)]], True), (None, HOLED, False), ([], HOLED, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], f"a {geometry.AREA}, b {geometry.AREA}")
    assert [r[0] for r in df.select(geometry.areas_intersect(F.col("a"), F.col("b"))).collect()] == [x for *_, x in cases]
    assert [r[0] for r in df.select(geometry.areas_intersect(F.col("b"), F.col("a"))).collect()] == [x for *_, x in cases]


def test_valid_areas(spark):
    cases = [(HOLED, True), ([[square(0.0, 0.0, 10.0), square(20.0, 2.0, 1.0)]], False), ([[square(0.0, 0.0, 10.0), square(8.0, 8.0, 6.0)]], False), ([[square(0.0, 0.0, 10.0), square(1.0, 1.0, 2.0), square(5.0, 5.0, 2.0)]], True), ([[square(0.0, 0.0, 10.0), square(1.0, 1.0, 5.0), square(2.0, 2.0, 2.0)]], False), ([[[[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]]], False), (None, False)]
    df = spark.createDataFrame([(a,) for a, _ in cases], f"a {geometry.AREA}")
    assert [r[0] for r in df.select(geometry.area_valid(F.col("a"))).collect()] == [x for _, x in cases]


def test_simple_rings_against_all_pairs():
    rng = np.random.default_rng(3)

    def slowly(p):
        n = len(p) - 1
        side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        for i in range(n):
            for j in range(i + 2, n - (i == 0)):
                a, b, c, d = p[i], p[i + 1], p[j], p[j + 1]
                boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
                if boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0:
                    return False
        return True

    seen = set()
    for k in range(120):
        angle = np.sort(rng.random(9)) * 2 * np.pi
        p = np.stack([np.cos(angle), np.sin(angle)], 1) * (0.5 + rng.random((9, 1)))
        if k % 2:
            i, j = rng.choice(9, 2, replace=False)
            p[[i, j]] = p[[j, i]]
        p = np.concatenate([p, p[:1]])
        seen.add(slowly(p))
        assert geometry.closed_simply([p]) == slowly(p)
    assert seen == {True, False}
    comb = np.array([[0, 0], [0, 2], [1, 2], [1, 1], [2, 1], [2, 2], [3, 2], [3, 0], [0, 0]], float)  # edges in one line that don't meet
    assert geometry.closed_simply([comb])
    assert not geometry.closed_simply([np.array([[0, 0], [4, 0], [2, 0], [2, 3], [0, 0]], float)])  # folds back


def test_fifty_thousand_corners_take_seconds():
    angle = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    star = np.stack([np.cos(angle), np.sin(angle)], 1) * np.where(np.arange(50_000) % 2, 1.0, 0.9)[:, None]
    teeth = np.repeat(np.arange(25_000.0), 2)
    comb = np.stack([np.where(np.arange(50_000) % 4 // 2, 1000.0, 0.0), teeth + np.arange(50_000) % 2 * 0.5], 1)
    comb = np.concatenate([comb, [[2000.0, 25_000.0], [2000.0, -1.0], [0.0, -1.0]]])
    began = time.perf_counter()
    for p in (star, comb):
        closed = np.concatenate([p, p[:1]])
        geometry.closed_simply([closed])
    assert geometry.closed_simply([np.concatenate([star, star[:1]])])
    assert time.perf_counter() - began < 20


def arrays(area):
    return [[np.array(r) for r in polygon] for polygon in area]


def test_many_areas_at_once_are_as_one_by_one():
    rng = np.random.default_rng(12)

    def some():
        out = []
        for _ in range(int(rng.integers(1, 3))):
            x, y, side = (float(v) for v in rng.random(3) * [10, 10, 5] + [0, 0, 0.2])
            rings = [square(x, y, side)]
            if rng.random() < 0.4:
                rings.append(square(x + side / 4, y + side / 4, side / 2))
            out.append(rings)
        return out

    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    pack = lambda areas: [lists([[v for polygon in a for r in polygon for p in r for v in p] for a in areas], pa.float64()), lists([[len(r) for polygon in a for r in polygon] for a in areas], pa.int32()), lists([[len(polygon) for polygon in a] for a in areas], pa.int32())]
    left, right = [some() for _ in range(600)] + [[], [[square(0.0, 0.0, 9.0)]]], [some() for _ in range(600)] + [HOLED, []]
    got = geometry.meeting(geometry.Edges(*pack(left)), geometry.Edges(*pack(right)))
    want = [bool(a) and bool(b) and any(geometry.share(x, y) for x in arrays(a) for y in arrays(b)) for a, b in zip(left, right, strict=True)]
    assert got.tolist() == want and 50 < sum(want) < 550


def test_boxes_are_known(spark):
    cases = [([[square(0.0, 0.0, 1.0)]], True), (HOLED, False), ([[square(0.0, 0.0, 1.0)], [square(3.0, 0.0, 1.0)]], False), ([[[[0.0, 0.0], [1.0, 0.1], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]], False), ([[square(0.0, 0.0, 0.0)]], False), ([[[[0.0, 0.0], [0.0, 1.0], [0.0, 2.0], [0.0, 1.0], [0.0, 0.0]]]], False), (None, False)]
    df = spark.createDataFrame([(a,) for a, _ in cases], f"a {geometry.AREA}")
    assert [r[0] for r in df.select(geometry.is_box(F.col("a"))).collect()] == [x for _, x in cases]


def search_by_hand(asked, scenes, limit):
    out = set()
    for key, area, spans in asked:
        for window, (first, last) in spans.items():
            met = [(ts, name) for name, ts, fp in scenes if first <= ts.date() <= last and any(geometry.share(a, b) for a in arrays(area) for b in arrays(fp))]
            for place, (_, name) in enumerate(sorted(met, key=lambda x: (-x[0].timestamp(), x[1]))[:limit], 1):
                out.add((key, window, name, place))
    return out


def test_search_of_many_areas_is_brute_force(spark):
    rng = np.random.default_rng(2)
    place = lambda: [[square(float(rng.integers(0, 60)) / 10, float(rng.integers(0, 60)) / 10, float(rng.integers(1, 25)) / 10)]]
    scenes = [(f"s{k:03}", datetime(2024, 1, 1 + int(rng.integers(0, 28)), int(rng.integers(0, 24))), place() if k % 9 else HOLED) for k in range(300)]
    asked = []
    for k in range(30):
        a, b = sorted(rng.integers(1, 15, 2))
        c, d = sorted(rng.integers(15, 29, 2))
        area = place() if k % 3 else place() + place()
        asked.append((k, area, {"before": (date(2024, 1, int(a)), date(2024, 1, int(b))), "after": (date(2024, 1, int(c)), date(2024, 1, int(d)))}))
    want = search_by_hand(asked, scenes, 5)
    q = spark.createDataFrame([(k, a, *w["before"], *w["after"]) for k, a, w in asked] + [(99, None, *asked[0][2]["before"], *asked[0][2]["after"])], f"request int, area {geometry.AREA}, before_from date, before_to date, after_from date, after_to date")
    s = spark.createDataFrame(scenes, f"scene_id string, ts timestamp, footprint {geometry.AREA}")
    for how in ({}, {"crowd": 3}, {"cell": 0.4, "days": 3}):
        got = requests.scenes_of(q, s, "request", 5, **how)
        assert {(r["request"], r["window"], r["scene_id"], r["place"]) for r in got.collect()} == want
    plan = requests.scenes_of(q, s, "request", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_equal_windows_and_footprints_are_searched_once(spark, monkeypatch):
    """copies of requests and scenes add no pairs to the search, and each request has its own rows."""
    tried = spark.sparkContext.accumulator(0)

    @F.arrow_udf("boolean")
    def counted(p: pa.Array, pc: pa.Array, pr: pa.Array, q: pa.Array, qc: pa.Array, qr: pa.Array) -> pa.Array:
        tried.add(len(p))
        return pa.array(geometry.meeting(geometry.Edges(p, pc, pr), geometry.Edges(q, qc, qr)))

    monkeypatch.setattr(geometry, "packed_intersect", counted)
    corner = lambda x, y: [[[[x, y], [x + 1.0, y], [x, y + 1.0], [x, y]]]]
    there = [(f"s{k:03}", datetime(2024, 1, 1 + k % 4, k // 24, k % 60), corner(k % 3 * 0.5, 0.0)) for k in range(240)]
    spans = [{"before": (date(2024, 1, 1), date(2024, 1, 1 + k)), "after": (date(2024, 1, 2 + k), date(2024, 1, 4))} for k in range(3)]
    asked = [(k, corner(k % 2 * 0.25, 0.1), spans[k % 3]) for k in range(60)]
    q = spark.createDataFrame([(k, a, *w["before"], *w["after"]) for k, a, w in asked], f"request int, area {geometry.AREA}, before_from date, before_to date, after_from date, after_to date")
    s = spark.createDataFrame(there, f"scene_id string, ts timestamp, footprint {geometry.AREA}")
    for limit in (5, 50):
        tried.value = 0
        got = requests.scenes_of(q, s, "request", limit).collect()
        assert {(r["request"], r["window"], r["scene_id"], r["place"]) for r in got} == search_by_hand(asked, there, limit)
        assert len(got) == len({(r["request"], r["window"], r["place"]) for r in got})
        assert 0 < tried.value <= 3 * 4 * 2 * 3 * 2  # footprints, days, areas, spans, windows


def test_rings_over_areas_are_brute_force(spark, monkeypatch):
    """boxes are not tested exactly, all other rings are, whatever the cells and however crowded."""
    rng = np.random.default_rng(6)

    def ring(k):
        x, y, side = (float(rng.integers(0, 40)) / 8, float(rng.integers(0, 40)) / 8, float(rng.integers(1, 20)) / 8)
        return [[x, y], [x + side, y], [x, y + side], [x, y]] if k % 4 == 3 else square(x, y, side)

    rings = [ring(k) for k in range(120)] + [square(1.0, 1.0, float("nan")), [[0.0, 0.0], [5.0, 5.0]], None, [[x, y, 0.0] for x, y in square(1.0, 1.0, 3.0)]]
    arrays = [geometry.ring_array(r) for r in rings]
    boxes = [k for k, r in enumerate(rings[:120]) if len(r) == 5]
    want = sorted((i, j) for i, p in enumerate(arrays) for j, q in enumerate(arrays) if p is not None and q is not None and geometry.crosses(p, q))
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "id int, ring array<array<double>>")
    s, a = df.select(F.col("id").alias("a"), F.col("ring").alias("footprint")), df.select(F.col("id").alias("b"), "ring")
    for how in ({}, {"cell": 0.4, "crowd": 3}):
        assert sorted((r["a"], r["b"]) for r in scenes.over_areas(s, a, **how).collect()) == want

    @F.pandas_udf("boolean")
    def never(p: pd.Series, q: pd.Series) -> pd.Series:
        raise AssertionError("boxes went to the exact test")

    monkeypatch.setattr(scenes, "intersects", never)
    got = scenes.over_areas(s.where(F.col("a").isin(boxes)), a.where(F.col("b").isin(boxes)))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(i, j) for i, j in want if i in boxes and j in boxes]


def test_projections_go_and_return():
    rng = np.random.default_rng(1)
    lon, lat = 15 + rng.random(50) * 6 - 3, rng.random(50) * 120 - 60
    for zone, crs in ((33, "EPSG:32633"), (32, "EPSG:32632"), (33, "EPSG:32733")):
        x, y = geometry.reprojected(lon, lat, "EPSG:4326", crs)
        back = geometry.reprojected(x, y, crs, "OGC:CRS84")
        assert np.abs(back[0] - lon).max() < 1e-7 and np.abs(back[1] - lat).max() < 1e-7
    x, y = geometry.wgs84_to_utm(np.array([15.0]), np.array([0.0]), 33)
    assert x[0] == pytest.approx(500000.0) and y[0] == pytest.approx(0.0, abs=1e-6)
    assert np.isnan(geometry.reprojected(lon, lat, "EPSG:3857", "EPSG:32633")[0]).all()
    assert geometry.utm_zone("EPSG:3857") is None and geometry.utm_zone("EPSG:32799") is None and geometry.utm_zone("EPSG:32701") == (1, False)


def test_unknown_systems_are_refused():
    with pytest.raises(ValueError, match="3857"):
        geometry.ring_to_wgs84(F.lit(None), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), "EPSG:3857")


BOX = "struct<crs: string, minx: double, miny: double, maxx: double, maxy: double, height: long, width: long>"


@pytest.mark.parametrize("block", [4, 7, 512])
def test_resampling_is_brute_force(spark, block):
    """A grid in one zone from pixels in another, with pixels missing and null, cell by cell."""
    rng = np.random.default_rng(5)
    h, w = 23, 19
    values, mask = rng.integers(1, 1000, (h, w)).astype(float), rng.random((h, w)) < 0.8
    values[rng.random((h, w)) < 0.1] = np.nan
    gone = rng.random((h, w)) < 0.1
    rows = [(7, r, c, None if np.isnan(values[r, c]) else float(values[r, c]), bool(mask[r, c])) for r in range(h) for c in range(w) if not gone[r, c]]
    px = spark.createDataFrame(rows, "id int, r long, c long, b double, valid boolean")
    before = ("EPSG:32633", 500000.0, 4599800.0, 500190.0, 4600030.0, 23, 19)
    after = ("EPSG:32632", 1000480.0, 4617250.0, 1000670.0, 4617480.0, 23, 19)
    both = grids.common_grid(spark.createDataFrame([(7, before, after)], f"id int, before {BOX}, after {BOX}"))
    g = both.first()
    assert g["usable"] and g["problem"] is None
    got = {(r["r"], r["c"]): (r["b"], r["valid"]) for r in grids.resampled(both, px, "after", "id", ["b"], ["valid"], block).collect()}
    assert len(got) == g["height"] * g["width"]
    some = 0
    for (r, c), (v, ok) in got.items():
        a = g["affine"]
        x, y = geometry.reprojected(np.array([a[2] + (c + 0.5) * a[0]]), np.array([a[5] + (r + 0.5) * a[4]]), "EPSG:32633", "EPSG:32632")
        fy, fx = (after[4] - y[0]) / 10 - 0.5, (x[0] - after[1]) / 10 - 0.5
        total = weight = 0.0
        for i in (int(np.floor(fy)), int(np.floor(fy)) + 1):
            for j in (int(np.floor(fx)), int(np.floor(fx)) + 1):
                if 0 <= i < h and 0 <= j < w and not gone[i, j] and not np.isnan(values[i, j]):
                    k = (1 - abs(fy - i)) * (1 - abs(fx - j))
                    total, weight = total + k * values[i, j], weight + k
        assert (v is None) == (weight <= 0) and (v is None or v == pytest.approx(total / weight, rel=1e-5))
        i, j = int(np.floor(fy + 0.5)), int(np.floor(fx + 0.5))
        inside = 0 <= i < h and 0 <= j < w and not gone[i, j]
        assert ok == (bool(mask[i, j]) if inside else None)
        some += inside
    assert some > 50


def test_prepared_pairs_hold_both_dates(spark):
    px = spark.createDataFrame([(1, r, c, float(r * 100 + c), (r + c) % 3 > 0) for r in range(12) for c in range(12)], "id int, r long, c long, b double, valid boolean")
    window = ("EPSG:32633", 500000.0, 4600000.0, 500120.0, 4600120.0, 12, 12)
    both = grids.common_grid(spark.createDataFrame([(1, window, window)], f"id int, before {BOX}, after {BOX}"))
    got = {(r["r"], r["c"]): r for r in grids.prepared(both, px, px.withColumn("b", F.col("b") + 1), "id", ["b"]).collect()}
    assert len(got) == 144 and all(r["before_b"] == rc[0] * 100 + rc[1] and r["after_b"] == r["before_b"] + 1 and r["valid"] == (sum(rc) % 3 > 0) for rc, r in got.items())
    assert pd.notna(got[0, 0]["before_b"])
