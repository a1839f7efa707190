"""Rings (arrays of [x, y]) as columns: boxes, areas, checks, warps; an Arrow kernel for exact intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

#: Kilometres of a degree, hectares of a square kilometre, the largest area in hectares, the most vertices.
KM_PER_DEGREE, HA_PER_KM2, MAX_AREA_HA, MAX_VERTICES = 111.0, 100.0, 50_000.0, 50_000


def bbox(ring: Column) -> Column:
    """minx, miny, maxx, maxy."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def area_ha(ring: Column) -> Column:
    """Of the bounding box, at 111 km a degree both ways."""
    b = bbox(ring)
    return (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"]) * (KM_PER_DEGREE**2 * HA_PER_KM2)


def square(lat: Column, lon: Column, km: Column) -> Column:
    """A closed ring around a point, ``km`` to each side, to six decimals."""
    dy, dx = km / KM_PER_DEGREE, km / (F.cos(F.radians(lat)) * KM_PER_DEGREE)
    west, east, south, north = (F.round(x, 6) for x in (lon - dx, lon + dx, lat - dy, lat + dy))
    return F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))


def coordinates_valid(ring: Column) -> Column:
    """One vertex at least, no more than MAX_VERTICES, longitudes and latitudes in range."""
    inside = F.forall(ring, lambda p: p[0].between(-180.0, 180.0) & p[1].between(-90.0, 90.0))
    return F.size(ring).between(1, MAX_VERTICES) & inside


def shoelace(ring: Column) -> Column:
    """Area of a closed ring in its own units."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(ring, i - 1)[0] * F.get(ring, i)[1] - F.get(ring, i)[0] * F.get(ring, i - 1)[1])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2


def to_world(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """Corner (column x, row y) to world coordinates by (a, b, c, d, e, f)."""
    a, b, c, d, e, f = affine
    return x * a + y * b + c, x * d + y * e + f


def utm_to_wgs84(easting: Column, northing: Column, zone: int, north: bool = True, m=F) -> tuple[Column, Column]:
    """Longitude and latitude by the Krueger series of the inverse transverse Mercator projection (to n^3).  ``m`` is NumPy for arrays."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - (0.0 if north else 1e7)) / (k0 * radius)
    eta = (easting - 500000.0) / (k0 * radius)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0 = xi0 - m.sin(xi * 2 * j) * m.cosh(eta * 2 * j) * b
        eta0 = eta0 - m.cos(xi * 2 * j) * m.sinh(eta * 2 * j) * b
    chi = m.asin(m.sin(xi0) / m.cosh(eta0))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + m.sin(chi * 2 * j) * d
    lon = m.atan2(m.sinh(eta0), m.cos(xi0)) + math.radians(zone * 6 - 183)
    return m.degrees(lon), m.degrees(lat)


def wgs84_to_utm(lon: np.ndarray, lat: np.ndarray, zone: int, north: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing by the Krueger series of the transverse Mercator projection (to n^3)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    far, sine, e = np.radians(lon - (zone * 6 - 183)), np.sin(np.radians(lat)), 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(sine) - e * np.arctanh(e * sine))
    xi0, eta0 = np.arctan2(t, np.cos(far)), np.arctanh(np.sin(far) / np.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, v in enumerate(alpha, 1):
        xi = xi + v * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta = eta + v * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    return 500000.0 + k0 * radius * eta, k0 * radius * xi + (0.0 if north else 1e7)


#: Names of geographic coordinates that need no warp.
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84", "CRS84")


def utm_zone(crs: str | None) -> tuple[int, bool] | None:
    """Zone and hemisphere of EPSG:326zz and EPSG:327zz; nothing for other systems."""
    digits = (crs or "").removeprefix("EPSG:")
    known = len(digits) == 5 and digits.isdigit() and digits[:3] in ("326", "327") and 1 <= int(digits[3:]) <= 60
    return (int(digits[3:]), digits[:3] == "326") if known else None


def reprojected(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions in another system: UTM zones and geographic coordinates, any to any; NaN where a system is not known."""
    if source == target or (source in GEOGRAPHIC and target in GEOGRAPHIC):
        return x, y
    at, to = utm_zone(source), utm_zone(target)
    if (at is None and source not in GEOGRAPHIC) or (to is None and target not in GEOGRAPHIC):
        return np.full(len(x), np.nan), np.full(len(x), np.nan)
    if at:
        # The zone is added afterwards: the series takes a constant for it.
        x, y = utm_to_wgs84(x, y - (0.0 if at[1] else 1e7), 0, m=np)
        x = x + 6 * at[0]
    return wgs84_to_utm(x, y, *to) if to else (x, y)


@F.pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def warp(x: pd.Series, y: pd.Series, source: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Positions in another system, by ``reprojected``; null where a system is not known.  As columns, the series would be repeated at each use."""
    out = pd.DataFrame({"x": np.full(len(x), np.nan), "y": np.full(len(x), np.nan)})
    pairs = pd.DataFrame({"s": source.fillna("").to_numpy(), "t": target.fillna("").to_numpy()})
    for (s, t), rows in pairs.groupby(["s", "t"]).indices.items():
        a, b = reprojected(x.to_numpy(float)[rows], y.to_numpy(float)[rows], s, t)
        out.iloc[rows, 0], out.iloc[rows, 1] = a, b
    return out.astype(object).where(out.notna(), None)


def ring_to_wgs84(ring: Column, affine: tuple[float, ...] | None, crs: str | None) -> Column:
    """A ring of (column, row) corners in longitudes and latitudes; as it is without affine or crs, unwarped in geographic ones, an error for systems other than UTM."""
    if not affine or not crs:
        return ring
    zone = utm_zone(crs)
    if crs not in GEOGRAPHIC and zone is None:
        raise ValueError(f"neither a UTM zone nor geographic coordinates: {crs}")

    def place(p: Column) -> Column:
        x, y = to_world(p[0], p[1], affine)
        return F.array(x, y) if crs in GEOGRAPHIC else F.array(*utm_to_wgs84(x, y, *zone))

    return F.transform(ring, place)


def crosses(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two closed rings share a point: an edge pair meets, or one ring holds the other."""
    return edges_meet(p, q) or holds(p, q[0]) or holds(q, p[0])


def edges_meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether an edge of one ring and an edge of the other share a point; long rings go edge by edge in blocks."""
    lo, hi = np.maximum(p.min(0), q.min(0)), np.minimum(p.max(0), q.max(0))
    if (lo > hi).any():
        return False
    a0, a1, b0, b1 = *ends_near(p, lo, hi), *ends_near(q, lo, hi)
    step = max(1, 2_000_000 // max(len(b0), 1))
    return any(pairs_meet(a0[k : k + step], a1[k : k + step], b0, b1) for k in range(0, len(a0), step))


def ends_near(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges that reach into a box."""
    on = ((np.minimum(r[:-1], r[1:]) <= hi) & (np.maximum(r[:-1], r[1:]) >= lo)).all(1)
    return r[:-1][on], r[1:][on]


def pairs_meet(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, q1: np.ndarray) -> bool:

    def side(a, b, c):
        return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))

    def within(a, b, c):
        return (np.minimum(a, b) <= c).all(-1) & (c <= np.maximum(a, b)).all(-1)

    a, b, c, d = p0[:, None], p1[:, None], q0[None], q1[None]
    s, t, u, v = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    meet = ((s * t < 0) & (u * v < 0)) | ((s == 0) & within(a, b, c)) | ((t == 0) & within(a, b, d)) | ((u == 0) & within(c, d, a)) | ((v == 0) & within(c, d, b))
    return bool(meet.any())


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    (x, y), a, b = point, ring[:-1], ring[1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool((spans & (x < at)).sum() % 2)


def ring_array(ring) -> np.ndarray | None:
    """A usable closed ring, else None."""
    if ring is None or len(ring) < 4:
        return None
    out = np.array([list(p) for p in ring], float)
    return out if out.ndim == 2 and out.shape[1] == 2 and np.isfinite(out).all() else None


@F.pandas_udf(BooleanType())
def intersects(p: pd.Series, q: pd.Series) -> pd.Series:
    """Exact test of two rings; bad geometry intersects nothing."""
    rings = [(ring_array(a), ring_array(b)) for a, b in zip(p, q, strict=True)]
    return pd.Series([a is not None and b is not None and crosses(a, b) for a, b in rings], dtype=bool)


def crossing(p: np.ndarray, q: np.ndarray, follows: np.ndarray) -> bool:
    """Whether edges p[k]-q[k] meet that do not follow one another in their ring (``follows[k]`` comes after k).

    A line sweeps over the edges and keeps those that it cuts in order; only neighbours in that
    order are tested, so n edges need about n log n steps.  The plane is sheared a little first,
    so that no edge lies along the line and only shared corners come at one time.
    """
    shear = (math.sqrt(5) - 1) / 50
    a, b = p[:, 0] + shear * p[:, 1], q[:, 0] + shear * q[:, 1]
    swap = a > b
    x0, x1 = np.where(swap, b, a), np.where(swap, a, b)
    y0, y1 = np.where(swap, q[:, 1], p[:, 1]), np.where(swap, p[:, 1], q[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(x1 > x0, (y1 - y0) / (x1 - x0), 0.0)
    n = len(p)
    at, leaves, edge = np.concatenate([x0, x1]), np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    order = np.lexsort((slope[edge], leaves, at))
    times, leaves, edge = at[order].tolist(), leaves[order].tolist(), edge[order].tolist()
    x0, y0, y1, slope, after = x0.tolist(), y0.tolist(), y1.tolist(), slope.tolist(), follows.tolist()
    ends = [(tuple(u), tuple(v)) for u, v in zip(p.tolist(), q.tolist(), strict=True)]
    line: list[int] = []

    def meet(i: int, j: int) -> bool:
        if after[i] == j or after[j] == i:
            return False
        (ax, ay), (bx, by) = ends[i]
        (cx, cy), (dx, dy) = ends[j]
        if max(ax, bx) < min(cx, dx) or max(cx, dx) < min(ax, bx) or max(ay, by) < min(cy, dy) or max(cy, dy) < min(ay, by):
            return False
        c, d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax), (bx - ax) * (dy - ay) - (by - ay) * (dx - ax)
        u, v = (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx), (dx - cx) * (by - cy) - (dy - cy) * (bx - cx)
        return (c == 0 or d == 0 or (c < 0) != (d < 0)) and (u == 0 or v == 0 or (u < 0) != (v < 0))

    def place(x: float, y: float, s: float) -> int:
        """The first edge of the line that lies above (y, s) at x."""
        lo, hi = 0, len(line)
        while lo < hi:
            mid = (lo + hi) // 2
            k = line[mid]
            there = y0[k] + (x - x0[k]) * slope[k]
            if there < y or (there == y and slope[k] <= s):
                lo = mid + 1
            else:
                hi = mid
        return lo

    for x, leaving, k in zip(times, leaves, edge, strict=True):
        if not leaving:
            i = place(x, y0[k], slope[k])
            if (i and meet(line[i - 1], k)) or (i < len(line) and meet(k, line[i])):
                return True
            line.insert(i, k)
            continue
        i = place(x, y1[k], slope[k]) - 1
        near = next((j for d in range(64) for j in (i - d, i + d) if 0 <= j < len(line) and line[j] == k), None)
        i = line.index(k) if near is None else near
        del line[i]
        if 0 < i < len(line) and meet(line[i - 1], line[i]):
            return True
    return False


def closed_simply(rings: list[np.ndarray | None]) -> bool:
    """Rings that are closed, have an area, don't fold back, and meet neither themselves nor one another."""
    ends, firsts, own, base = [], [], [], 0
    for r in rings:
        if r is None or (r[0] != r[-1]).any() or abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())) == 0:
            return False
        step = np.roll(r[:-1], -1, axis=0) - r[:-1]
        step = step[(step != 0).any(1)]
        r = np.concatenate([r[:1], r[0] + np.cumsum(step, axis=0)]) if len(step) < len(r) - 1 else r  # repeated corners are one
        after = np.roll(step, -1, axis=0)
        if ((step[:, 0] * after[:, 1] == step[:, 1] * after[:, 0]) & ((step * after).sum(1) < 0)).any():
            return False
        n = len(r) - 1
        firsts.append(r[:-1])
        ends.append(r[1:])
        own.append(base + (np.arange(n) + 1) % n)
        base += n
    return bool(rings) and not crossing(np.concatenate(firsts), np.concatenate(ends), np.concatenate(own))


@F.pandas_udf(BooleanType())
def is_simple(ring: pd.Series) -> pd.Series:
    """Closed, with an area, and without edges that meet other than at their shared ends."""
    return pd.Series([closed_simply([ring_array(r)]) for r in ring], dtype=bool)


# Areas: polygons with holes, [[outer ring, hole, ...], ...], as GeoJSON's MultiPolygon has them.

#: The type of an area's column.
AREA = "array<array<array<array<double>>>>"


def area_from(kind: Column, coordinates: Column) -> Column:
    """The area of a Polygon's or MultiPolygon's coordinates as JSON text; null for other types and texts that don't parse."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when((kind == "Polygon") & (F.size(one) > 0), F.array(one)).when(kind == "MultiPolygon", F.from_json(coordinates, AREA))


def points(area: Column) -> Column:
    """All corners of an area, holes included; ``bbox``, ``area_ha`` and ``coordinates_valid`` take them."""
    return F.flatten(F.flatten(area))


def packed(area: Column) -> tuple[Column, Column, Column]:
    """An area for a Python function, as flat lists: numbers, corners of each ring, rings of each polygon.  Nested lists that are empty in a whole batch break Arrow's conversion."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rings = F.flatten(area)
    flat = F.flatten(F.transform(points(area), lambda p: F.slice(p, 1, 2)))
    return F.coalesce(flat, none("double")), F.coalesce(F.transform(rings, lambda r: F.size(r)), none("int")), F.coalesce(F.transform(area, lambda p: F.size(p)), none("int"))


def polygon_arrays(numbers, corners, rings) -> list[list[np.ndarray]] | None:
    """The rings of each polygon of a ``packed`` area; None if there is none, or one of them is no ring."""
    numbers, corners = np.asarray(numbers, float), np.asarray(corners, int)
    if not len(rings) or not len(corners) or corners.min() < 0 or 2 * corners.sum() != len(numbers):
        return None
    each = iter(map(ring_array, np.split(numbers.reshape(-1, 2), np.cumsum(corners)[:-1])))
    out = [[next(each) for _ in range(n)] for n in rings]
    return out if all(polygon and all(r is not None for r in polygon) for polygon in out) else None


def inside(polygon: list[np.ndarray], point: np.ndarray) -> bool:
    """Even-odd over all rings: in the outer one and in no hole."""
    return sum(holds(r, point) for r in polygon) % 2 == 1


def share(p: list[np.ndarray], q: list[np.ndarray]) -> bool:
    """Whether two polygons with holes share a point: edges meet, or a corner of one lies in the other."""
    return any(edges_meet(a, b) for a in p for b in q) or inside(p, q[0][0]) or inside(q, p[0][0])


class Edges:
    """The edges of many packed areas, in the order of their rows, with the row and the polygon of each."""

    def __init__(self, numbers: pa.ListArray, corners: pa.ListArray, rings: pa.ListArray):
        n = len(numbers)
        lengths = lambda x: x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind)
        in_numbers, in_corners, in_rings = lengths(numbers), lengths(corners), lengths(rings)
        values, size, per = flat(numbers, float), flat(corners, np.int64), flat(rings, np.int64)
        row = lambda k: np.repeat(np.arange(n), k)
        summed = lambda at, weight: np.bincount(at, weight, n).astype(np.int64)
        self.ok = (in_rings > 0) & (in_corners > 0) & (2 * summed(row(in_corners), size) == in_numbers) & (summed(row(in_rings), per) == in_corners)
        self.ok &= (summed(row(in_corners), size < 4) == 0) & (summed(row(in_rings), per < 1) == 0) & (summed(row(in_numbers), ~np.isfinite(values)) == 0)
        if not self.ok.all():
            values, size, per = values[self.ok[row(in_numbers)]], size[self.ok[row(in_corners)]], per[self.ok[row(in_rings)]]
        points = values.reshape(-1, 2)
        self.polygon_row = np.repeat(np.flatnonzero(self.ok), in_rings[self.ok])
        ring_polygon = np.repeat(np.arange(len(per)), per)
        first = np.ones(len(points), bool)
        first[np.cumsum(size) - 1] = False  # the last corner of a ring begins no edge
        at = np.flatnonzero(first)
        self.a, self.b = points[at], points[at + 1]
        self.polygon = np.repeat(ring_polygon, size - 1)
        self.row = self.polygon_row[self.polygon]
        starts = np.searchsorted(self.polygon, np.arange(len(per)))
        self.corner = self.a[starts] if len(per) else np.empty((0, 2))  # one of each polygon's outer ring
        self.low, self.high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        np.minimum.at(self.low, self.row, np.minimum(self.a, self.b))
        np.maximum.at(self.high, self.row, np.maximum(self.a, self.b))

    def near(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The edges that reach into the box of their row."""
        return np.flatnonzero(((np.minimum(self.a, self.b) <= high[self.row]) & (np.maximum(self.a, self.b) >= low[self.row])).all(1))


def paired(left: np.ndarray, right: np.ndarray, step: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of two sorted lists of rows that have a row in common, all with all, in blocks of about ``step`` pairs."""
    begin, end = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n, at = end - begin, 0
    total = np.concatenate([[0], np.cumsum(n)])
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        yield i, begin[i] + np.arange(len(i)) - np.repeat(total[at:to] - total[at], n[at:to])
        at = to


def meeting(p: Edges, q: Edges) -> np.ndarray:
    """Of each row whether its two areas share a point."""
    out = np.zeros(len(p.ok), bool)
    low, high = np.maximum(p.low, q.low), np.minimum(p.high, q.high)
    live = p.ok & q.ok & (low <= high).all(1)
    e, f = p.near(low, high), q.near(low, high)
    e, f = e[live[p.row[e]]], f[live[q.row[f]]]
    for i, j in paired(p.row[e], q.row[f]):
        i, j = e[i], f[j]
        near = (np.minimum(p.a[i], p.b[i]) <= np.maximum(q.a[j], q.b[j])).all(1) & (np.minimum(q.a[j], q.b[j]) <= np.maximum(p.a[i], p.b[i])).all(1)
        i, j = i[near], j[near]
        side = lambda a, b, c: np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        met = (side(p.a[i], p.b[i], q.a[j]) * side(p.a[i], p.b[i], q.b[j]) <= 0) & (side(q.a[j], q.b[j], p.a[i]) * side(q.a[j], q.b[j], p.b[i]) <= 0)
        out[p.row[i[met]]] = True
    for x, y in ((p, q), (q, p)):  # a corner of one within the other
        corner = np.flatnonzero((live & ~out)[y.polygon_row])
        for i, j in paired(y.polygon_row[corner], x.row):
            point = y.corner[corner[i]]
            a, b = x.a[j], x.b[j]
            spans = (a[:, 1] > point[:, 1]) != (b[:, 1] > point[:, 1])
            i, j, point, a, b = i[spans], j[spans], point[spans], a[spans], b[spans]
            right = point[:, 0] < a[:, 0] + (point[:, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
            cell, crossings = np.unique(np.stack([corner[i], x.polygon[j]], 1)[right], axis=0, return_counts=True)
            inside_ = cell[crossings % 2 == 1]
            out[y.polygon_row[inside_[:, 0]]] = True
    return out


@F.arrow_udf(BooleanType())
def packed_intersect(p: pa.Array, pc: pa.Array, pr: pa.Array, q: pa.Array, qc: pa.Array, qr: pa.Array) -> pa.Array:
    """``areas_intersect`` of two ``packed`` areas."""
    return pa.array(meeting(Edges(p, pc, pr), Edges(q, qc, qr)))


def areas_intersect(p: Column, q: Column) -> Column:
    """Exact test of two areas; an area in the other's hole does not meet it, bad geometry meets nothing."""
    return packed_intersect(*packed(p), *packed(q))


def is_box(area: Column) -> Column:
    """Whether an area is one ring of five corners along the sides of its box, so that boxes alone tell what it meets."""
    ring = area[0][0]
    aligned = [(ring[k][0] == ring[k + 1][0]) != (ring[k][1] == ring[k + 1][1]) for k in range(4)]
    shape = (F.size(area) == 1) & (F.size(area[0]) == 1) & (F.size(ring) == 5)
    turns = (ring[0] == ring[4]) & (ring[0][0] != ring[2][0]) & (ring[0][1] != ring[2][1])
    return F.coalesce(F.when(shape, aligned[0] & aligned[1] & aligned[2] & aligned[3] & turns), F.lit(False))


@F.pandas_udf(BooleanType())
def _area_valid(p: pd.Series, pc: pd.Series, pr: pd.Series) -> pd.Series:
    def one(*a) -> bool:
        polygons = polygon_arrays(*a)
        return polygons is not None and all(closed_simply(x) and all(holds(x[0], h[0]) and not any(holds(g, h[0]) for g in x[1:] if g is not h) for h in x[1:]) for x in polygons)

    return pd.Series([one(*a) for a in zip(p, pc, pr, strict=True)], dtype=bool)


def area_valid(area: Column) -> Column:
    """Every polygon's rings are simple and don't meet, and its holes lie within the outer ring and not within each other."""
    return _area_valid(*packed(area))
