"""Column functions and kernels: hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry, indices


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [(5000, 3000, 0.25), (0, 0, 0.0), (-1, 5, 0.0), (3, 0, 1.0), (0, 3, -1.0)])
def test_normalized_difference(spark, a, b, want):
    assert one(spark, indices.normalized_difference(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_normalized_difference_is_32_bit(spark):
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 10001, (500, 2)).tolist()
    got = [r["x"] for r in spark.createDataFrame(pairs, "a int, b int").select(indices.normalized_difference(F.col("a"), F.col("b")).alias("x")).collect()]
    a, b = np.array(pairs, np.float32).T
    assert got == pytest.approx(np.where(a + b > 0, (a - b) / np.maximum(a + b, 1), 0).tolist(), rel=1e-7)


@pytest.mark.parametrize(("d", "way", "want"), [(-0.15, "negative", False), (-0.16, "negative", True), (0.16, "positive", True), (-0.2, "absolute", True), (None, "negative", False), (0.2, "sideways", True)])
def test_threshold_is_strict_and_null_is_no_change(spark, d, way, want):
    assert one(spark, indices.exceeds(F.lit(d).cast("float"), 0.15, way)) is want


def test_score_and_small_rules(spark):
    assert one(spark, indices.score(F.lit(-0.25), F.lit(0.0))) == 0.5
    assert one(spark, indices.score(F.lit(0.0), F.lit(9000.0))) == pytest.approx(0.3)
    assert one(spark, indices.min_pixels(F.lit(0.5))) == 50 and one(spark, indices.min_pixels(F.lit(0.001))) == 1
    assert one(spark, indices.cross_season(F.lit("2024-11-01").cast("date"), F.lit("2024-02-01").cast("date"))) is True
    assert one(spark, indices.direction_for_task(F.lit("other"))) == "absolute"
    assert one(spark, indices.clear_ground(F.lit(0))) is False and one(spark, indices.locally_valid(F.lit(0))) is True


def test_band_distance_without_bands(spark):
    assert one(spark, indices.pixel_delta([], F.lit(True))) == 0.0 and one(spark, indices.pixel_delta([], F.lit(False))) is None


def test_reflection_is_numpys(spark):
    got = [r["x"] for r in spark.range(16).select(indices.reflected(F.col("id"), F.lit(10)).alias("x")).collect()]
    assert got == np.pad(np.arange(10), (0, 6), mode="reflect").tolist()


def test_box_area_of_a_tenth_of_a_degree(spark):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1), (0, 0))])
    assert one(spark, geometry.area_ha(ring)) == pytest.approx(12321, rel=1e-9)
    assert one(spark, geometry.shoelace(ring)) == pytest.approx(0.01)
    assert one(spark, geometry.coordinates_valid(ring)) is True


def test_utm_inverse(spark):
    lon, lat = geometry.utm_to_wgs84(F.lit(500000.0), F.lit(0.0), 33)
    assert one(spark, lon) == pytest.approx(15.0) and one(spark, lat) == pytest.approx(0.0)
    # Published example: Eiffel tower, zone 31, 448251.8 E 5411932.7 N is 2.2945 E, 48.8582 N.
    lon, lat = geometry.utm_to_wgs84(F.lit(448251.8), F.lit(5411932.7), 31)
    assert one(spark, lon) == pytest.approx(2.2945, abs=2e-4) and one(spark, lat) == pytest.approx(48.8582, abs=2e-4)


def square(x, y, s=1.0):
    return np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]], float)


def test_ring_intersection():
    assert geometry.crosses(square(0, 0), square(0.5, 0.5)) and geometry.crosses(square(0, 0, 9), square(2, 2)) and geometry.crosses(square(0, 0), square(1, 0))
    assert not geometry.crosses(square(0, 0), square(3, 0))
    triangle = np.array([[0, 0], [4, 0], [0, 4], [0, 0]], float)
    assert not geometry.crosses(triangle, square(2.5, 2.5))  # boxes meet, rings don't


def test_ring_udfs(spark):
    good, bow = square(0, 0).tolist(), [[0.0, 0.0], [1.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(good, good), (bow, good), (None, good), ([[0.0, 0.0]], good)], "p array<array<double>>, q array<array<double>>")
    assert [r[0] for r in df.select(geometry.is_simple("p")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(geometry.intersects("p", "q")).collect()] == [True, True, False, False]
