"""Control plane, evaluation, scenes, evidence, monitoring and sources."""

import json
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.operators import chips, control_plane, evaluation, evidence, grids, scenes
from landshift.sources import benchmark, geotiff, stac
from landshift.streaming import monitoring


def test_upsert_keeps_the_last(spark):
    df = spark.createDataFrame([(1, 0, "pending", 1), (1, 0, "approved", 2), (1, 1, "rejected", 3)], "run_id int, idx int, state string, seq int")
    got = {(r["run_id"], r["idx"]): r["state"] for r in control_plane.upserted(df, ["run_id", "idx"], ["seq"]).collect()}
    assert got == {(1, 0): "approved", (1, 1): "rejected"}
    new = spark.createDataFrame([(1, 1, "approved", 9)], df.schema)
    assert control_plane.merged(df, new, ["run_id", "idx"]).count() == 3


def test_cascade(spark):
    p = spark.createDataFrame([(1,), (2,)], "portfolio_id int")
    g = spark.createDataFrame([(10, 1), (20, 2)], "polygon_id int, portfolio_id int")
    r = spark.createDataFrame([(100, 10), (200, 20)], "run_id int, polygon_id int")
    v = spark.createDataFrame([(100, None), (200, 2)], "run_id int, portfolio_id int")
    left = control_plane.portfolio_deleted(p, g, r, v, p.where("portfolio_id = 1"))
    assert {k: df.count() for k, df in left.items()} == {"portfolios": 1, "polygons": 1, "runs": 1, "reviews": 1}


def test_reconcile_and_states(spark):
    runs = spark.createDataFrame([(1, "pending"), (2, "running"), (3, "completed"), (4, "abstained")], "id int, status string")
    assert [r["status"] for r in control_plane.reconciled(runs).orderBy("id").collect()] == ["failed", "failed", "completed", "abstained"]
    bad = control_plane.violations(runs.union(spark.createDataFrame([(5, "lost"), (6, None)], runs.schema)), {"status": F.col("status").isin(*control_plane.RUN_STATES)})
    assert {r["id"] for r in bad.collect()} == {5, 6}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", 0.15), None),
        (("2024-02-30", "2024-02-01", "2024-03-01", "2024-04-01", 0.15), "bad date"),
        (("2024-02-02", "2024-02-01", "2024-03-01", "2024-04-01", 0.15), "before window reversed"),
        (("2024-01-01", "2024-02-01", "2024-05-01", "2024-04-01", 0.15), "after window reversed"),
        (("2024-01-01", "2024-03-01", "2024-03-01", "2024-04-01", 0.15), "windows overlap"),
        (("2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", 0.0), "bad cloud fraction"),
    ],
)
def test_configuration(spark, row, want):
    df = spark.createDataFrame([row], "before_from string, before_to string, after_from string, after_to string, max_cloud_fraction double")
    assert df.select(control_plane.config_error().alias("e")).first()["e"] == want


def test_label_suffix(spark):
    df = spark.createDataFrame([("Plot 12",), ("Plot",), ("7 ",), ("a1b",)], "label string")
    assert [r[0] for r in df.select(control_plane.label_suffix(F.col("label"))).collect()] == [12, 0, 7, 0]


EX = "example_id string, expected string, actual string, n long, m long, min_count long, max_count long"


def test_truth_table(spark):
    rows = [("a", "findings", "findings", 5, 3, 1, 2), ("b", "findings", "abstention", 0, 0, 2, 4), ("c", "abstention", "findings", 3, 3, 0, 0), ("d", "abstention", "abstention", 0, 0, 0, 0), ("e", "findings", "findings", 1, 0, 2, 3)]
    got = {r["example_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.counted(spark.createDataFrame(rows, EX)).collect()}
    assert got == {"a": (2, 3, 0), "b": (0, 0, 2), "c": (0, 3, 0), "d": (0, 0, 0), "e": (0, 1, 2)}


def test_metrics(spark):
    df = spark.createDataFrame([(2, 1, 0, 3, "findings", "findings"), (0, 0, 0, 0, "findings", "findings"), (1, 2, 1, 3, "findings", "findings")], "tp long, fp long, fn long, n long, expected string, actual string")
    r = df.agg(*evaluation.metrics()).first()
    assert (r["precision_at_k"], r["recall_at_k"], r["fp_rate"], r["mean_finding_count"], r["abstention_accuracy"]) == (0.5, 0.75, 100.0, 2.0, 1.0)
    assert set(df.limit(0).agg(*evaluation.metrics()).first().asDict().values()) == {0.0}


def test_gate(spark):
    arm = lambda tp, fp, n: spark.createDataFrame([(tp, fp, 0, tp + fp, "findings", "findings")] * n, "tp long, fp long, fn long, n long, expected string, actual string")
    told = lambda a, b: evaluation.gate(a, b).first()["decision"]
    assert told(arm(1, 1, 9), arm(1, 0, 9)) == "insufficient_data" and told(arm(1, 1, 10), arm(1, 0, 10)) == "other_wins"
    assert told(arm(1, 1, 10), arm(1, 2, 10)) == "baseline_wins" and told(arm(1, 1, 10), arm(1, 1, 10)) == "tie"


def test_scene_rules(spark):
    rows = [("S2A_10TFL_1", "2024-01-05", 5.0), ("S2A_10TFL_2", "2024-01-06", 5.0), ("S2A_X_3", "2024-01-25", 75.0), ("bad", "2024-03-01", 1.0)]
    df = spark.createDataFrame(rows, "scene_id string, day string, cloud double").withColumn("ts", F.col("day").cast("timestamp"))
    df = df.withColumns({"tile": scenes.mgrs_tile(F.col("scene_id")), "period": scenes.period(F.col("ts"), ("2024-01-01", "2024-01-10"), ("2024-01-20", "2024-01-30"))})
    got = {r["scene_id"]: (r["tile"], r["period"]) for r in df.collect()}
    assert got == {"S2A_10TFL_1": ("10TFL", "before"), "S2A_10TFL_2": ("10TFL", "before"), "S2A_X_3": (None, "after"), "bad": (None, "unknown")}
    best = scenes.ranked(scenes.clear_or_all(df, ["period"], 15.0), ["period"], 1).collect()
    assert {r["scene_id"] for r in best} == {"S2A_10TFL_2", "S2A_X_3", "bad"}  # a tie goes to the newest; all are cloudy: all stay


def test_common_tile(spark):
    rows = [("10AAA", "before", 1.0), ("10AAA", "after", 9.0), ("10BBB", "before", 2.0), ("10BBB", "after", 3.0), ("10CCC", "before", 0.0), (None, "after", 0.0)]
    got = scenes.common_tiles(spark.createDataFrame(rows, "tile string, period string, cloud double")).orderBy("tile_rank").collect()
    assert [r["tile"] for r in got] == ["10BBB", "10AAA"]


def test_chip_grid(spark):
    g = spark.createDataFrame([(1, 300, 256), (2, 0, 10)], "g int, height int, width int")
    assert sorted((r["top"], r["left"]) for r in chips.chip_grid(g, 256).collect()) == [(0, 0), (256, 0)]


def test_embedding_protocol(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 5.0],), (None,)], "data array<double>")
    assert [r["features"] for r in chips.embed(df, chips.MeanStdModel).collect()] == [[2.0, 5.0, 1.0, 0.0], None]


def test_png(spark):
    image = evidence.png(np.arange(24, dtype=np.uint8).reshape(2, 4, 3))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (4, 2)
    data = zlib.decompress(image[41 : 41 + struct.unpack(">I", image[33:37])[0]])
    assert data[1:13] == bytes(range(12)) and len(data) == 26


def test_geojson(spark):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, 2, 0.5, ring), (1, 1, 0.9, ring)], "g int, finding_id int, score double, ring array<array<double>>")
    body = json.loads(evidence.feature_collections(df, ["g"], ["score"]).first()["geojson"])
    assert [f["id"] for f in body["features"]] == [1, 2] and body["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [ring]}


def test_provenance_and_response(spark):
    runs = spark.createDataFrame([(1, "abstained", "seasonal pattern", 2), (2, "review_recommended", None, 0)], "g int, status string, reason string, n_findings long")
    manifests = {r["g"]: json.loads(r["provenance"]) for r in evidence.provenance(runs, ["g"], {"spark": "4"}).collect()}
    assert manifests[1]["abstention"] == {"reason": "seasonal pattern"} and manifests[2]["abstention"] is None
    found = spark.createDataFrame([(1, 1, 0.5, 1.0), (2, 1, 0.5, 1.5)], "g int, finding_id int, score double, area_ha double")
    got = {r["g"]: r["findings"] for r in evidence.api_response(runs, found, ["g"]).collect()}
    assert got[1] == [] and got[2][0]["changed_area_m2"] == 15000.0


def test_bucket():
    b = monitoring.Bucket(12.0, 0.2)
    assert [b.take(0.0) for _ in range(12)] == [None] * 12 and b.take(0.0) == 5 and b.take(5.0) is None


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"k{k % 3}", k, float(t), bool(k % 2)) for k, t in enumerate(np.sort(rng.random(400) * 20))]
    df = spark.createDataFrame(rows, "key string, seq long, ts double, is_run boolean")
    batch = sorted(map(tuple, monitoring.rate_limited(df).collect()))
    assert 0 < sum(not r[4] for r in batch) < len(batch)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = monitoring.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("decisions").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(90):  # a stream with timeouts always has a batch to run, so it never counts as done
        if q.exception() or spark.table("decisions").count() >= len(rows):
            break
        time.sleep(1)
    q.stop()
    assert q.exception() is None
    assert sorted(map(tuple, spark.table("decisions").collect())) == batch


def test_rate_limit_streams_hot_keys(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 else None if k % 2 else "cold", k, float(t), bool(k % 2)) for k, t in enumerate(rng.random(600) * 900)]
    df = spark.createDataFrame(rows, "key string, seq long, ts double, is_run boolean")
    want = []
    for key in ("hot", "cold", None):
        done = monitoring.fold(pd.DataFrame([r[1:] for r in rows if r[0] == key], columns=["seq", "ts", "is_run"]), monitoring.Bucket(*monitoring.GENERAL), monitoring.Bucket(*monitoring.RUNS))
        want += [(key, r.seq, r.ts, r.is_run, r.allowed, None if pd.isna(r.retry_after) else int(r.retry_after)) for r in done.itertuples()]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        limited = monitoring.rate_limited(df)
        assert sorted(map(tuple, limited.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroupsInPandas" not in limited._jdf.queryExecution().toString()


ITEM = {"id": "S2A_10TFL_1", "properties": {"datetime": "2024-01-05T10:00:00", "eo:cloud_cover": 5.0}, "bbox": [0, 0, 1, 1], "geometry": {"type": "Polygon"}, "assets": {"red": {"href": "r.tif"}, "scl": {"href": "s.tif"}, "thumb": {"href": "t"}}}


def test_items(spark, tmp_path):
    features = [ITEM, ITEM | {"id": "none", "bbox": None}, ITEM | {"id": "clear", "properties": {"datetime": "2024-01-06T10:00:00Z"}, "assets": {}}]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    got = {r["scene_id"]: r for r in stac.decoded(stac.read_items(spark, str(tmp_path / "a.json"))).collect()}
    assert set(got) == {"S2A_10TFL_1", "clear"} and got["S2A_10TFL_1"]["bands"] == {"B04": "r.tif"}
    assert got["S2A_10TFL_1"]["scl_url"] == "s.tif" and got["clear"]["cloud"] == 0.0 and got["clear"]["scl_url"] is None
    assert got["S2A_10TFL_1"]["ts"].hour == 10
    spark.dataSource.register(stac.CatalogSource)
    load = spark.read.format("landshift_catalog").option("paths", str(tmp_path / "a.json"))
    df = load.load()
    assert [r["id"] for r in df.where("day >= '2024-01-06'").collect()] == ["clear"] and df.count() == 3
    assert [r["id"] for r in load.option("from", "2024-01-06").option("to", "2024-01-06").load().collect()] == ["clear"]


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("down")
        return ["ok"]

    assert stac.with_retry(call, waits.append) == ["ok"] and waits == [2.0, 4.0]
    with pytest.raises(ConnectionError):
        stac.with_retry(lambda: (_ for _ in ()).throw(TimeoutError()), waits.append)


def test_area_file_shapes(spark):
    bare, feature = '{"type":"Polygon","coordinates":[]}', '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[]}}'
    df = spark.createDataFrame([(bare,), (feature,), ('{"type":"FeatureCollection","features":[' + feature + "]}",), ("{}",)], "t string")
    assert [r[0] for r in df.select(stac.area_of(F.col("t"))).collect()] == [bare, bare, bare, None]


@pytest.mark.parametrize("deflate", [True, False])
def test_geotiff_window(spark, tmp_path, deflate):
    values = np.arange(50 * 70, dtype=np.uint16).reshape(50, 70)
    (tmp_path / "a.tif").write_bytes(geotiff.write_tiff(values, affine=(10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), deflate=deflate))
    got = geotiff.read_window(spark, str(tmp_path / "a.tif"), (500200.0, 4599700.0, 500400.0, 4599900.0)).collect()
    assert {(r["r"], r["c"]): r["value"] for r in got} == {(r, c): int(values[r, c]) for r in range(9, 31) for c in range(19, 41)}
    assert geotiff.read_window(spark, str(tmp_path / "a.tif")).count() == values.size
    small = tmp_path / "b.tif"
    small.write_bytes(geotiff.write_tiff(np.arange(16, dtype=np.uint8).reshape(4, 4)))
    assert geotiff.read_window(spark, str(small)).count() == 16


def test_every_asset_has_its_band():
    names = ["coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3", "nir", "nir08", "swir16", "swir22"]
    assert stac.ASSET_BANDS == dict(zip(names, ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12"], strict=True))


def test_masks_meet_pixels_of_their_own_scene(spark):
    fine = spark.createDataFrame([("a", r, c, 1) for r in (0, 1) for c in (0, 1)] + [("b", 0, 0, 2)], "path string, r long, c long, value int")
    coarse = spark.createDataFrame([("a", 0, 0, 4), ("b", 0, 0, 9)], "path string, r long, c long, value int")
    got = sorted((r["path"], r["scl"]) for r in geotiff.harmonised(fine, coarse).collect())
    assert got == [("a", 4)] * 4 + [("b", 9)]


def test_benchmark_directories(spark, tmp_path):
    for d, names in (("one", ("aoi.geojson", "expected.json", "request.json")), ("two", ("aoi.geojson", "expected.json")), ("three", ("aoi.geojson",))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(f"{d} {n}")
    got = {r["example"]: (r["aoi"], r["expected"], r["request"]) for r in benchmark.read_examples(spark, str(tmp_path)).collect()}
    assert got == {"one": ("one aoi.geojson", "one expected.json", "one request.json"), "two": ("two aoi.geojson", "two expected.json", None)}


def test_arms_that_do_not_pair_end_the_job(spark):
    kind = "example_id long, tp long, fp long, fn long"
    a = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 0, 0)], kind)
    assert evaluation.paired(a, a, "example_id").count() == 2
    for other in ([(1, 1, 0, 0)], [(1, 1, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0)], [(1, 1, 0, 0), (2, 1, 0, 0), (3, 0, 0, 0)]):
        with pytest.raises(Exception, match="pair at example"):
            evaluation.paired(a, spark.createDataFrame(other, kind), "example_id").collect()


BOX = "struct<crs: string, minx: double, miny: double, maxx: double, maxy: double, height: long, width: long>"


def test_common_grids(spark):
    utm = lambda x, y, w, h, crs="EPSG:32633": (crs, x, y, x + 10.0 * w, y + 10.0 * h, h, w)
    rows = [
        (1, utm(500000.0, 4600000.0, 20, 12), utm(500000.0, 4600000.0, 20, 12)),
        (2, utm(500000.0, 4600000.0, 20, 12), utm(500030.0, 4599990.0, 20, 12)),
        (3, utm(500000.0, 4600000.0, 20, 12), utm(700000.0, 4600000.0, 20, 12)),
        (4, ("", 0.0, 0.0, 1.0, 1.0, 10, 10), ("EPSG:32633", 500000.0, 0.0, 500100.0, 100.0, 10, 10)),
        (5, ("EPSG:4326", 14.9, 41.0, 15.1, 42.0, 100, 20), utm(500000.0, 4600000.0, 20, 12)),
    ]
    pairs = spark.createDataFrame(rows, f"id int, before {BOX}, after {BOX}")
    got = {r["id"]: r for r in grids.common_grid(pairs).collect()}
    assert got[1]["fast"] and got[1]["height"] == 12 and got[1]["usable"]
    assert not got[2]["fast"] and (got[2]["height"], got[2]["width"]) == (11, 17) and got[2]["affine"] == [10.0, 0.0, 500030.0, 0.0, -10.0, 4600110.0]
    assert got[3]["height"] == 0 and not got[3]["usable"] and got[3]["affine"] is None
    assert got[4]["crs"] == "EPSG:32633" and got[4]["height"] == 0
    assert got[5]["crs"] == "EPSG:4326" and got[5]["minx"] == pytest.approx(15.0, abs=1e-6) and 41.5 < got[5]["miny"] < 41.6
    # Cells of the second grid take the pixels of both windows that lie under them.
    second = grids.common_grid(pairs.where("id = 2"))
    pixels = spark.range(12).select(F.lit(2).alias("id"), F.col("id").alias("r")).crossJoin(spark.range(20).select(F.col("id").alias("c"))).withColumn("v", F.col("r") * 100 + F.col("c"))
    before = {(r["r"], r["c"]): r["v"] for r in grids.placed(second, pixels, "before", "id", ["v"]).collect()}
    after = {(r["r"], r["c"]): r["v"] for r in grids.placed(second, pixels, "after", "id", ["v"]).collect()}
    assert before[0, 0] == 103 and before[10, 16] == 1119 and after[0, 0] == 0 and after[10, 16] == 1016
    assert len(before) == len(after) == 11 * 17


def test_warps_of_rings(spark):
    ring = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(10.0), F.lit(0.0)))
    at = lambda affine, crs: spark.range(1).select(geometry.ring_to_wgs84(ring, affine, crs)).first()[0]
    affine = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0)
    assert at(None, "EPSG:32633") == at(affine, "") == [[0.0, 0.0], [10.0, 0.0]]
    assert at(affine, "CRS84") == [[500000.0, 4600000.0], [500100.0, 4600000.0]]
    (x0, y0), (x1, _) = at(affine, "EPSG:32633")
    assert x0 == pytest.approx(15.0) and y0 == pytest.approx(41.5518, abs=1e-3) and x1 - x0 == pytest.approx(0.0012, abs=1e-4)


def test_patches_are_stitched_and_missing_bands_told(spark):
    rng = np.random.default_rng(4)
    h, w = 21, 18
    grid = rng.integers(0, 1000, (4, h, w)).astype(float)
    rows = [(t, r, c, *(float(v) for v in grid[:, r, c])) for t in (1, 2) for r in range(h) for c in range(w)]
    px = spark.createDataFrame(rows, "g int, r long, c long, b04b double, b08b double, b04a double, b08a double")
    sizes = spark.createDataFrame([(1, h, w), (2, h, w), (3, 0, 0)], "g int, height int, width int")
    pairs = spark.createDataFrame([(1, ["b04", "b08"], ["b08", "b04"]), (2, ["b04", "b08"], ["b02"]), (3, ["b04", "b08"], ["b04", "b08"])], "g int, before_bands array<string>, after_bands array<string>")
    got = {r["g"]: r for r in chips.ai_outcomes(pairs, px, sizes, ["g"], chips.PatchStats, ["b04b", "b08b"], ["b04a", "b08a"], 16).collect()}
    padded = np.pad(grid, ((0, 0), (0, 32 - h), (0, 32 - w)), mode="reflect")
    m, distance = chips.PatchStats(), np.zeros((h, w))
    for top in (0, 16):
        for left in (0, 16):
            cut = padded[:, top : top + 16, left : left + 16]
            far = np.sqrt(((m.features(cut[2:]) - m.features(cut[:2])) ** 2).sum(1)).reshape(2, 2).repeat(8, 0).repeat(8, 1)
            distance[top : top + 16, left : left + 16] = far[: h - top, : w - left]
    norm = (distance - distance.min()) / (distance.max() - distance.min())
    assert got[1]["chip_count"] == 4 and got[1]["change_score_mean"] == pytest.approx(norm.mean()) and got[1]["change_score_max"] == 1.0 and not got[1]["abstain"] and got[1]["adapter_version"] == "patch-stats-1"
    assert got[2]["abstain"] and got[2]["abstain_reason"] == "missing bands: b04, b08" and got[2]["adapter_version"] is None and got[2]["chip_count"] is None
    assert got[3]["abstain"] and got[3]["abstain_reason"] == "no pixels"
    one = chips.patch_tensors(chips.padded_chips(px.where("g = 1"), sizes.where("g = 1"), ["g"], 16), ["g"], chips.PatchStats, ["b04b", "b08b"], ["b04a", "b08a"], 16).first()
    assert one["n_patches"] == 4 and len(one["before"]) == 4 * 4 * 8 and len(one["distances"]) == 4


def few_grids(spark):
    """Pixels of grids of several sizes, one below, left of and beyond each, and the grids."""
    shapes = {1: (1, 1), 2: (2, 5), 3: (7, 1), 4: (16, 9), 5: (3, 20), 6: (0, 4)}
    rows = [(g, r, c, g * 10_000 + r * 100 + c) for g, (h, w) in shapes.items() for r in range(-1, h + 1) for c in range(-1, w + 1)]
    return shapes, spark.createDataFrame(rows, "g int, r long, c long, v long"), spark.createDataFrame([(g, *n) for g, n in shapes.items()], "g int, height long, width long")


def exploded_into_a_join(df) -> bool:
    """Whether rows that an explode makes are one side of a join: Spark takes them for as few as they come from, and broadcasts them."""

    def children(node):
        return [node.children().apply(k) for k in range(node.children().size())]

    def made(node) -> bool:
        name = node.nodeName()
        return name == "Generate" and node.generator().nodeName() == "Explode" or name in ("Project", "Filter", "Generate") and made(children(node)[0])

    def walk(node) -> bool:
        return node.nodeName() == "Join" and any(map(made, children(node))) or any(map(walk, children(node)))

    return walk(df._jdf.queryExecution().optimizedPlan())


def test_padding_mirrors_any_number_of_times(spark):
    """cells are made from the pixels, above the join, and are those of numpy's padding."""
    shapes, px, sizes = few_grids(spark)
    cells = chips.padded_chips(px, sizes, ["g"], 8)
    assert not exploded_into_a_join(cells)
    got = {(x["g"], x["top"] + x["i"], x["left"] + x["j"]): x["v"] for x in cells.collect()}
    want = {}
    for g, (h, w) in shapes.items():
        if h:
            grid = g * 10_000 + np.arange(h)[:, None] * 100 + np.arange(w)
            wide = np.pad(grid, ((0, -h % 8), (0, -w % 8)), mode="reflect")
            want |= {(g, r, c): int(wide[r, c]) for r in range(wide.shape[0]) for c in range(wide.shape[1])}
    assert got == want and cells.count() == len(want)


def test_chips_of_grids_of_any_size_are_compared(spark):
    """each chip's distance by numpy, from cells that are no side of a join."""
    shapes, px, sizes = few_grids(spark)
    bands = {"b04b": 7, "b08b": 11, "b04a": 5, "b08a": 13}
    px = px.select("g", "r", "c", *((F.col("v") % n).alias(b) for b, n in bands.items()))
    scored = chips.compared(chips.padded_chips(px, sizes, ["g"], 8), ["g"], chips.MeanStdModel, ["b04b", "b08b"], ["b04a", "b08a"], 8)
    assert not exploded_into_a_join(scored)
    got, n, m = {(x["g"], x["top"], x["left"]): (x["distance"], x["covered"]) for x in scored.collect()}, 0, chips.MeanStdModel()
    for g, (h, w) in shapes.items():
        v = g * 10_000 + np.arange(h)[:, None] * 100 + np.arange(w)
        wide = np.pad(np.stack([v % k for k in bands.values()]).astype(float), ((0, 0), (0, -h % 8), (0, -w % 8)), mode="reflect") if h else np.empty((4, 0, 0))
        for top in range(0, wide.shape[1], 8):
            for left in range(0, wide.shape[2], 8):
                cut = wide[:, top : top + 8, left : left + 8].reshape(4, -1)
                far = np.sqrt(((m.features(cut[2:]) - m.features(cut[:2])) ** 2).sum())
                assert got[g, top, left] == (pytest.approx(far), min(8, h - top) * min(8, w - left))
                n += 1
    assert len(got) == n

def test_patches_of_grids_of_any_size(spark):
    """every grid with rows and columns has its chips, from cells that are no side of a join."""
    shapes, px, sizes = few_grids(spark)
    px = px.select("g", "r", "c", *((F.col("v") % n).alias(b) for b, n in (("b04b", 7), ("b08b", 11), ("b04a", 5), ("b08a", 13))))
    names = F.array(F.lit("b04"), F.lit("b08"))
    pairs = sizes.select("g", names.alias("before_bands"), names.alias("after_bands"))
    out = chips.ai_outcomes(pairs, px, sizes, ["g"], chips.PatchStats, ["b04b", "b08b"], ["b04a", "b08a"], 8)
    assert not exploded_into_a_join(out)
    got = {x["g"]: (x["chip_count"], x["abstain_reason"], x["change_score_max"]) for x in out.collect()}
    several = {g: -(-h // 8) * -(-w // 8) for g, (h, w) in shapes.items()}
    assert got == {g: (n or None, None if n else "no pixels", (1.0 if n > 1 else 0.0) if n else None) for g, n in several.items()}
