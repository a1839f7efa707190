"""Evidence bundles, the findings store, tile reads and constraints."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.operators import control_plane as cp
from landshift.operators import evidence
from landshift.operators.storage import scratch
from landshift.sources import bundles, geotiff

RING = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([(1, "review_recommended", None), (2, "abstained", "seasonal pattern"), (3, "review_recommended", None)], "g int, status string, reason string")


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, 2, 0.5, 1.0, -0.3, 0.0, 0.0, 100, RING), (1, 1, 0.9, 2.0, -0.4, 0.0, 0.0, 200, RING), (2, 1, 0.7, 1.5, -0.2, 0.0, 0.0, 150, RING)]
    return spark.createDataFrame(rows, "g int, finding_id int, score double, area_ha double, ndvi_delta_mean double, nbr_delta_mean double, pixel_delta_mean double, valid_pixels_in_finding long, ring array<array<double>>")


def files_of(spark, runs, found):
    px = spark.range(6).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("g"), F.expr("id div 3").alias("r"), F.expr("id % 3").alias("c"), *((F.col("id") * k).cast("int").alias(f"x{k}") for k in range(1, 7)), (F.col("id") == 4).alias("changed"))
    shown = evidence.rendered(px, ["g"], ["x1", "x2", "x3"], ["x4", "x5", "x6"], "changed")
    left = found.join(runs.where("status <> 'abstained'"), "g", "left_semi")
    collections = evidence.feature_collections(left, ["g"], ["score", "area_ha", *evidence.MEASURES], runs)
    sourced = runs.withColumn("sources", F.struct(F.array(F.lit("a")).alias("before_source_scenes")))
    manifests = evidence.manifests(sourced, left, ["g"], {"spark": "4"}, {"task": "t", "ndvi_threshold": 0.15}, sources="sources")
    return evidence.bundles(runs, ["g"], collections, manifests, shown, F.concat(F.lit("run-"), F.col("g").cast("string")), "2024-01-01T00:00:00Z")


def test_bundles_are_written_whole_and_read_back(spark, runs, found):
    path = scratch(spark)
    files = files_of(spark, runs, found)
    bundles.write(files, path)
    got = {(r["run_id"], r["name"]): bytes(r["content"]) for r in bundles.read_files(spark, path).collect()}
    assert got == {(r["run_id"], r["name"]): bytes(r["content"]) for r in files.collect()}
    names = lambda run: {n for r, n in got if r == run}
    assert names("run-2") == {"findings.geojson", "provenance.json"}
    assert names("run-1") == names("run-3") == {"findings.geojson", "provenance.json", "before.png", "after.png", "overlay.png", "artifact_index.json"}
    index = json.loads(got["run-1", "artifact_index.json"])
    assert index["run_id"] == "run-1" and {a["name"]: a["size"] for a in index["artifacts"]} == {n: len(got["run-1", n]) for n in names("run-1") - {"artifact_index.json"}}
    assert all(("sha256" in a) == a["name"].endswith("json") for a in index["artifacts"])
    manifest = json.loads(got["run-1", "provenance.json"])
    assert [f["id"] for f in manifest["findings"]] == [1, 2] and manifest["findings"][0]["metrics"]["valid_pixels_in_finding"] == 200 and manifest["abstention"] is None
    assert manifest["sources"] == {"before_source_scenes": ["a"]} and manifest["processing_config"]["ndvi_threshold"] == 0.15 and manifest["artifacts"]["overlay"] == "overlay.png"
    abstained = json.loads(got["run-2", "provenance.json"])
    assert abstained["findings"] == [] and abstained["abstention"] == {"reason": "seasonal pattern"} and abstained["processing_config"] is None
    assert json.loads(got["run-2", "findings.geojson"]) == json.loads(got["run-3", "findings.geojson"]) == {"type": "FeatureCollection", "features": []}
    overlay, before = (evidence.unpng(got["run-1", n]) for n in ("overlay.png", "before.png"))
    assert before.shape == (2, 3, 3) and before[1, 1].tolist() == [4, 8, 12] and overlay[1, 1].tolist() == [154, 2, 3] and (overlay != before).any(2).sum() == 1


def test_a_failing_commit_leaves_nothing(spark, runs, found, tmp_path):
    path = tmp_path / "store"
    one = spark.createDataFrame([("a", "x.json", bytearray(b"1")), ("b", "x.json", bytearray(b"2"))], "run_id string, name string, content binary")
    bundles.write(one.where("run_id = 'b'"), str(path))
    with pytest.raises(Exception, match="b"):
        bundles.write(one.withColumn("content", F.lit(b"3")), str(path))  # b is there already: a must not appear
    assert sorted(p.name for p in path.iterdir()) == ["b"] and (path / "b" / "x.json").read_bytes() == b"2"
    bundles.write(one.withColumn("content", F.lit(b"3")), str(path), "overwrite")
    assert {p.name: (p / "x.json").read_bytes() for p in path.iterdir()} == {"a": b"3", "b": b"3"}
    with pytest.raises(Exception, match="file name"):
        bundles.write(spark.createDataFrame([("..", "x", bytearray(b"1"))], one.schema), str(path))
    assert sorted(p.name for p in path.iterdir()) == ["a", "b"]


def test_findings_store_passes_over_bad_files(spark, runs, found, tmp_path):
    path = str(tmp_path / "store")
    bad = spark.createDataFrame([("bad1", "findings.geojson", bytearray(b'{"type": "Feat')), ("bad2", "findings.geojson", bytearray(b"[]")), ("bad3", "findings.geojson", bytearray(b"")), ("bad4", "findings.geojson", bytearray(b'{"type":"FeatureCollection"}'))], "run_id string, name string, content binary")
    bundles.write(files_of(spark, runs, found).unionByName(bad), path)
    features, unread = bundles.findings_store(spark, path)
    assert {r["run_id"] for r in unread.collect()} == {"bad1", "bad2", "bad4"}  # bad3 is empty, which Spark's scan does not show
    placed = spark.createDataFrame([("p", "run-1", "completed", 1), ("p", "run-3", "completed", 2), ("p", "run-2", "abstained", 3), ("q", "run-1", "completed", 1)], "portfolio_id string, run_id string, status string, created_at int")
    got = sorted((r["portfolio_id"], r["place"], r["run_id"], r["idx"], r["json"]) for r in bundles.collected(features, placed).collect())
    assert [x[:4] for x in got] == [("p", 1, "run-1", 0), ("p", 2, "run-1", 1), ("q", 1, "run-1", 0), ("q", 2, "run-1", 1)]
    body = json.loads(got[0][4])
    assert body["type"] == "Feature" and body["properties"]["run_id"] == "run-1" and body["properties"]["score"] == 0.9 and body["geometry"] == {"type": "Polygon", "coordinates": [RING]}


@pytest.mark.parametrize(("big", "predictor", "order", "deflate", "kind"), [(False, 1, "<", True, np.uint16), (True, 2, "<", True, np.uint16), (False, 2, ">", True, np.uint16), (True, 1, ">", False, np.uint8), (True, 2, "<", False, np.uint8)])
def test_tiles_are_read_by_their_bytes(spark, tmp_path, big, predictor, order, deflate, kind):
    values = np.random.default_rng(1).integers(0, np.iinfo(kind).max, (300, 270)).astype(kind)
    path = tmp_path / "a.tif"
    path.write_bytes(geotiff.write_tiff(values, 32, (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), deflate, big, predictor, order))
    files = spark.createDataFrame([(str(path),)], "path string")
    everything = geotiff.tiles_of(files)
    assert everything.count() == 10 * 9
    box = (500400.0, 4599000.0, 500900.0, 4599500.0)
    tiles = geotiff.tiles_of(files, box)
    rows = tiles.collect()
    want = {(r, c): int(values[r, c]) for r in range(49, 101) for c in range(39, 91)}
    assert {(r["r"], r["c"]): r["value"] for r in geotiff.read_tiles(tiles).collect()} == want
    assert {(t["i"], t["j"]) for t in rows} == {(i, j) for i in (1, 2, 3) for j in (1, 2)}
    # A header and the window's tiles: of a file of 90 tiles, the bytes of six.
    assert sum(t["size"] for t in rows) + rows[0]["header_bytes"] < 0.2 * path.stat().st_size + geotiff.CHUNK
    assert {(r["r"], r["c"]): r["value"] for r in geotiff.read_window(spark, str(path), box).collect()} == want
    assert geotiff.read_tiles(geotiff.tiles_of(files, (0.0, 0.0, 10.0, 10.0))).count() == 0


def test_tile_reads_refuse_what_they_cannot_read(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"nothing of the kind, whatever its name says")
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff.tiles_of(spark.createDataFrame([(str(tmp_path / "a.tif"),)], "path string")).collect()


def test_constraints(spark):
    tables = {
        "portfolios": spark.createDataFrame([("p", "n"), ("p", "m"), (None, "x")], "id string, name string"),
        "runs": spark.createDataFrame([("r1", "p", "pending"), ("r2", "gone", "odd"), ("r3", None, None)], "id string, portfolio_id string, status string"),
        "reviews": spark.createDataFrame([("v1", "r1", 1, "uncertain"), ("v2", "r1", 1, "approved"), ("v3", "r1", None, "approved"), ("v4", "r1", None, "approved"), ("v5", "r9", 1, "approved")], "id string, run_id string, finding_idx int, state string"),
    }
    got = {tuple(r) for r in cp.audited(tables).collect()}
    assert got == {
        ("portfolios", "id not null", None, 1), ("portfolios", "id unique", "p", 1), ("runs", "portfolio_id references portfolios", "gone", 1), ("runs", "status check", "r2", 1), ("runs", "status not null", "r3", 1),
        ("reviews", "run_id, finding_idx unique", "r1/1", 1), ("reviews", "finding_idx not null", "v3", 1), ("reviews", "finding_idx not null", "v4", 1), ("reviews", "run_id references runs", "r9", 1),
    }
