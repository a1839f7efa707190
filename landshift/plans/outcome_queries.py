"""What runs come to: outcomes, evidence, bundles and the findings store, over the raster whose tiles take turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions import geometry, indices
from landshift.operators import evidence, pixels, regions
from landshift.operators.storage import scratch, stored
from landshift.plans.raster_queries import AFFINE, CRS, FOUND, PX, all_findings, cased, closed, raster, six, warped
from landshift.plans.registry import query
from landshift.sources import bundles

RUNS = cased(FOUND) + """, s AS (SELECT tile, CAST(count_if(e2 = 1 AND valid) AS BIGINT) AS n_changed, CAST(count_if(valid) AS BIGINT) AS n_valid, count(*) AS n_pixels, least(max(r) - min(r) + 1, max(c) - min(c) + 1) AS side, bool_or(m = 1) AS any_changed,
  stddev_pop(CASE WHEN e2 = 1 AND valid THEN CAST(ndvi_diff AS DOUBLE) END) / abs(avg(CASE WHEN e2 = 1 AND valid THEN CAST(ndvi_diff AS DOUBLE) END)) AS cv FROM closed GROUP BY tile),
t AS (SELECT *, CASE WHEN reason IS NULL THEN 'review_recommended' ELSE 'abstained' END AS status FROM (SELECT tile, CASE WHEN side < 10 OR n_valid / CAST(n_pixels AS DOUBLE) < 0.3 THEN 'insufficient valid pixels' WHEN NOT any_changed THEN 'no significant change detected'
  WHEN n_changed >= 50 AND cv < 0.3 AND n_changed / CAST(n_valid AS DOUBLE) > 0.5 THEN 'seasonal pattern' END AS reason FROM s)),
k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tile ORDER BY score DESC, label) AS INTEGER) AS finding_id FROM found SEMI JOIN t ON t.tile = found.tile AND t.reason IS NULL) WHERE finding_id <= 20),
ends AS (SELECT tile, label, r, x FROM (SELECT tile, label, r, min(c) AS x FROM lab GROUP BY tile, label, r UNION ALL SELECT tile, label, r, max(c) FROM lab GROUP BY tile, label, r) SEMI JOIN k USING (tile, label)),
places AS (SELECT tile, label, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM """ + warped("ends", "500000 + 10e0 * x", "4600000 - 10e0 * r", "tile, label") + """ GROUP BY tile, label)
"""


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every tile with its verdict, and the ranked, outlined findings of those that don't abstain, in longitudes and latitudes."""
    px = stored(closed(spark, sf_dir, cases=True))
    told = regions.verdicts(regions.assessed(px, ["tile"], raw="raw")).select("tile", "status", "reason")
    ranked = regions.outlined(regions.top(regions.granted(all_findings(px), told, ["tile"]), ["tile"]))
    return told, ranked.withColumn("ring", geometry.ring_to_wgs84(F.col("ring"), AFFINE, CRS))


def measured(ranked: DataFrame) -> DataFrame:
    """Findings with the measures that evidence states."""
    return ranked.withColumn("nbr_delta_mean", F.lit(0.0)).withColumnRenamed("valid_pixels", "valid_pixels_in_finding")


def sides(ring: str) -> list:
    box = geometry.bbox(F.col(ring))
    return [F.round(box[k], 6).alias(n) for k, n in (("minx", "west"), ("miny", "south"), ("maxx", "east"), ("maxy", "north"))]


@query(RUNS + "SELECT t.tile, status, reason, finding_id, round(score, 6) AS score, round(area_ha, 6) AS area_ha, round(ndvi_delta_mean, 6) AS ndvi_delta_mean, valid_pixels, west, south, east, north FROM t LEFT JOIN k ON k.tile = t.tile LEFT JOIN places p ON p.tile = k.tile AND p.label = k.label")
def change_findings(spark, sf_dir):
    """The flagship: from pixels to ranked findings with the box of their outline in longitudes and latitudes, and a row for each tile that has none."""
    told, ranked = judged(spark, sf_dir)
    return told.join(ranked, "tile", "left").select("tile", "status", "reason", "finding_id", six("score"), six("area_ha"), six("ndvi_delta_mean"), "valid_pixels", *sides("ring"))


@query(RUNS + "SELECT t.tile, any_value(reason) AS reason, any_value(status) AS status, count(k.label) AS n_findings FROM t LEFT JOIN (SELECT found.* FROM found SEMI JOIN t USING (tile)) k ON k.tile = t.tile AND t.reason IS NULL GROUP BY t.tile")
def outcomes(spark, sf_dir):
    px = stored(closed(spark, sf_dir, cases=True))
    out = regions.outcomes(regions.assessed(px, ["tile"], raw="raw"), all_findings(px), ["tile"])
    return out.select("tile", "reason", "status", "n_findings")


def collections(told: DataFrame, ranked: DataFrame) -> DataFrame:
    return evidence.feature_collections(measured(ranked), ["tile"], ["score", "area_ha", *evidence.MEASURES], told)


@query(
    RUNS
    + """SELECT t.tile, 'FeatureCollection' AS kind, finding_id AS id, CASE WHEN finding_id > 0 THEN 'Polygon' END AS shape, round(score, 6) AS score, round(area_ha, 6) AS area_ha, round(ndvi_delta_mean, 6) AS ndvi_delta_mean,
 CAST(valid_pixels AS DOUBLE) AS valid_pixels, west, south, east, north FROM t LEFT JOIN k ON k.tile = t.tile LEFT JOIN places p ON p.tile = k.tile AND p.label = k.label"""
)
def findings_geojson(spark, sf_dir):
    """Each run's GeoJSON text, read again: a row a feature, and one for a collection without any."""
    texts = collections(*judged(spark, sf_dir))
    body = F.from_json("geojson", f"struct<type: string, features: array<{bundles.FEATURE}>>")
    each = texts.withColumn("body", body).select("tile", F.col("body.type").alias("kind"), F.explode_outer("body.features").alias("f")).withColumn("ring", F.col("f.geometry.coordinates")[0])
    number = lambda c: F.round(F.col("f.properties")[c], 6)
    return each.select("tile", "kind", F.col("f.id").cast("int").alias("id"), F.col("f.geometry.type").alias("shape"), *(number(c).alias(c) for c in ("score", "area_ha", "ndvi_delta_mean")), number("valid_pixels_in_finding").alias("valid_pixels"), *sides("ring"))


CONFIG = {"task": "vegetation_disturbance", "threshold_direction": "negative", "ndvi_threshold": 0.15, "closing_kernel_size": 25}


def told_sources(told: DataFrame) -> DataFrame:
    """Runs with the scenes that they come from."""
    scene = lambda side: F.array(F.concat(F.lit("S2A_"), F.col("tile").cast("string"), F.lit(f"_{side}")))
    return told.withColumn("sources", F.struct(F.lit("single").alias("before_source_type"), F.lit("single").alias("after_source_type"), scene("before").alias("before_source_scenes"), scene("after").alias("after_source_scenes")))


def manifests(spark: SparkSession, told: DataFrame, ranked: DataFrame) -> DataFrame:
    return evidence.manifests(told_sources(told), measured(ranked), ["tile"], {"spark": spark.version}, CONFIG, sources="sources")


@query(
    RUNS
    + """SELECT t.tile, reason, 'deterministic-v1' AS model, 'overlay.png' AS overlay, CASE WHEN reason IS NULL THEN 0.15e0 END AS threshold, CASE WHEN reason IS NULL THEN 'S2A_' || t.tile || '_after' END AS scene, CAST(finding_id AS BIGINT) AS id, round(score, 6) AS score, round(area_ha, 6) AS area_ha,
 round(ndvi_delta_mean, 6) AS ndvi_delta_mean, CASE WHEN finding_id > 0 THEN 0e0 END AS nbr_delta_mean, CAST(valid_pixels AS DOUBLE) AS valid_pixels FROM t LEFT JOIN k ON k.tile = t.tile"""
)
def provenance(spark, sf_dir):
    """Each run's manifest, read again: a row a finding with its metrics, and one for a manifest without any."""
    schema = "struct<model_versions: array<string>, artifacts: map<string, string>, findings: array<struct<id: long, score: double, area_ha: double, metrics: map<string, double>>>, processing_config: struct<ndvi_threshold: double>, sources: struct<after_source_scenes: array<string>>, abstention: struct<reason: string>>"
    body = manifests(spark, *judged(spark, sf_dir)).withColumn("m", F.from_json("provenance", schema))
    each = body.select("tile", "m.*", F.explode_outer("m.findings").alias("f"))
    metric = lambda c: F.round(F.col("f.metrics")[c], 6)
    return each.select(
        "tile", F.col("abstention.reason").alias("reason"), F.col("model_versions")[0].alias("model"), F.col("artifacts")["overlay"].alias("overlay"), F.col("processing_config.ndvi_threshold").alias("threshold"), F.col("sources.after_source_scenes")[0].alias("scene"),
        F.col("f.id").alias("id"), F.round("f.score", 6).alias("score"), F.round("f.area_ha", 6).alias("area_ha"), metric("ndvi_delta_mean").alias("ndvi_delta_mean"), metric("nbr_delta_mean").alias("nbr_delta_mean"), metric("valid_pixels_in_finding").alias("valid_pixels"),
    )


@query(
    RUNS
    + """SELECT t.tile, status, CASE WHEN reason IS NULL THEN 'runs/' || t.tile || '/overlay.png' END AS overlay, finding_id, round(score, 6) AS change_score, round(area_ha * 10000, 4) AS changed_area_m2, round(ndvi_delta_mean, 6) AS ndvi_delta, CASE WHEN finding_id > 0 THEN 0e0 END AS nbr_delta,
 CASE WHEN finding_id > 0 THEN 'deterministic-v1' END AS encoder, west, north FROM t LEFT JOIN k ON k.tile = t.tile LEFT JOIN places p ON p.tile = k.tile AND p.label = k.label"""
)
def api_response(spark, sf_dir):
    """The response of each run: a row a finding, and one for a run without any."""
    told, ranked = judged(spark, sf_dir)
    out = evidence.api_response(told, measured(ranked), ["tile"], base="runs/")
    each = out.select("tile", "status", F.col("artifacts.overlay").alias("overlay"), F.explode_outer("findings").alias("f")).withColumn("ring", F.col("f.geometry.coordinates")[0])
    west, _, _, north = sides("ring")
    return each.select(
        "tile", "status", "overlay", F.col("f.finding_id").alias("finding_id"), F.round("f.change_score", 6).alias("change_score"), F.round("f.changed_area_m2", 4).alias("changed_area_m2"), F.round("f.evidence.ndvi_delta", 6).alias("ndvi_delta"),
        F.col("f.evidence.nbr_delta").alias("nbr_delta"), F.col("f.model.encoder").alias("encoder"), west, north,
    )


def pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with the green and blue bands of both dates, stretched, and the change mask of the overlay."""
    u = F.col("u")
    px = baselines_of(raster(spark, sf_dir, cases=True))
    px = px.withColumns({"b03b": u * 13 % 110 + 500, "b02b": u * 17 % 90 + 300, "b03a": u * 19 % 130 + 550, "b02a": u * 23 % 70 + 350})
    return pixels.stretched(px, ["tile"], ["b04b", "b03b", "b02b", "b04a", "b03a", "b02a"])


def baselines_of(px: DataFrame) -> DataFrame:
    from landshift.plans.raster_queries import baselines

    return baselines(px).select("tile", "r", "c", "u", "b04b", "b04a", indices.exceeds(F.col("ndvi_diff")).alias("changed"))


BEFORE, AFTER = [f"{b}_8bit" for b in ("b04b", "b03b", "b02b")], [f"{b}_8bit" for b in ("b04a", "b03a", "b02a")]
SHOWN = """, v AS (SELECT tile, r, c, abs(coalesce(ndvi_diff, 0)) > CAST(0.15 AS FLOAT) AS changed, b04b, u * 13 % 110 + 500 AS b03b, u * 17 % 90 + 300 AS b02b, b04a, u * 19 % 130 + 550 AS b03a, u * 23 % 70 + 350 AS b02a FROM base),
q AS (SELECT tile, """ + ", ".join(f"quantile_cont(CAST({b} AS DOUBLE), {p}) AS {b}_{n}" for b in ("b04b", "b03b", "b02b", "b04a", "b03a", "b02a") for n, p in (("lo", 0.02), ("hi", 0.98))) + """ FROM v GROUP BY tile),
e AS (SELECT v.tile, r, c, changed, """ + ", ".join(f"CAST(floor(greatest(0e0, least(255e0, ({b} - {b}_lo) / ({b}_hi - {b}_lo) * 255))) AS INTEGER) AS {b}" for b in ("b04b", "b03b", "b02b", "b04a", "b03a", "b02a")) + """ FROM v JOIN q USING (tile)),
pics AS (SELECT tile, count(*) AS items, CAST(sum(b04b + b03b + b02b) AS DOUBLE) AS before_, CAST(sum(b04a + b03a + b02a) AS DOUBLE) AS after_,
  CAST(sum(CASE WHEN changed THEN least(b04b + 150, 255) + b03b * 3 // 10 + b02b * 3 // 10 ELSE b04b + b03b + b02b END) AS DOUBLE) AS overlay FROM e GROUP BY tile)
"""


@query(cased(PX) + SHOWN + "SELECT tile, 'before.png' AS name, items, before_ AS total FROM pics UNION ALL SELECT tile, 'after.png', items, after_ FROM pics UNION ALL SELECT tile, 'overlay.png', items, overlay FROM pics")
def change_images(spark, sf_dir):
    """True-colour images of both dates and the overlay, decoded again: pixels, and the sum of all samples."""
    shown = evidence.rendered(pictured(spark, sf_dir), ["tile"], BEFORE, AFTER, "changed")
    at = facts(F.col("name"), F.col("content"))
    return shown.select("tile", "name", at.alias("f")).select("tile", "name", F.col("f.items").alias("items"), F.col("f.total").alias("total"))


def facts(name, content):
    """items and total of a bundle's file: of an image its pixels and samples, of JSON the findings and their scores, of the index its entries."""

    @F.pandas_udf("items long, total double")
    def run(names, contents):
        import json

        import pandas as pd

        out = []
        for n, raw in zip(names, contents, strict=True):
            if n.endswith(".png"):
                rgb = evidence.unpng(raw)
                out.append((rgb.shape[0] * rgb.shape[1], float(rgb.sum(dtype="int64"))))
                continue
            body = json.loads(raw)
            found = [f["properties"]["score"] for f in body["features"]] if "features" in body else [f["area_ha"] for f in body["findings"]] if "findings" in body else [0.0] * len(body["artifacts"])
            out.append((len(found), round(sum(found), 6)))
        return pd.DataFrame(out, columns=["items", "total"])

    return run(name, content)


def bundled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of every tile's run, and the runs."""
    told, ranked = judged(spark, sf_dir)
    told, ranked = stored(told), stored(ranked)
    shown = evidence.rendered(pictured(spark, sf_dir), ["tile"], BEFORE, AFTER, "changed")
    run_id = F.concat(F.lit("run-"), F.col("tile").cast("string"))
    return evidence.bundles(told, ["tile"], collections(told, ranked), manifests(spark, told, ranked), shown, run_id, "2024-02-01T00:00:00Z"), told


@query(
    RUNS
    + SHOWN
    + """, fs AS (SELECT t.tile, reason, count(k.label) AS n, coalesce(sum(score), 0) AS scores, coalesce(sum(area_ha), 0) AS areas FROM t LEFT JOIN k ON k.tile = t.tile GROUP BY t.tile, reason)
SELECT 'run-' || tile AS run_id, 'findings.geojson' AS name, n AS items, round(scores, 6) AS total FROM fs UNION ALL SELECT 'run-' || tile, 'provenance.json', n, round(areas, 6) FROM fs UNION ALL SELECT 'run-' || tile, 'artifact_index.json', 5, 0e0 FROM fs WHERE reason IS NULL
UNION ALL SELECT 'run-' || tile, name, items, total FROM (SELECT tile, 'before.png' AS name, items, before_ AS total FROM pics UNION ALL SELECT tile, 'after.png', items, after_ FROM pics UNION ALL SELECT tile, 'overlay.png', items, overlay FROM pics) JOIN fs USING (tile) WHERE reason IS NULL"""
)
def evidence_bundle(spark, sf_dir):
    """Every run's bundle written to a folder of its own, then listed and decoded from there."""
    path = scratch(spark)
    files, _ = bundled(spark, sf_dir)
    bundles.write(files, path)
    at = facts(F.col("name"), F.col("content"))
    return bundles.read_files(spark, path).select("run_id", "name", at.alias("f")).select("run_id", "name", F.col("f.items").alias("items"), F.col("f.total").alias("total"))


@query(
    RUNS
    + """, o AS (SELECT k.*, tile % 4 AS portfolio_id FROM k WHERE tile % 5 <> 3)
SELECT portfolio_id, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY tile DESC, finding_id) AS BIGINT) AS place, 'run-' || tile AS run_id, 'run-' || tile AS told_run, finding_id - 1 AS idx, round(score, 6) AS score, round(area_ha, 6) AS area_ha FROM o
UNION ALL SELECT NULL, NULL, 'broken-' || tile, NULL, NULL, NULL, NULL FROM t WHERE tile % 3 = 0"""
)
def findings_store(spark, sf_dir):
    """The findings of the completed runs of each portfolio, from the bundles' files; a third of the runs have a second file that cannot be read."""
    path = scratch(spark)
    files, told = bundled(spark, sf_dir)
    broken = told.where("tile % 3 = 0").select(F.concat(F.lit("broken-"), F.col("tile").cast("string")).alias("run_id"), F.lit("findings.geojson").alias("name"), F.encode(F.when(F.col("tile") % 2 == 0, '{"type": "FeatureColl').otherwise("[]"), "utf-8").alias("content"))
    bundles.write(files.unionByName(broken), path)
    features, unread = bundles.findings_store(spark, path)
    status = F.when(F.col("tile") % 5 == 3, "running").otherwise("completed")
    runs = told.select((F.col("tile") % 4).alias("portfolio_id"), F.concat(F.lit("run-"), F.col("tile").cast("string")).alias("run_id"), status.alias("status"), F.timestamp_seconds(F.col("tile") * 60).alias("created_at"))
    number = lambda c: F.round(F.get_json_object("json", f"$.properties.{c}").cast("double"), 6).alias(c)
    out = bundles.collected(features, runs).select("portfolio_id", "place", "run_id", F.get_json_object("json", "$.properties.run_id").alias("told_run"), "idx", number("score"), number("area_ha"))
    return out.unionByName(unread.select("run_id"), allowMissingColumns=True)
