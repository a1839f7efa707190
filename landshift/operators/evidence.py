"""Evidence of runs: GeoJSON, provenance, API responses, artifact index, images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.functions import indices

#: Names of artifacts that may be fetched.
ARTIFACTS = ("findings.geojson", "provenance.json", "artifact_index.json", "true_color.png", "change_overlay.png")


def feature_collections(found: DataFrame, keys: list[str], properties: list[str], runs: DataFrame | None = None) -> DataFrame:
    """One FeatureCollection a run; features in the order of ``finding_id``.  A run has a bounded number of findings; one of ``runs`` without any has an empty collection."""
    feature = F.struct(
        F.col("finding_id").alias("id"),
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(feature)).alias("features"))
    if runs is not None:
        listed = runs.select(*keys).join(listed, keys, "left")
    none = F.lit('{"type":"FeatureCollection","features":[]}')
    body = F.when(F.col("features").isNull(), none).otherwise(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")))
    return listed.select(*keys, F.coalesce(F.size("features"), F.lit(0)).cast("long").alias("n_features"), body.alias("geojson"))


def provenance(runs: DataFrame, keys: list[str], software: dict[str, str]) -> DataFrame:
    """One manifest a run from ``reason`` (null: findings) and ``n_findings``; nulls are written."""
    versions = F.struct(*[F.lit(v).alias(k) for k, v in software.items()])
    abstention = F.when(F.col("reason").isNotNull(), F.struct(F.col("reason").alias("reason")))
    body = F.struct(versions.alias("software"), F.col("n_findings"), abstention.alias("abstention"))
    return runs.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("provenance"))


#: The measures of a finding that its evidence states, and the names of a run's images by their use.
MEASURES = ("ndvi_delta_mean", "nbr_delta_mean", "pixel_delta_mean", "valid_pixels_in_finding")
IMAGES = {"before_image": "before.png", "after_image": "after.png", "overlay": "overlay.png"}


def manifests(runs: DataFrame, found: DataFrame, keys: list[str], software: dict[str, str], config: dict[str, str | float | int], models: tuple[str, ...] = ("deterministic-v1",), sources: str | None = None) -> DataFrame:
    """The whole provenance of each run: versions, models, artifacts, findings with their metrics, processing, sources and abstention; nulls are written.

    ``found`` has finding_id, score, area_ha and MEASURES; ``sources`` names a struct column of
    ``runs``.  An abstained run lists no findings, and no processing that did not take place.
    """
    one = F.struct(F.col("finding_id").alias("id"), "score", "area_ha", F.struct(*MEASURES).alias("metrics"))
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_findings"))
    all_ = runs.join(listed, keys, "left")
    none = F.filter(F.array(F.lit(None).cast(listed.schema["_findings"].dataType.elementType)), lambda x: x.isNotNull())
    abstains = F.col("reason").isNotNull()
    names = F.struct(*(F.lit(v).alias(k) for k, v in (IMAGES | {"findings": "findings.geojson"}).items()))
    parts = [
        F.struct(*(F.lit(v).alias(k) for k, v in software.items())).alias("software"),
        F.array(*map(F.lit, models)).alias("model_versions"),
        names.alias("artifacts"),
        F.when(abstains | F.col("_findings").isNull(), none).otherwise(F.col("_findings")).alias("findings"),
        F.when(~abstains, F.struct(*(F.lit(v).alias(k) for k, v in config.items()))).alias("processing_config"),
        *([F.when(~abstains, F.col(sources)).alias("sources")] if sources else []),
        F.when(abstains, F.struct(F.col("reason").alias("reason"))).alias("abstention"),
    ]
    return all_.select(*keys, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("provenance"))


def api_response(runs: DataFrame, found: DataFrame, keys: list[str], encoder: str = "deterministic-v1", base: str = "") -> DataFrame:
    """Status, findings under their public names (hectares to square metres, evidence, model) and artifact paths of each run; an abstained run has neither findings nor artifacts.

    Columns that ``found`` lacks (geometry, ndvi_delta_mean, nbr_delta_mean) are null.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in found.columns else F.lit(None).cast(kind)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")) if "ring" in found.columns else F.lit(None).cast("struct<type: string, coordinates: array<array<array<double>>>>")
    one = F.struct(
        F.col("finding_id"), F.col("score").alias("change_score"), (F.col("area_ha") * 10000).alias("changed_area_m2"), F.lit(None).cast("string").alias("suggested_class"),
        F.struct(have("ndvi_delta_mean", "double").alias("ndvi_delta"), have("nbr_delta_mean", "double").alias("nbr_delta")).alias("evidence"),
        F.struct(F.lit(encoder).alias("encoder"), F.lit(None).cast("double").alias("confidence")).alias("model"), geometry.alias("geometry"),
    )
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("findings"))
    out = runs.select(*keys, "status").join(listed, keys, "left")
    none = F.filter(F.array(F.lit(None).cast(listed.schema["findings"].dataType.elementType)), lambda x: x.isNotNull())
    abstains = F.col("status") == "abstained"
    folder = F.concat(F.lit(base), F.concat_ws("/", *keys), F.lit("/"))
    paths = F.struct(*(F.concat(folder, F.lit(v)).alias(k.removesuffix("_image")) for k, v in IMAGES.items()))
    return out.withColumns({"findings": F.when(abstains | F.col("findings").isNull(), none).otherwise(F.col("findings")), "artifacts": F.when(~abstains, paths)})


def artifact_index(files: DataFrame) -> DataFrame:
    """name, size and, of JSON files, ``sha256:`` and the digest; from name and content."""
    digest = F.when(F.col("name").endswith("json"), F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    return files.select("name", F.octet_length("content").cast("long").alias("size"), digest.alias("sha256"))


def fetchable(name: Column) -> Column:
    return name.isin(*ARTIFACTS)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image of (height, width, 3)."""
    rows = np.concatenate([np.zeros((len(rgb), 1), np.uint8), rgb.reshape(len(rgb), -1).astype(np.uint8)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(image: bytes) -> np.ndarray:
    """The samples of an image that ``png`` made."""
    at, data = 8, b""
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width * 3 + 1)[:, 1:].reshape(height, width, 3)


def images(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One PNG a grid from red, green and blue columns of 0-255; a grid (an AOI of bounded area) is one group."""
    fields = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy() - pdf["r"].min(), pdf["c"].to_numpy() - pdf["c"].min()
        rgb = np.zeros((r.max() + 1, c.max() + 1, 3), np.uint8)
        rgb[r, c] = pdf[["red", "green", "blue"]].to_numpy()
        return pdf[keys].head(1).assign(height=[rgb.shape[0]], width=[rgb.shape[1]], png=[png(rgb)])

    return pixels.select(*keys, "r", "c", "red", "green", "blue").groupBy(*keys).applyInPandas(one, f"{fields}, height int, width int, png binary")


def rendered(pixels: DataFrame, keys: list[str], before: list[str], after: list[str], changed: str) -> DataFrame:
    """before.png, after.png and overlay.png of each grid from 8-bit columns of red, green and blue; a grid (an AOI of bounded area) is one group."""
    colours = ("red", "green", "blue")
    shown = [indices.overlay(F.col(b), F.col(changed), k == "red") for b, k in zip(before, colours, strict=True)]
    cols = [*(F.col(b).alias(f"b_{k}") for b, k in zip(before, colours, strict=True)), *(F.col(a).alias(f"a_{k}") for a, k in zip(after, colours, strict=True)), *(x.alias(f"o_{k}") for x, k in zip(shown, colours, strict=True))]
    fields = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy() - pdf["r"].min(), pdf["c"].to_numpy() - pdf["c"].min()
        out = []
        for p in "bao":
            rgb = np.zeros((r.max() + 1, c.max() + 1, 3), np.uint8)
            rgb[r, c] = pdf[[f"{p}_{k}" for k in colours]].to_numpy()
            out.append(png(rgb))
        return pd.concat([pdf[keys].head(1)] * 3).assign(name=list(IMAGES.values()), content=out)

    return pixels.select(*keys, "r", "c", *cols).groupBy(*keys).applyInPandas(one, f"{fields}, name string, content binary")


def bundles(runs: DataFrame, keys: list[str], collections: DataFrame, manifests_: DataFrame, images_: DataFrame, run_id: Column, created_at: str) -> DataFrame:
    """The files of every run: ``run_id``, ``name`` and ``content``.

    GeoJSON and provenance for all; images and the index, which tells names, sizes and (of JSON)
    checksums, for those that don't abstain.
    """
    named = runs.select(*keys, "status", run_id.alias("run_id"))
    text = lambda df, column, name: df.select(*keys, F.lit(name).alias("name"), F.encode(column, "utf-8").alias("content"))
    always = text(collections, "geojson", "findings.geojson").unionByName(text(manifests_, "provenance", "provenance.json")).join(named, keys)
    shown = images_.join(named.where("status <> 'abstained'"), keys)
    files = always.unionByName(shown).select("run_id", "status", "name", "content")
    facts = files.where("status <> 'abstained'").select("run_id", "name", F.octet_length("content").alias("size"), F.when(F.col("name").endswith("json"), F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("sha256"))
    entries = F.array_sort(F.collect_list(F.struct("name", "size", "sha256")))  # five a run
    index = facts.groupBy("run_id").agg(entries.alias("artifacts")).withColumn("created_at", F.lit(created_at))
    body = F.encode(F.to_json(F.struct("run_id", "created_at", "artifacts")), "utf-8")
    return files.select("run_id", "name", "content").unionByName(index.select("run_id", F.lit("artifact_index.json").alias("name"), body.alias("content")))


def directory_sizes(files: DataFrame) -> DataFrame:
    """``mb`` of each ``directory`` by the ``length`` of its files, in millions of bytes."""
    return files.groupBy("directory").agg((F.sum("length") / 1e6).alias("mb"))
