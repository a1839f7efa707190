"""Sources over files that the tables' rows are written to first: tiled rasters and catalog items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from landshift.operators.storage import scratch
from landshift.plans.raster_queries import PX, raster
from landshift.plans.registry import query
from landshift.plans.scene_queries import SC, catalog
from landshift.sources import bundles, geotiff, stac


def raster_files(spark, sf_dir, path: str) -> None:
    """A file a tile of the raster, at its place in metres; classic and big files, both byte orders, with and without differences."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        t, r, c = int(pdf["tile"].iloc[0]), pdf["r"].to_numpy(), pdf["c"].to_numpy()
        grid = np.zeros((r.max() + 1, 50), np.uint16)
        grid[r, c] = pdf["b08b"].to_numpy()
        raw = geotiff.write_tiff(grid, 16, (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0), deflate=t % 5 > 0, big=t % 2 == 1, predictor=1 + t % 3 % 2, order="<>"[t % 4 // 2])
        return pd.DataFrame({"run_id": [f"tile-{t}"], "name": ["B08.tif"], "content": [raw]})

    files = raster(spark, sf_dir).select("tile", "r", "c", "b08b").groupBy("tile").applyInPandas(one, "run_id string, name string, content binary")
    bundles.write(files, path)


@query(PX + "SELECT tile, r, c, b08b AS value FROM px WHERE r BETWEEN 9 AND 30 AND c BETWEEN 19 AND 41")
def raster_window(spark, sf_dir):
    """A window of every tile's file, of which only the tiles of pixels that meet it are read: 10 m pixels, one around."""
    path = scratch(spark)
    raster_files(spark, sf_dir, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(path).select("path")
    box = (500200.0, 4600000.0 - 300.0, 500410.0, 4600000.0 - 100.0)
    px = geotiff.read_tiles(geotiff.tiles_of(files, box))
    tile = F.regexp_extract("path", r"tile-(\d+)/", 1).cast("long")
    return px.select(tile.alias("tile"), "r", "c", F.col("value").cast("long").alias("value"))


@query(SC + "SELECT event_id, epoch_us(ts) AS ts_us, round(cloud, 4) AS cloud, 's3://b/' || event_id || '/red.tif' AS red, CASE WHEN event_id % 3 > 0 THEN 's3://b/' || event_id || '/scl.tif' END AS scl FROM st WHERE event_id % 7 <> 0")
def catalog_items(spark, sf_dir):
    """Scenes written as item collections, a file for every hundred, and decoded again; every seventh lacks its geometry."""
    path, k = scratch(spark), F.col("event_id")
    href = lambda name: F.struct(F.concat(F.lit("s3://b/"), k.cast("string"), F.lit(f"/{name}.tif")).alias("href"))
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    props = F.struct(when.alias("datetime"), F.col("cloud").alias("eo:cloud_cover"))
    shape = F.when(k % 7 != 0, F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("coordinates")))
    item = F.struct(k.cast("string").alias("id"), props.alias("properties"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"), shape.alias("geometry"), F.struct(href("red").alias("red"), href("thumb").alias("thumbnail"), F.when(k % 3 > 0, href("scl")).alias("scl")).alias("assets"))
    pages = catalog(spark, sf_dir).groupBy(F.expr("event_id div 100").alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("features"))).alias("value"))
    pages.select("value").write.option("lineSep", "\n").text(path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", stac.COLLECTION)["features"]).alias("item")).select("item.*")
    out = stac.decoded(lines)
    return out.select(F.col("scene_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("ts_us"), F.round("cloud", 4).alias("cloud"), F.col("bands")["B04"].alias("red"), F.col("scl_url").alias("scl"))
