"""Catalog items: decoding of item collections, and a data source that asks a catalog window by window."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Names of a catalog's assets and the bands they hold.
ASSET_BANDS = {
    "coastal": "B01", "blue": "B02", "green": "B03", "red": "B04", "rededge1": "B05", "rededge2": "B06",
    "rededge3": "B07", "nir": "B08", "nir08": "B8A", "swir16": "B11", "swir22": "B12",
}
#: Seconds before the second and third attempt are RETRY_S and twice that.
ATTEMPTS, RETRY_S = 3, 2.0

COLLECTION = "features array<struct<id: string, properties: struct<datetime: string, `eo:cloud_cover`: double>, bbox: array<double>, geometry: string, assets: map<string, struct<href: string>>>>"


def decoded(items: DataFrame) -> DataFrame:
    """Scenes of items; one without datetime, box or geometry is dropped, a naive datetime is UTC, a missing cloud is 0."""
    stamp = F.col("properties.datetime")
    zoned = F.when(stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    names = F.create_map(*[F.lit(x) for kv in ASSET_BANDS.items() for x in kv])
    known = F.map_filter("assets", lambda k, v: names[k].isNotNull())
    bands = F.transform_values(F.transform_keys(known, lambda k, v: names[k]), lambda k, v: v["href"])
    out = items.where(stamp.isNotNull() & F.col("bbox").isNotNull() & F.col("geometry").isNotNull())
    return out.select(
        F.col("id").alias("scene_id"), F.try_to_timestamp(zoned).alias("ts"), "bbox", F.col("geometry").alias("footprint"), bands.alias("bands"),
        F.get(F.filter(F.array(F.element_at("assets", "scl")["href"]), lambda x: x.isNotNull()), F.lit(0)).alias("scl_url"), F.coalesce(F.col("properties.`eo:cloud_cover`"), F.lit(0.0)).alias("cloud"),
    ).where("ts IS NOT NULL")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of collection files (``{"features": [...]}``)."""
    raw = spark.read.text(path, wholetext=True)
    features = F.from_json("value", COLLECTION)
    return raw.select(F.explode(features["features"]).alias("item")).select("item.*")


def area_of(text: Column) -> Column:
    """The geometry of a GeoJSON text: of the first feature, of the feature, or the text itself; NULL beyond 10 MB or without a type."""
    found = F.coalesce(F.get_json_object(text, "$.features[0].geometry"), F.get_json_object(text, "$.geometry"), text)
    return F.when((F.length(text) <= 10_000_000) & F.get_json_object(text, "$.type").isNotNull(), found)


def with_retry(call: Callable[[], list], wait: Callable[[float], None] = time.sleep) -> list:
    """Three attempts against a network that may fail."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except (ConnectionError, TimeoutError, OSError) as e:
            if attempt == ATTEMPTS - 1:
                raise ConnectionError(f"catalog search failed: {e}") from e
            wait(RETRY_S * 2**attempt)
    return []


class Window(InputPartition):
    def __init__(self, path: str, low: str | None, high: str | None, limit: int):
        self.path, self.low, self.high, self.limit = path, low, high, limit


class CatalogReader(DataSourceReader):
    """A partition a catalog page (``paths``).

    The window is an option (``from``, ``to``), not a pushed filter: this Spark keeps what a
    query pushed with the loaded table, so a second query on it would lose rows.
    """

    def __init__(self, options: dict[str, str]):
        self.paths, self.limit = options["paths"].split(","), int(options.get("limit", 1 << 30))
        self.low, self.high = options.get("from"), options.get("to")

    def partitions(self) -> list[Window]:
        return [Window(p, self.low, self.high, self.limit) for p in self.paths]

    def read(self, partition: Window) -> Iterator[tuple]:
        def page() -> list:
            with open(partition.path, encoding="utf-8") as f:
                return json.load(f)["features"]

        n = 0
        for x in with_retry(page):
            day = ((x.get("properties") or {}).get("datetime") or "")[:10]
            if (partition.low and day < partition.low) or (partition.high and day > partition.high):
                continue
            if (n := n + 1) > partition.limit:
                return
            yield x.get("id"), day, json.dumps(x)


class CatalogSource(DataSource):
    """``spark.read.format("landshift_catalog").option("paths", "a.json,b.json")``: id, day and the item's JSON."""

    @classmethod
    def name(cls) -> str:
        return "landshift_catalog"

    def schema(self) -> str:
        return "id string, day string, item string"

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(self.options)
