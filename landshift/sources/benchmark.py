"""A benchmark's directories: examples that have an area and an expected outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def examples(files: DataFrame) -> DataFrame:
    """example (the directory's name), aoi, expected and request of ``path`` and ``content`` rows; directories without either of the first two are left out."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("example"), F.element_at(parts, -1).alias("name"), "content")
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("content")))
    out = named.groupBy("example").agg(one("aoi.geojson").alias("aoi"), one("expected.json").alias("expected"), one("request.json").alias("request"))
    return out.where("aoi IS NOT NULL AND expected IS NOT NULL")


def read_examples(spark: SparkSession, root: str) -> DataFrame:
    """The examples of a directory of directories."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(f"{root.rstrip('/')}/*/*")
    return examples(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
