"""Evidence bundles as folders: a data source that writes them, and the findings store that reads them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: A feature of a run's findings; unknown members are left aside.
FEATURE = "struct<id: long, type: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>, properties: map<string, double>>"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its own folder and the runs in it."""

    folder: str
    runs: list[str]


class BundleWriter(DataSourceWriter):
    """A folder a run.  Tasks write aside; the commit renames what the successful attempts wrote, and takes all of it back if one rename fails."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.stage = f"{self.path}/.staged-{uuid.uuid4().hex}"

    def store(self, path: str):
        """The file system of a path or URI, and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, runs = f"{self.stage}/{uuid.uuid4().hex}", {}
        files, at = self.store(folder)
        for row in iterator:
            run, name = row["run_id"], row["name"]
            if not run or not name or any(x in ("", ".", "..") or "/" in x or "\\" in x for x in (run, name)):
                raise ValueError(f"no file name: {run!r} {name!r}")
            if run not in runs:
                files.create_dir(f"{at}/{run}", recursive=True)
                runs[run] = True
            with files.open_output_stream(f"{at}/{run}/{name}") as out:
                out.write(bytes(row["content"]))
        return Staged(folder, list(runs))

    def commit(self, messages: list[Staged | None]) -> None:
        files, home = self.store(self.path)
        _, stage = self.store(self.stage)
        from pyarrow import fs

        done, old = [], f"{stage}/replaced"
        try:
            seen = set()
            for m in messages:
                for run in m.runs if m else ():
                    if run in seen:
                        raise ValueError(f"run {run} comes from two tasks: repartition by run_id")
                    seen.add(run)
                    if files.get_file_info(f"{home}/{run}").type != fs.FileType.NotFound:
                        if not self.overwrite:
                            raise FileExistsError(f"{home}/{run}")
                        files.create_dir(old, recursive=True)
                        files.move(f"{home}/{run}", f"{old}/{run}")
                        done.append((f"{old}/{run}", f"{home}/{run}"))
                    at = self.store(f"{m.folder}/{run}")[1]
                    files.move(at, f"{home}/{run}")
                    done.append((f"{home}/{run}", at))
        except Exception:
            for now, before in reversed([(a, b) for a, b in done]):
                files.move(now, before)
            self.abort(messages)
            raise
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, stage = self.store(self.stage)
        from pyarrow import fs

        if files.get_file_info(stage).type != fs.FileType.NotFound:
            files.delete_dir(stage)


class BundleSource(DataSource):
    """``df.write.format("landshift_bundle").mode("append").save(path)``; rows are run_id, name, content, those of a run in one task.  ``overwrite`` replaces the runs that it writes."""

    @classmethod
    def name(cls) -> str:
        return "landshift_bundle"

    def schema(self) -> str:
        return "run_id string, name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], overwrite)


def write(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes the files (run_id, name, content) of runs to a folder each, all runs or none."""
    files.sparkSession.dataSource.register(BundleSource)
    files.select("run_id", "name", "content").repartition("run_id").write.format("landshift_bundle").mode(mode).save(path)


def read_files(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """run_id, name, content of the files in a folder of bundles; what is still being written is hidden, and a file that goes missing is passed over."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", name).option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").load(path)
    part = F.split("path", "/")
    out = raw.select(F.element_at(part, -2).alias("run_id"), F.element_at(part, -1).alias("name"), "content", "length", F.element_at(part, -4).alias("_above"))
    return out.where(~F.coalesce(F.col("_above"), F.lit("")).startswith(".staged-")).drop("_above")


def findings_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The features of every run's findings, and the runs whose file could not be read.

    A feature's row has ``run_id``, ``idx`` (its place in the file) and the ``feature``, whose
    properties get the run's id when it is written out.  A file that is no JSON, or no
    FeatureCollection, is passed over and listed; one of no bytes at all Spark does not show.
    """
    files = read_files(spark, path, "findings.geojson").select("run_id", F.decode("content", "utf-8").alias("text"))
    body = F.from_json("text", f"struct<type: string, features: array<{FEATURE}>>", {"mode": "PERMISSIVE"})
    parsed = files.withColumn("body", body)
    whole = F.coalesce((F.col("body.type") == "FeatureCollection") & F.col("body.features").isNotNull(), F.lit(False))
    features = parsed.where(whole).select("run_id", F.posexplode("body.features").alias("idx", "feature"))
    return features, parsed.where(~whole).select("run_id")


def collected(features: DataFrame, runs: DataFrame) -> DataFrame:
    """The features of the completed runs of each portfolio, newest run first, each with its run's id among the properties.

    ``runs`` has portfolio_id, run_id, status, created_at.  A row a feature: portfolio_id,
    ``place`` (within the portfolio, from 1), run_id, idx and ``json``.  The place comes from the
    numbers of features of earlier runs, so no task holds a portfolio's features.
    """
    from pyspark.sql import Window

    done = runs.where("status = 'completed'").select("portfolio_id", "run_id", "created_at")
    sizes = features.groupBy("run_id").agg(F.count("*").alias("n")).join(done, "run_id")
    earlier = Window.partitionBy("portfolio_id").orderBy(F.desc("created_at"), "run_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("portfolio_id", "run_id", "start")
    numbers = F.to_json("feature.properties")
    props = F.concat(F.when(F.coalesce(F.size("feature.properties"), F.lit(0)) > 0, F.concat(F.expr("substr(numbers, 1, length(numbers) - 1)"), F.lit(","))).otherwise("{"), F.lit('"run_id":'), F.to_json(F.array("run_id")).substr(F.lit(2), F.length(F.to_json(F.array("run_id"))) - 2), F.lit("}"))
    met = features.join(starts, "run_id").withColumn("numbers", numbers)
    json = F.concat(F.lit('{"type":"Feature","geometry":'), F.to_json("feature.geometry"), F.lit(',"properties":'), props, F.lit("}"))
    return met.select("portfolio_id", (F.col("start") + F.col("idx") + 1).alias("place"), "run_id", "idx", json.alias("json"), "feature")
