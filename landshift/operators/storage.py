"""Tables between the steps of a job, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; Hadoop deletes it when the driver ends.  Only a machine alone may do without that setting."""
    sc = spark.sparkContext
    home = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not home:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("name a folder that the cluster shares in spark.checkpoint.dir")
        import tempfile

        home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(home)
    path = f"{home.rstrip('/')}/step-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back: cuts lineage, and outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
