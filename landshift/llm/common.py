"""Helpers that the operators share: text batches, words and scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as Python objects at one time.
SLICE_BYTES = 2_000_000

#: Lower-cases A-Z and turns every other ASCII byte that is not 0-9 or a-z into a space.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
#: Lower-cases A-Z only.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (and the named columns) alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece has much more than ``most`` bytes of text (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most)))
        yield batch.slice(start, stop - start)
        start = stop


def arrow(schema: str) -> pa.Schema:
    """On the driver: the Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list[bytes | None]], dict]], schema: str) -> DataFrame:
    """Runs ``make()(batch, texts as UTF-8)`` over slices of every partition.

    ``make`` runs once in each task, so caches and models built there are shared by the
    task's batches.  The function returns columns by name.
    """
    to = arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in slices(whole):
                cols = f(batch, batch.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, to.field(k).type) for k, x in ((n, cols[n]) for n in to.names)],
                    schema=to,
                )

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list[bytes | None]], dict]], added: str) -> DataFrame:
    """Like ``map_texts``, but the rows keep all their columns and get (or change) those of ``added``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(added)
    schema = StructType([f for f in df.schema if f.name not in more.names] + list(more))
    to = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for batch in slices(whole):
                cols = f(batch, batch.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], to.field(n).type) if n in cols else batch.column(n).cast(to.field(n).type) for n in to.names], schema=to)

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(flat: np.ndarray, counts: Iterable[int], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def trained_on(doc_id: Column) -> Column:
    """True for the rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; Hadoop deletes it when the driver ends."""
    sc = spark.sparkContext
    home = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not home:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("name a folder that the cluster shares in spark.checkpoint.dir")
        import tempfile

        home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine alone, as in tests
        sc.setCheckpointDir(home)
    path = f"{home.rstrip('/')}/landshift-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
