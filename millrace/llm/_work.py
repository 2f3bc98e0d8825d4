"""Shared working storage for the multi-step operators of this subpackage.

Intermediate tables live below the folder the session names in
``spark.checkpoint.dir``; only where that is unset (tests, notebooks) a
folder of our own is made.  Every intermediate is an ordinary Parquet table:
it cuts lineage, survives the loss of an executor and is visible to all
executors and the driver.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_to_delete: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dir:
        _own_dir[key] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _own_dir[key]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table, below the application's folder, which goes when the driver ends."""
    top = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if top not in _to_delete:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _to_delete.add(top)
    return f"{top}/{uuid.uuid4().hex}/{name}"


_WHILE_WRITING = {
    # Shuffle files of a query go when it ends: what is written as a table needs them no more.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Long texts make large batches: bound them by bytes, on both sides of a worker's pipe.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


@contextlib.contextmanager
def _bounded(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, with more options for the writer, and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _bounded(spark):
        df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, dealt by ``key`` into as many files as a shuffle has partitions, so joins on it ship the other side only."""
    spark = df.sparkSession
    table = f"millrace_{name}_{uuid.uuid4().hex}"
    with _bounded(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("compression", "zstd").option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files, which are outside the warehouse, stay
    return out


def slices(texts: pa.Array, size: int):
    """``(first, count)`` of runs of rows of about ``size`` bytes of text; a longer text is a run of its own."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        done = total[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(total, done + size, side="right")))
        yield first, stop - first
        first = stop


def flat_bytes(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, uncopied, and where each row begins and the last ends."""
    at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    raw = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, so other columns of the input can never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fits(df: DataFrame, rows: int, arrays: str | None = None) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counting the elements of an array column too where one is named."""
    if arrays is None:
        return df.count() <= rows
    return df.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.greatest(F.size(arrays), F.lit(0))), F.lit(0))).first()[0] <= rows
