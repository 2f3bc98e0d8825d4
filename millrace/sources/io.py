"""Sources and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below the one the session names, or a local one if all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    top = named.rstrip("/") if named else "file://" + tempfile.gettempdir()
    return f"{top}/millrace-{name}/{uuid.uuid4().hex}"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Title and body of a JSON-lines corpus with one ``contents`` string per row; ``doc_id`` if the rows have one."""
    rows = spark.read.schema("doc_id bigint, contents string").json(path)
    return rows.select("doc_id", F.substring_index("contents", "\n", 1).alias("title"), F.regexp_replace("contents", r"(?s)\A[^\n]*\n?", "").alias("body"))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Union by name of several Parquet tables; a column one lacks is null there."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def project(df: DataFrame, **keys: str) -> DataFrame:
    """Nested fields by dotted name, under plain names."""
    return df.select(*[F.col(k).alias(name) for name, k in keys.items()])


def preference_rows(df: DataFrame) -> DataFrame:
    """``(prompt, side, response)``: chosen, then rejected, of each pair."""
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("response")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("response")))
    return df.select("prompt", F.posexplode(sides).alias("pos", "x")).select("prompt", "pos", "x.side", "x.response")


def write_tasks(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, a folder per value of ``by`` where one is given."""
    out = df.write.partitionBy(by) if by else df.write
    out.json(path)


def encode(df: DataFrame, encoder: Callable[[pd.Series], pd.Series], text_col: str = "text", prefix: str = "passage: ", normalise: bool = True) -> DataFrame:
    """Vectors of prefixed texts by a pluggable batch encoder; a failing encoder fails the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=list(encoder(prefix + pdf[text_col].fillna(""))))

    out = df.mapInPandas(run, StructType([*df.schema.fields, StructField("v", ArrayType(DoubleType()))]))
    if not normalise:
        return out
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("v", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))))


def build_index(docs: DataFrame, path: str, encoder: Callable[[pd.Series], pd.Series], id_col: str = "doc_id", text_col: str = "text", prefix: str = "passage: ") -> DataFrame:
    """The dense index of a corpus: a Parquet table of ids and unit vectors, written once and read back."""
    vectors = encode(docs.select(id_col, text_col), encoder, text_col, prefix).select(id_col, F.col("v").cast("array<float>").alias("v"))
    vectors.write.parquet(path)
    return docs.sparkSession.read.schema(vectors.schema).parquet(path)


def mean_pool(vectors: str, mask: str):
    """Mean of token vectors where the mask is set, as a fold."""
    cells = F.filter(F.arrays_zip(F.col(vectors).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1)
    zero = F.transform(F.get(F.col(vectors), F.lit(0)), lambda x: x * 0.0)
    total = F.aggregate(cells, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(cells), F.lit(1)))
