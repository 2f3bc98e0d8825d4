"""Stages run one after the other, each from the table that the one before it left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(rows: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """The last stage's table; a stage whose table is complete is not run again.

    A table is complete when its writer's job has committed, which leaves a
    marker file; one that failed midway has none and is written anew.
    """
    spark = rows.sparkSession
    for k, (name, stage) in enumerate(stages):
        at = f"{folder}/{k:02d}-{name}"
        if not _done(spark, at):
            stage(rows).write.mode("overwrite").parquet(at)
        rows = spark.read.parquet(at)
    return rows


def _done(spark, at: str) -> bool:
    try:
        spark.read.format("binaryFile").load(f"{at}/_SUCCESS").select("length").limit(1).count()
    except AnalysisException:
        return False
    return True
