"""Sampling with feedback: groups are drawn by weights that follow the scores of the batches before.

Weights are a versioned table: ``version=0`` is the start, and each batch adds
the next one, so a run goes on from its last whole version and any earlier
one can be read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_unit(salt: str, id_col: str) -> Column:
    """A number between 0 and 1, exclusive, from a row's id."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), id_col)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


class Curriculum:
    """Weights of groups in ``path``; ``floor`` keeps every group alive, ``rate`` is how fast weights follow scores."""

    SCHEMA = "grp string, weight double"

    def __init__(self, spark: SparkSession, path: str, rate: float = 0.5, floor: float = 0.05):
        if not (0 < rate <= 1 and floor > 0):
            raise ValueError("rate must be in (0, 1] and floor over 0")
        self.spark, self.path, self.rate, self.floor = spark, path, rate, floor

    def weights(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/version={version}")

    def _write(self, weights: DataFrame, version: int) -> None:
        weights.select("grp", "weight").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def start(self, rows: DataFrame, group: str) -> None:
        """Equal weights for all groups of ``rows``."""
        self._write(rows.select(F.col(group).cast("string").alias("grp")).where("grp IS NOT NULL").distinct().withColumn("weight", F.lit(1.0)), 0)

    def sample(self, rows: DataFrame, group: str, n: int, version: int, id_col: str = "row_id", seed: int = 0) -> DataFrame:
        """``n`` rows without replacement, a row's chance in proportion to its group's weight; rows of no known group are never drawn.

        Each row gets an exponential arrival time with its weight as rate, and
        the first ``n`` arrive: one pass, with ``n`` rows a task at most.
        """
        known = rows.join(self.weights(version), F.col(group).cast("string") == F.col("grp"))
        arrival = -F.ln(hashed_unit(f"{seed}|{version}", id_col)) / F.col("weight")
        return known.withColumn("__at", arrival).orderBy("__at", id_col).limit(n).drop("__at", "grp", "weight")

    def update(self, batch: DataFrame, group: str, score: Column, version: int) -> None:
        """The next version: weights move towards the share of the batch that a group did not score; groups without rows keep theirs."""
        seen = batch.groupBy(F.col(group).cast("string").alias("grp")).agg(F.avg(score).alias("mean"))
        moved = (1 - self.rate) * F.col("weight") + self.rate * (1 - F.col("mean"))
        new = self.weights(version).join(seen, "grp", "left").select("grp", F.when(F.col("mean").isNull(), F.col("weight")).otherwise(F.greatest(moved, F.lit(self.floor))).alias("weight"))
        self._write(new, version + 1)


__all__ = ["Curriculum"]
