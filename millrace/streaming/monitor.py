"""Streams: accumulation until a target, per-source counters and windowed monitoring.

All run over file sources with checkpoints, so a restart resumes where the
last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accumulate(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame], target: int, per_batch: int = 1, order: str | None = None) -> int:
    """Filter batches of new files into ``sink`` until it has ``target`` rows; returns how many it has.

    Every batch writes its own folder, replaced if the batch is run again, so
    a retry after a failure never adds rows twice, and notes its count beside
    it: what is there already is never counted again.  With ``order`` the
    batch that passes the target keeps its first rows only, so that there are
    exactly ``target``; without, it keeps them all.
    """
    notes = f"{sink}/counts"

    def have(before: int) -> int:
        try:
            rows = spark.read.schema("batch long, n long").json(f"{notes}/*").where(F.col("batch") < before)
            return rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        except AnalysisException as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def take(batch: DataFrame, number: int) -> None:
        left = target - have(number)
        if left <= 0:
            return
        kept = keep(batch)
        if order is not None:
            kept = kept.orderBy(order).limit(left)
        path = f"{sink}/batch={number}"
        kept.write.mode("overwrite").parquet(path)
        n = spark.read.schema(kept.schema).parquet(path).count()  # from the files' footers
        spark.createDataFrame([(number, n)], "batch long, n long").coalesce(1).write.mode("overwrite").json(f"{notes}/{number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return have(2**62)


def capped_by_source(rows: DataFrame, most: int, source: str = "source", id_col: str = "row_id") -> DataFrame:
    """``(source, row_id)`` of the first ``most`` rows of each source over all batches of a stream, by id within a batch.

    A task holds as many rows as a source still lacks, however many pieces
    its rows of a batch come in.
    """

    def run(key: tuple, batches, state: GroupState):
        n = state.get[0] if state.exists else 0
        first = None
        for pdf in batches:
            some = pdf[[source, id_col]]
            some = some if first is None else pd.concat([first, some])
            first = some.sort_values(id_col, kind="stable").head(max(0, most - n))
        if first is not None and len(first):
            n += len(first)
            yield first
        state.update((n,))

    return rows.groupBy(source).applyInPandasWithState(run, f"{source} string, {id_col} long", "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_rewards(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean score of each source and window of event time; later rows than the watermark are dropped when streaming."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def rounds(initial: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: str, most: int, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Lockstep multi-turn loop: rows not done take another step, until none is left or the budget ends.

    ``save`` writes an intermediate and reads it back, which cuts lineage.
    """
    active, finished = initial, None
    for turn in range(most):
        active = save(step(active, turn), f"turn{turn}")
        out = active.where(done)
        finished = out if finished is None else finished.unionByName(out)
        active = active.where(f"NOT ({done})")
        if not active.limit(1).count():
            break
    return finished.unionByName(active) if finished is not None else active


__all__ = ["accumulate", "capped_by_source", "rounds", "windowed_rewards"]
