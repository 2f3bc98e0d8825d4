"""Tools with state: an instance per trajectory that lives from its first call to its release.

Calls arrive as a stream.  The state of a trajectory is a value (calls, reward,
time of the last call) and a map (calls of each tool), and a timer ends
instances that nobody releases.  An instance that is idle for too long is over
whether the next call or the watermark shows it first, so results do not
depend on how the stream is cut into batches.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "trajectory long, first_call long, calls int, tools int, reward double, outcome string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ToolProcessor(StatefulProcessor):
    """Creates, executes, rewards and releases; ``idle_ms`` without a call ends an instance."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "first_call long, calls int, reward double, last_ms long")
        self.per_tool = handle.getMapState("per_tool", "tool string", "calls int")

    def _row(self, key, outcome: str) -> dict:
        first, calls, reward, _ = self.life.get()
        return {"trajectory": key, "first_call": first, "calls": calls, "tools": sum(1 for _ in self.per_tool.keys()), "reward": reward, "outcome": outcome}

    def _end(self, key, outcome: str) -> dict:
        row = self._row(key, outcome)
        self.handle.deleteTimer(self.life.get()[3] + self.idle_ms)
        self.life.clear()
        self.per_tool.clear()
        return row

    def _execute(self, call_id: int, tool: str, reward: float, at_ms: int) -> None:
        if self.life.exists():
            first, calls, total, last = self.life.get()
            self.handle.deleteTimer(last + self.idle_ms)
        else:  # create
            first, calls, total = call_id, 0, 0.0
        self.life.update((first, calls + 1, total + reward, at_ms))
        known = self.per_tool.getValue((tool,))[0] if self.per_tool.containsKey((tool,)) else 0
        self.per_tool.updateValue((tool,), (known + 1,))
        self.handle.registerTimer(at_ms + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "call_id"])  # of one trajectory in one batch
        out = []
        for call in calls.itertuples(index=False):
            at_ms = int(call.at.timestamp() * 1000)
            if self.life.exists() and at_ms - self.life.get()[3] > self.idle_ms:
                out.append(self._end(key[0], "expired"))
            if call.action == "execute":
                self._execute(int(call.call_id), call.tool, float(call.reward), at_ms)
            elif self.life.exists():
                out.append(self._end(key[0], "released"))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists() and self.life.get()[3] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            row = self._row(key[0], "expired")
            self.life.clear()
            self.per_tool.clear()
            yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def tool_instances(calls: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """Ended instances of a stream ``(trajectory, call_id, at, action, tool, reward)``; ``action`` is ``execute`` or ``release``.

    Releasing nothing does nothing.  Instances still open when the stream
    ends give no row until it goes on.
    """
    timed = calls.withWatermark("at", late)
    return timed.groupBy("trajectory").transformWithStateInPandas(statefulProcessor=ToolProcessor(idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


@contextlib.contextmanager
def state_with_columns(spark: SparkSession):
    """Queries started inside keep their state in the store that value, map and timer state need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_tools(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, idle_ms: int) -> DataFrame:
    """All calls in ``source`` so far, from where the checkpoint ended; returns the ended instances in ``sink``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with state_with_columns(spark):
        tool_instances(rows, idle_ms).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(sink)


__all__ = ["ToolProcessor", "run_tools", "state_with_columns", "tool_instances"]
