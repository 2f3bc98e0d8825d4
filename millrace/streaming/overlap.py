"""Two stages over a sequence of batches, the first of one batch beside the second of the batch before."""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame], DataFrame]
_END = object()


def overlapped(spark: SparkSession, batches: Iterable[DataFrame], first: Stage, second: Stage, save: Callable[[DataFrame, str], DataFrame], ahead: int = 1) -> list[DataFrame]:
    """``second(first(batch))`` of every batch in order.

    Both stages are jobs of their own scheduler pool (``first``, ``second``).
    ``first`` runs at most ``ahead`` batches ahead of ``second``.  ``save``
    writes a stage's rows and reads them back.  An error in either stage ends
    the jobs of both and is raised.
    """
    sc, tag = spark.sparkContext, f"overlap-{uuid.uuid4().hex}"
    handed: queue.Queue = queue.Queue(maxsize=ahead)
    stop, failed = threading.Event(), []

    def hand(item) -> bool:
        while not stop.is_set():
            try:
                handed.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def produce() -> None:
        sc.setLocalProperty("spark.scheduler.pool", "first")
        sc.addJobTag(tag)
        try:
            for number, batch in enumerate(batches):
                if stop.is_set() or not hand((number, save(first(batch), f"first{number}"))):
                    return
            hand(_END)
        except Exception as e:
            failed.append(e)
            hand(_END)
            sc.cancelJobsWithTag(tag)

    ahead_thread = InheritableThread(target=produce, daemon=True)
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", "second")
    sc.addJobTag(tag)
    out: list[DataFrame] = []
    try:
        ahead_thread.start()
        while (item := handed.get()) is not _END:
            number, rows = item
            out.append(save(second(rows), f"second{number}"))
    except Exception as e:
        failed.append(e)
    finally:
        stop.set()
        if failed:
            sc.cancelJobsWithTag(tag)
        ahead_thread.join()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", before)
    if failed:
        raise failed[0]
    return out


__all__ = ["overlapped"]
