"""Scorers with a time limit: a pool of processes inside an Arrow batch.

A scorer that hangs, or ends its process, must not take the task with it.  So
each task keeps a few child processes, hands texts to idle ones, and ends and
replaces a child that is over the limit or gone; that text scores 0, as does
one whose scorer raises or returns no number.
"""

from __future__ import annotations

import contextlib
import multiprocessing
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.connection import Connection, wait

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FORK = multiprocessing.get_context("fork")


def _serve(scorer: Callable[..., float], end: Connection) -> None:
    while True:
        try:
            args = end.recv()
        except EOFError:
            return
        try:
            out = float(scorer(*args))
        except Exception:  # a scorer's failure is a score of 0 by definition
            out = 0.0
        end.send(out)


class ScorerPool:
    """``size`` child processes that run one scorer, each call for ``seconds`` at most."""

    def __init__(self, scorer: Callable[..., float], seconds: float, size: int = 2):
        self.scorer, self.seconds = scorer, seconds
        self.children = [self._start() for _ in range(size)]
        self.ended = 0

    def _start(self):
        ours, theirs = _FORK.Pipe()
        child = _FORK.Process(target=_serve, args=(self.scorer, theirs), daemon=True)
        child.start()
        theirs.close()
        return child, ours

    def _replace(self, k: int) -> None:
        child, end = self.children[k]
        child.kill()
        child.join()
        end.close()
        self.ended += 1
        self.children[k] = self._start()

    def scores(self, calls: Sequence[tuple]) -> list[float]:
        """Scores of all calls in order."""
        out = [0.0] * len(calls)
        waiting, busy = deque(range(len(calls))), {}
        while waiting or busy:
            for k, (_, end) in enumerate(self.children):
                if waiting and k not in busy:
                    call = waiting.popleft()
                    try:
                        end.send(calls[call])
                    except OSError:  # it ended while idle
                        self._replace(k)
                        waiting.appendleft(call)
                        continue
                    busy[k] = call, time.monotonic() + self.seconds
            ready = wait([self.children[k][1] for k in busy], max(0.0, min((t for _, t in busy.values()), default=0.0) - time.monotonic()))
            for k, (call, until) in list(busy.items()):
                if self.children[k][1] in ready:
                    try:
                        out[call] = self.children[k][1].recv()
                    except (EOFError, OSError):
                        self._replace(k)
                    del busy[k]
                elif time.monotonic() >= until:
                    self._replace(k)
                    del busy[k]
        return out

    def close(self) -> None:
        for child, end in self.children:
            with contextlib.suppress(OSError):
                end.close()
            child.kill()
            child.join()


def timed_scorer(scorer: Callable[..., float], seconds: float, size: int = 2) -> Callable[..., Column]:
    """A function of columns that scores their values by ``scorer`` under a time limit; the pool lives as long as a task."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        pool = ScorerPool(scorer, seconds, size)
        try:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)  # one column comes by itself
                yield pd.Series(pool.scores(list(zip(*columns, strict=True))), dtype="float64")
        finally:
            pool.close()

    return scored
