"""Registered queries of the trajectory operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ["advantage", "loss", "batch", "metrics", "text", "mathtext", "scores", "curate", "retrieve", "render", "validate", "stream"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for a in AREAS for k, v in importlib.import_module(f"millrace.queries.{a}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for a in AREAS for k, v in importlib.import_module(f"millrace.queries.{a}").SQL.items()}
