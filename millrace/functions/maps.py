"""Metric bags as maps: merging without conflict, appending, and taking apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(a: Column, b: Column) -> Column:
    """Entries of both maps; a key with two different values is an error, nulls counting as values."""
    clash = lambda k: F.raise_error(F.concat(F.lit("two values of "), k))
    in_a, in_b = (lambda k: F.array_contains(F.map_keys(a), k)), (lambda k: F.array_contains(F.map_keys(b), k))
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.eqNullSafe(y), x).when(~in_a(k), y).when(~in_b(k), x).otherwise(clash(k)))


def append(rows: DataFrame, key: str, order: str, metrics: str = "metrics") -> DataFrame:
    """``(key, metrics)``: for each group, a map from every name to the array of its values in ``order``.

    Entries meet by group and name, so a group of many rows is spread over its names.
    """
    cells = rows.select(key, order, F.explode(metrics).alias("name", "value"))
    lists = cells.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda c: c["value"]).alias("values"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias(metrics))
