"""Raw evaluation sets of a local folder, read by a declared layout into the one row shape.

A layout says where a set's file is, how it is stored and what its columns
are; the prompt format is chosen for each set, so that one folder can serve
models of different families.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.curate import cap_per_source
from millrace.sources import benchmarks


@dataclass(frozen=True)
class PromptFormat:
    """What stands before a question, before a conversation, and before a plan."""

    prefix: str
    preamble: str
    plan: str = ""


@dataclass(frozen=True)
class Layout:
    """One set: its kind, its file below the folder, how that is stored, the schema of its rows, and columns under the loader's names.

    The rows' number in ``idx`` is one of the columns.
    """

    kind: str
    file: str
    stored: str
    schema: str
    columns: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.format(self.stored).schema(self.schema).options(**self.options).load(f"{folder}/{self.file}")
        return rows.withColumns({name: F.col(have) for name, have in self.columns.items()})


_LOADERS: dict[str, Callable[[DataFrame, PromptFormat], DataFrame]] = {
    "healthbench": lambda df, f: benchmarks.healthbench(df, f.preamble),
    "researchqa": lambda df, f: benchmarks.researchqa(df, f.prefix),
    "drb_race": lambda df, f: benchmarks.drb_race(df, f.prefix),
    "sqa_cs_v2": lambda df, f: benchmarks.sqa_cs_v2(df, f.prefix),
    "researchrubrics": lambda df, f: benchmarks.researchrubrics(df, f.prefix),
    "research_plan_gen": lambda df, f: benchmarks.research_plan_gen(df, f.prefix, f.plan),
    "wildbench": lambda df, f: benchmarks.wildbench(df, f.preamble),
}


def load_folder(spark: SparkSession, folder: str, layouts: list[Layout], formats: Mapping[str, PromptFormat], chosen: Mapping[str, str], default: str, most: int = 0, seed: int = 42) -> DataFrame:
    """All sets of a folder in one table, each under the format ``chosen`` for its kind, and with ``most`` at most ``most`` rows of each.

    A missing file, an unknown kind and an unknown format are errors; sets
    with further needs, such as recorded answers, have loaders of their own.
    """
    unknown = [x.kind for x in layouts if x.kind not in _LOADERS]
    missing = {chosen.get(x.kind, default) for x in layouts} - set(formats)
    if unknown or missing or not layouts:
        raise ValueError(f"unknown kinds {unknown}, unknown formats {sorted(missing)}" if layouts else "no layouts")
    rows = benchmarks.unite(*[_LOADERS[x.kind](x.read(spark, folder), formats[chosen.get(x.kind, default)]) for x in layouts])
    return cap_per_source(rows, most, seed, "data_source", "idx") if most > 0 else rows


def prompt_text() -> Column:
    """The first message's text."""
    return F.col("prompt")[0]["content"]
