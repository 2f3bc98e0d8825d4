"""Filters and caps that turn raw generations into a task set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import score as S

GATES = ("entity", "source_relevance", "no_leakage", "retrieval")


def parse_gates(spec: str, known: tuple[str, ...] = GATES) -> list[str]:
    """Names of ``"a,b"``; unknown or no names are an error."""
    names = [n.strip() for n in spec.split(",") if n.strip()]
    if not names:
        raise ValueError("no gate is named")
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown gates {unknown}; known: {list(known)}")
    return names


def filter_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    return df.where(length <= most)


def filter_quality(items: DataFrame, judgements: DataFrame, gates: list[str], required: int, id_col: str = "item_id") -> DataFrame:
    """A score column per gate and ``quality_sum`` (-1 if any is unknown); kept if all are known and enough passed.

    Judgements ``(item_id, gate, judge_text)`` are pivoted by conditional
    aggregates, one exchange on the item.
    """
    scores = judgements.withColumn("s", S.quality_score(F.col("judge_text")))
    wide = scores.groupBy(id_col).agg(*[F.max(F.when(F.col("gate") == g, F.col("s"))).alias(f"quality_{g}_score") for g in gates])
    rows = items.join(wide, id_col, "left")
    each = [F.col(f"quality_{g}_score") for g in gates]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return rows.withColumn("quality_sum", F.coalesce(total, F.lit(-1))).where(total.isNotNull() & (total >= required))


def filter_difficulty(df: DataFrame, least: float, most: float, score: str = "difficulty_score") -> DataFrame:
    """Within the band, both ends included."""
    return df.where(F.col(score).between(least, most))


def needs_rubrics(df: DataFrame, target: str = "target", rubrics: str = "rubrics") -> DataFrame:
    return df.where((F.col(target).isNull() | (F.size(target) == 0)) & (F.col(rubrics).isNull() | (F.size(rubrics) == 0)))


def rubric_count_gate(df: DataFrame, rubrics: str = "rubrics", least: int = 3, most: int = 10) -> DataFrame:
    return df.where(F.size(rubrics).between(least, most))


def skip_grading(fmt: Column, n_rubrics: Column, handled: Column, over_limit: Column) -> Column:
    """Rows the grader need not see."""
    return (fmt == 0) | (n_rubrics == 0) | handled | over_limit


def cap_per_source(df: DataFrame, most: int, seed: int, source: str = "data_source", id_col: str = "row_id") -> DataFrame:
    """At most ``most`` rows of each source, a seeded choice; ranks stop at the cap in every task before the exchange."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col)))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order, id_col))
    return df.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def cap_per_prompt(df: DataFrame, most: int, source: str, pos: str, carried: DataFrame | None = None) -> DataFrame:
    """The first ``most`` rows of each source in input order, counting those kept in earlier batches; a null source has no cap.

    ``carried``: ``(source, n)`` kept so far.
    """
    named, free = df.where(F.col(source).isNotNull()), df.where(F.col(source).isNull())
    rank = F.row_number().over(Window.partitionBy(source).orderBy(pos))
    rows = named.withColumn("__r", rank).where(F.col("__r") <= most)
    if carried is not None:
        rows = rows.join(carried.select(F.col(source), F.col("n").alias("__n")), source, "left").where(F.col("__r") + F.coalesce("__n", F.lit(0)) <= most).drop("__n")
    return rows.drop("__r").unionByName(free)


def carry(kept: DataFrame, source: str, carried: DataFrame | None = None) -> DataFrame:
    """Counts of kept rows by source after a batch."""
    now = kept.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return now if carried is None else now.unionByName(carried).groupBy(source).agg(F.sum("n").alias("n"))


def continue_generating(accumulated: int, target: int) -> bool:
    return accumulated < target


def generations_needed(accumulated: int, target: int, last_yield: int) -> bool:
    """Whether one more batch like the last would still fall short."""
    return accumulated + last_yield < target
