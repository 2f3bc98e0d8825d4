"""Entropy and log-probabilities from logits that may lie in blocks of a vocabulary.

A block is summed up by its greatest logit, the sum of exponentials relative
to it, the sum of logits under those weights, and the label's logit if it is
there.  Such summaries merge in any order, so a row's logits never need to be
in one cell, and exponents are never positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let


# A logit of minus infinity has no weight.
def block_summary(logits: Column, first: Column, label: Column) -> Column:
    """Summary of one block that begins at place ``first`` of the vocabulary; null and missing logits take no part."""

    def summed(x):
        def of(top):
            weight = lambda v: F.exp(v - top)
            s = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + weight(v))
            t = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.when(weight(v) > 0, weight(v) * (v - top)).otherwise(0.0))
            return F.struct(top.alias("top"), s.alias("s"), t.alias("t"))

        return let(F.array_max(x), of)

    core = let(F.filter(F.transform(logits, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v)), summed)
    return F.struct(core["top"].alias("top"), core["s"].alias("s"), core["t"].alias("t"), F.get(logits, (label - first).cast("int")).cast("double").alias("hit"))


def merged(blocks: Column) -> Column:
    """``(entropy, logp)`` of a row from an array of its blocks' summaries."""

    def of(top):
        def total(name):
            return F.aggregate(blocks, F.lit(0.0), lambda acc, b: acc + F.coalesce(F.exp(b["top"] - top) * (b[name] if name == "s" else b["t"] + (b["top"] - top) * b["s"]), F.lit(0.0)))

        # log Z is top + ln s; the mean logit is top + t / s.
        return let(total("s"), lambda s: F.struct((F.ln(s) - total("t") / s).alias("entropy"), (F.array_max(F.transform(blocks, lambda b: b["hit"])) - top - F.ln(s)).alias("logp")))

    return let(F.array_max(F.transform(blocks, lambda b: b["top"])), of)


def from_blocks(blocks: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, entropy, logp)`` from ``(key, first, logits, label)``, a row per block of the vocabulary.

    What meets in a row of the result is a summary of four numbers per block.
    A label outside the vocabulary gives a null ``logp``.
    """
    parts = blocks.select(key, block_summary(F.col("logits"), F.col("first"), F.col("label")).alias("b"))
    return parts.groupBy(key).agg(F.collect_list("b").alias("b")).select(key, merged(F.col("b")).alias("m")).select(key, "m.entropy", "m.logp")


def from_row(logits: Column, label: Column) -> Column:
    """``(entropy, logp)`` of a row whose logits are in one cell."""
    return let(F.array(block_summary(logits, F.lit(0), label)), merged)
