"""Mixing of sources to target weights by Poisson replication.

Every source has a mean repetition rate (its target share over its actual
share).  A document's number of copies is Poisson with that mean, obtained by
inverting the distribution at a uniform number hashed from seed and
``doc_id``: the same document always gets the same count, whatever the
partitioning.  Copies are exploded and dealt to partitions by a random key and
sorted by it there, which is a global shuffle in one exchange.

Rates: from ``weights`` (source to target weight), or, where none are given,
in proportion to ``size ** temperature``.  Sources missing from ``weights``
have rate 0.  Sizes are pre-aggregated sums, so a hot source is no hot task.
Nulls: a null source is a source of its own; a null or empty text counts as
size 1 and is replicated like any other; rows repeated under one ``doc_id``
share a count; a row without one draws by its source and text.  An input
column ``copy`` is replaced, all others stay whatever their names.  A very
long text is one row like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import fits, materialize

#: The table of rates is broadcast up to this many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, hashed from the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, up to where what is left is below 2**-52."""
    upto = F.ceil(rate + 10 * F.sqrt(rate) + 24).cast("int")
    first = F.struct((-rate).alias("logp"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("out"))

    def step(s, k):
        logp = s["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        c = s["c"] + F.exp(logp)
        return F.struct(logp.alias("logp"), c.alias("c"), F.concat(s["out"], F.array(c)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), upto), first, step, lambda s: s["out"])).otherwise(F.array(F.lit(1.0)))


def _key(name: str) -> Column:
    """A source's key; null and the empty name are two sources."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``(__source, rate, cdf)``: with ``epochs`` the expected size of the mix over that of the corpus."""
    size = F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).cast("double")
    sizes = docs.groupBy(_key("source").alias("__source")).agg(size.alias("size"))
    sizes = materialize(sizes, "sizes")
    if weights:
        if any(w < 0 for w in weights.values()) or not sum(weights.values()):
            raise ValueError("weights must not be negative and not all zero")
        given = docs.sparkSession.createDataFrame([("" if k is None else f"={k}", float(v)) for k, v in weights.items()], "__source string, weight double")
        sizes = sizes.join(F.broadcast(given), "__source", "left").select("__source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sizes = sizes.select("__source", "size", F.pow("size", F.lit(temperature)).alias("weight"))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(epochs) * (F.col("weight") / F.col("all_weight")) / (F.col("size") / F.col("all_size"))
    return sizes.crossJoin(F.broadcast(total)).select("__source", F.round(rate, 9).alias("rate")).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (from 0), each document as often as drawn, in random order."""
    rates = materialize(source_rates(docs, weights, temperature, epochs).select(F.col("__source").alias("source"), "cdf"), "rates")
    rates = F.broadcast(rates) if fits(rates, BROADCAST_SOURCES) else rates
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("source", "text").cast("string")))
    # The row travels as one value, so that no column of it can clash with a column made here.
    keyed = docs.select(F.struct(*columns).alias("row"), _key("source").alias("source"), ident.alias("ident"), uniform(F.lit(seed), ident).alias("u"))
    drawn = keyed.join(rates, "source").withColumn("n", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n > 0")
    copies = drawn.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(seed), "ident", "copy", F.lit("order")))
    shuffled = copies.select("row", "copy", order.alias("at")).repartition("at").sortWithinPartitions("at")
    return shuffled.select("row.*", "copy")
