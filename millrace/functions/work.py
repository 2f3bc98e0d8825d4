"""Floating-point work of a training batch, from the lengths of its sequences.

Architectures are a table; a batch joins its model's row and the formulas are
columns.  Work is per token for the weights (six operations each, forward and
backward) and by squared length for attention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The model types of each way of counting.
FAMILIES = {"dense": ["qwen2", "llama", "qwen2_vl", "qwen2_5_vl", "qwen3", "minicpmv", "minicpmo", "mistral"], "experts": ["qwen2_moe", "qwen3_moe"], "latent": ["deepseek_v3"], "sliding": ["gemma3_text"]}
# Operations a second of devices, in units of 10**12, by a part of their name.
DEVICES = {"MI300X": 1336.0, "H100": 989.0, "H800": 989.0, "H200": 989.0, "A100": 312.0, "A800": 312.0, "L40": 181.05, "L20": 119.5, "H20": 148.0, "910B": 354.0, "RTX 3070 Ti": 21.75}

_SCHEMA = (
    "model string, type string, hidden long, vocab long, layers long, heads long, kv_heads long, head_dim long, inner long, expert_inner long, experts long, top_experts long, shared_experts long, "
    "dense_layers long, nope_dim long, rope_dim long, value_dim long, q_rank long, kv_rank long, window long, window_pattern long"
)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def architectures(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of models; what a family does not need stays null."""
    return spark.createDataFrame([tuple(r.get(n) for n in _NAMES) for r in rows], _SCHEMA)


def _in(family: str) -> Column:
    return F.col("type").isin(FAMILIES[family])


def weights() -> Column:
    """Weights that every token passes, of the joined architecture; null for an unknown type."""
    c = F.col
    head = F.coalesce(c("head_dim"), F.floor(c("hidden") / c("heads")))
    attention = c("hidden") * 2 * head * (c("heads") + c("kv_heads"))
    embedding = 2 * c("vocab") * c("hidden")
    dense = (3 * c("hidden") * c("inner") + attention) * c("layers") + embedding
    experts = (3 * c("hidden") * c("top_experts") * c("expert_inner") + c("hidden") * c("experts") + attention) * c("layers") + embedding
    q_dim = c("nope_dim") + c("rope_dim")
    query = F.when(c("q_rank").isNull(), c("hidden") * c("heads") * q_dim).otherwise(c("q_rank") * (c("hidden") + c("heads") * q_dim))
    latent_attention = query + c("hidden") * (c("kv_rank") + c("rope_dim")) + c("heads") * c("kv_rank") * (c("nope_dim") + c("value_dim")) + c("heads") * c("value_dim") * c("hidden")
    routed = c("hidden") * c("experts") + 3 * c("hidden") * c("expert_inner") * (c("top_experts") + c("shared_experts"))
    latent = (routed + latent_attention) * (c("layers") - c("dense_layers")) + (3 * c("hidden") * c("inner") + latent_attention) * c("dense_layers") + embedding
    return F.when(_in("dense") | _in("sliding"), dense).when(_in("experts"), experts).when(_in("latent"), latent)


def attention_width() -> Column:
    """What a squared length is multiplied by in every layer."""
    c = F.col
    return F.when(_in("latent"), c("nope_dim") + c("rope_dim")).otherwise(F.coalesce(c("head_dim"), F.floor(c("hidden") / c("heads")))) * c("heads")


def squares(length: Column) -> Column:
    """Attended pairs of one sequence in all layers; sliding layers, all but each ``window_pattern``-th, see ``window`` tokens at most."""
    c = F.col
    full = F.when(_in("sliding"), F.floor(c("layers") / F.coalesce(c("window_pattern"), F.lit(6)))).otherwise(c("layers"))
    return length * (full * length + (c("layers") - full) * F.least(length, F.coalesce(c("window"), F.lit(1024))))


def estimate(batches: DataFrame, models: DataFrame, device: str | None = None) -> DataFrame:
    """``(batch, achieved, promised)`` in 10**12 operations a second.

    ``batches (batch, model, length, seconds)`` has a row per sequence; sums
    are partial before they meet.  A model type without a formula achieves 0;
    an unknown device promises infinity.  Models must have one row each.
    """
    sums = batches.join(F.broadcast(models), "model").groupBy("batch", "model").agg(F.sum("length").cast("double").alias("tokens"), F.sum(squares(F.col("length")).cast("double")).alias("pairs"), F.max("seconds").alias("seconds"))
    work = 6.0 * weights() * F.col("tokens") + 12.0 * attention_width() * F.col("pairs")
    promised = next((v for k, v in DEVICES.items() if device and k in device), float("inf"))
    return sums.join(F.broadcast(models), "model").select("batch", F.coalesce(work / F.col("seconds") / 1e12, F.lit(0.0)).alias("achieved"), F.lit(promised).alias("promised"))
