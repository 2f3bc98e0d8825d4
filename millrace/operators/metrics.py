"""Training and validation metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import masked_sum, total

BOOTSTRAPS = 1000

#: Resampled positions that a worker keeps for groups of the same size (4 bytes each).
KEPT_POSITIONS = 1 << 24


def reduce_metrics(long: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys that contain "max" keep the largest value, "min" the smallest, others the mean (substring tests, in that order)."""
    k = F.col(key)
    out = F.when(k.contains("max"), F.max(value)).when(k.contains("min"), F.min(value)).otherwise(F.avg(value))
    return long.groupBy(key).agg(out.alias(value))


def summary(x: Column, name: str) -> list[Column]:
    return [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.min(x).alias(f"{name}_min")]


def nan_summary(x: Column, name: str) -> list[Column]:
    """As ``summary``, over values that are numbers."""
    y = F.when(~F.isnan(x), x)
    return summary(y, name)


def data_metrics(df: DataFrame, width: int, extras: tuple[str, ...] = ()) -> DataFrame:
    """One row of batch statistics.

    Arrays ``rewards, adv, returns, values, old_logp, mask``; token statistics
    are over unmasked positions and use partial sums, not exploded rows.
    """
    n = F.greatest(total("mask"), F.lit(1.0))
    loglik, seq_adv = masked_sum("old_logp", "mask") / n, masked_sum("adv", "mask") / n

    def kept(c):
        cells = F.filter(F.arrays_zip(F.col(c).alias("v"), F.col("mask").alias("m")), lambda x: x["m"] == 1)
        return F.transform(cells, lambda x: x["v"])

    rows = df.select("*", loglik.alias("__ll"), seq_adv.alias("__sa"), total("rewards").alias("__score"), total("mask").alias("__len"), *[kept(c).alias(f"__{c}") for c in ("adv", "returns", "values")])
    diff = F.zip_with("__returns", "__values", lambda a, b: a - b)

    def token(name):
        c = F.col(f"__{name}")
        return [(F.sum(total(c)) / F.sum("__len")).alias(f"{name}_mean"), F.max(F.array_max(c)).alias(f"{name}_max"), F.min(F.array_min(c)).alias(f"{name}_min")]

    def variance(c):
        s, q, k = F.sum(total(c)), F.sum(total(F.transform(c, lambda x: x * x))), F.sum("__len")
        return (q - s * s / k) / (k - 1)

    split = [F.avg("__ll").alias("loglik_mean"), F.avg(F.when(F.col("__sa") > 0, F.col("__ll"))).alias("correct_loglik_mean"), F.avg(F.when(F.col("__sa") < 0, F.col("__ll"))).alias("incorrect_loglik_mean")]
    columns = [*summary(F.col("__score"), "score"), *token("adv"), *token("returns"), *token("values"), *summary(F.col("__len"), "length"), F.avg((F.col("__len") == width).cast("double")).alias("length_clip_ratio"), (1.0 - variance(diff) / (variance(F.col("__returns")) + 1e-5)).alias("explained_var"), *split]
    for e in extras:
        columns += nan_summary(F.col(e), e)
    return rows.agg(*columns)


def timing_metrics(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Seconds and milliseconds per token of each step part; generation counts response tokens only."""
    n = tokens.agg(F.sum("len").alias("response"), F.sum("all_len").alias("overall"))
    per = F.when(F.col("part") == "gen", F.col("response")).otherwise(F.col("overall"))
    return timings.groupBy("part").agg(F.sum("seconds").alias("seconds")).crossJoin(F.broadcast(n)).select("part", "seconds", (F.col("seconds") * 1000 / per).alias("ms_per_token"))


def throughput(tokens: DataFrame, seconds: float, workers: int) -> DataFrame:
    """Tokens of the step, its time, and tokens per second and worker."""
    return tokens.agg(F.sum("all_len").alias("total_tokens")).select("total_tokens", F.lit(seconds).alias("seconds"), (F.col("total_tokens") / (seconds * workers)).alias("throughput"))


def bootstrap_table(n: int, size: int, seed: int = 42, rounds: int = BOOTSTRAPS) -> np.ndarray:
    """Resampled positions, the same for every group of ``n``: the seed is set anew for each call.

    One call draws what ``rounds`` calls of ``choice`` with replacement would.
    """
    return np.random.RandomState(seed).randint(0, n, (rounds, size))


def subset_sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, then n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n] if n > 1 else []


def _bootstrap(seed: int, votes: bool):
    tables: dict[tuple[int, int], np.ndarray] = {}

    def positions(n, k):
        if (n, k) not in tables:
            made = bootstrap_table(n, k, seed).astype(np.int32)
            if sum(t.size for t in tables.values()) + made.size > KEPT_POSITIONS:
                tables.clear()
            tables[n, k] = made
        return tables[n, k]

    def majority(idx, vals, codes):
        """Value at the first position whose vote is as frequent as any."""
        cells = codes[idx] + np.arange(len(idx))[:, None] * (codes.max() + 1)
        often = np.bincount(cells.ravel())[cells]
        first = (often == often.max(1, keepdims=True)).argmax(1)
        return vals[idx[np.arange(len(idx)), first]]

    def measured(vals, codes):
        n = len(vals)
        yield f"mean@{n}", vals.mean()
        if n > 1:
            yield f"std@{n}", vals.std()
        for k in subset_sizes(n):
            idx = positions(n, k)
            drawn = vals[idx]
            stats = {"best": drawn.max(1), "worst": drawn.min(1)}
            if votes:
                stats["maj"] = majority(idx, vals, codes)
            for name, x in stats.items():
                yield f"{name}@{k}/mean", x.mean()
                yield f"{name}@{k}/std", x.std()

    def run(batches):
        for b in batches:
            names, out = ["data_source", "var", "metric", "value"], [[], [], [], []]
            for source, var, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                flat = cells.values
                codes = pd.factorize(flat.field("pred").to_pandas(), use_na_sentinel=False)[0] if votes else None
                for metric, value in measured(flat.field("value").to_numpy(zero_copy_only=False), codes):
                    for o, v in zip(out, (source, var, metric, float(value)), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=names)

    return run


def validation_metrics(samples: DataFrame, seed: int = 42, votes: bool = False) -> DataFrame:
    """``(data_source, var, metric, value)``: resampled statistics of each prompt, then their mean over prompts.

    Samples: ``data_source, prompt, var, pos, value`` and ``pred`` for
    majority votes.  A group is one prompt's samples and is held by one task;
    values that are not numbers take no part.
    """
    rows = samples.where(F.col("value").isNotNull()).select("data_source", "prompt", "var", "pos", "value", *(["pred"] if votes else []))
    cells = F.sort_array(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"), *(["pred"] if votes else []))))
    groups = rows.groupBy("data_source", "prompt", "var").agg(cells.alias("cells")).select("data_source", "var", "cells")
    each = groups.mapInArrow(_bootstrap(seed, votes), "data_source string, var string, metric string, value double")
    return each.groupBy("data_source", "var", "metric").agg(F.avg("value").alias("value"))


def expected_extreme(samples: DataFrame, k: int, best: bool = True) -> DataFrame:
    """Exact expectation of the best (worst) of ``k`` draws with replacement: a weighted sum over ranks."""
    rank = F.row_number().over(Window.partitionBy("data_source", "prompt", "var").orderBy(F.col("value").asc() if best else F.col("value").desc(), "pos"))
    n = F.count(F.lit(1)).over(Window.partitionBy("data_source", "prompt", "var"))
    rows = samples.withColumns({"i": rank, "n": n})
    w = F.pow(F.col("i") / F.col("n"), F.lit(float(k))) - F.pow((F.col("i") - 1) / F.col("n"), F.lit(float(k)))
    return rows.groupBy("data_source", "prompt", "var").agg(F.sum(F.col("value") * w).alias("value"))


def majority_value(votes: DataFrame, keys: list[str], vote: str = "vote", value: str = "value", pos: str = "pos") -> DataFrame:
    """Value of the first row of the most frequent vote; of equally frequent ones the first seen wins."""
    counts = votes.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(pos, value)).alias("first"))
    best = F.max(F.struct(F.col("n"), (-F.col(f"first.{pos}")).alias("early"), F.col(f"first.{value}").alias(value)))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{value}").alias(value))


def roll_up(metrics: DataFrame) -> DataFrame:
    """Named sections: core or auxiliary for each source, and unweighted averages over all, short and long sources."""
    sources = metrics.select("data_source").distinct()
    is_long = F.col("data_source").startswith("eval_")
    groups = F.array(F.struct(F.col("data_source").alias("name"), F.lit(0).alias("least")), F.struct(F.lit("avg").alias("name"), F.lit(2).alias("least")), F.when(is_long, F.struct(F.lit("avg_long").alias("name"), F.lit(2).alias("least"))).otherwise(F.struct(F.lit("avg_short").alias("name"), F.lit(2).alias("least"))))
    member = sources.select("data_source", F.explode(groups).alias("g")).select("data_source", "g.name", "g.least")
    sizes = member.groupBy("name", "least").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.col("least")).select("name")
    rows = metrics.join(member.join(sizes, "name", "left_semi"), "data_source").groupBy("name", "var", "metric").agg(F.avg("value").alias("value"))
    n = F.split_part(F.split_part("metric", F.lit("@"), F.lit(-1)), F.lit("/"), F.lit(1)).cast("int")
    top = rows.groupBy("name", "var").agg(F.max(n).alias("n_max"))
    core = rows.groupBy("name").agg(F.max((F.col("var") == "acc").cast("int")).alias("has_acc"))
    rows = rows.join(top, ["name", "var"]).join(core, "name")
    main = F.when(F.col("has_acc") == 1, F.lit("acc")).otherwise(F.lit("reward"))
    is_core = (F.col("var") == main) & F.col("metric").rlike("^(mean|maj|best)") & F.col("metric").contains(F.concat(F.lit("@"), F.col("n_max").cast("string")))
    section = F.when(is_core, F.lit("val-core")).otherwise(F.lit("val-aux"))
    return rows.select(F.concat_ws("/", section, "name", "var", "metric").alias("name"), "value")


def offline_eval(responses: DataFrame) -> DataFrame:
    """Mean score of each prompt's responses, then the mean per source."""
    each = responses.groupBy("data_source", "prompt").agg(F.avg("score").alias("score"))
    return each.groupBy("data_source").agg(F.avg("score").alias("score"))


def validity(records: DataFrame, top: int = 10) -> DataFrame:
    """``(kind, name, n)``: totals, passes, and the most frequent errors of records with an ``errors`` array."""
    ok = F.size("errors") == 0
    totals = records.agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("passed"))
    named = totals.select(F.explode(F.array(F.struct(F.lit("total").alias("name"), F.col("total").alias("n")), F.struct(F.lit("passed").alias("name"), F.col("passed").alias("n")))).alias("x")).select(F.lit("count").alias("kind"), "x.name", "x.n")
    errors = records.select(F.explode("errors").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(top)
    return named.union(errors.select(F.lit("error"), "name", "n"))


def masked_stats(df: DataFrame, values: str, mask: str) -> DataFrame:
    """Masked sum, mean (divisor + 1e-8) and Bessel-corrected variance over all rows; fewer than two unmasked is an error."""
    from millrace.functions.advantage import moments

    sums = df.agg(F.sum(total(mask)).alias("w"), F.sum(masked_sum(values, mask)).alias("s"), F.sum(masked_sum(F.transform(values, lambda x: x * x), mask)).alias("q"))
    return sums.select("s").crossJoin(moments(sums)).select(F.col("s").alias("masked_sum"), F.col("mean").alias("masked_mean"), F.col("variance").alias("masked_var"))
