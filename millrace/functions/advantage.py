"""Group-relative advantages and discounted returns.

Group statistics are partial aggregates joined back to the rows, not window
functions: a group with a third of all rows is summed where its rows are and
its rows are never gathered in one task.  A group of one has mean 0 and
deviation 1; deviations are those of a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import col, masked_sum, spread, total

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    """Make an estimator available under ``name``."""

    def add(f):
        if name in ESTIMATORS and ESTIMATORS[name] is not f:
            raise ValueError(f"estimator {name!r} is taken")
        ESTIMATORS[name] = f
        return f

    return add


def advantages(df: DataFrame, estimator: str, **options) -> DataFrame:
    """Apply the estimator registered under a name."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[estimator](df, **options)


def with_group_stats(df: DataFrame, key: str, score: str = "score", **more: Column) -> DataFrame:
    """``df`` with ``g_n``, ``g_mean``, ``g_sd`` of its group and further aggregates."""
    named = [c.alias(n) for n, c in more.items()]
    stats = df.groupBy(F.col(key).alias("g_key")).agg(F.count(F.lit(1)).alias("g_n"), F.avg(score).alias("g_avg"), F.stddev_samp(score).alias("g_dev"), *named)
    one = F.col("g_n") == 1
    stats = stats.select("g_key", "g_n", F.when(one, 0.0).otherwise(F.col("g_avg")).alias("g_mean"), F.when(one, 1.0).otherwise(F.col("g_dev")).alias("g_sd"), *more)
    return df.join(stats, df[key].eqNullSafe(stats["g_key"])).drop("g_key")


def _finish(df: DataFrame, value: Column, columns: list[str]) -> DataFrame:
    return df.select(*columns, value.alias("advantage"))


@register("grpo")
def grpo(df: DataFrame, key: str = "uid", by_std: bool = True, eps: float = EPS, score: str = "score") -> DataFrame:
    rows = with_group_stats(df, key, score)
    centred = F.col(score) - F.col("g_mean")
    return _finish(rows, centred / (F.col("g_sd") + eps) if by_std else centred, df.columns)


@register("grpo_batch")
def grpo_batch(df: DataFrame, by_std: bool = True, eps: float = EPS) -> DataFrame:
    """As ``grpo``, but a group is a data source."""
    return grpo(df, key="data_source", by_std=by_std, eps=eps)


def token_moments(df: DataFrame, value: Column, weight: Column) -> DataFrame:
    """One row: masked mean (divisor + 1e-8) and Bessel-corrected masked variance of row values spread over ``weight`` tokens."""
    sums = df.agg(F.sum(weight).alias("w"), F.sum(value * weight).alias("s"), F.sum(value * value * weight).alias("q"))
    return moments(sums)


def moments(sums: DataFrame) -> DataFrame:
    """Mean and variance from ``w``, ``s`` and ``q``: number, sum and sum of squares."""
    mean = F.col("s") / (F.col("w") + 1e-8)
    spread2 = (F.col("q") - 2 * mean * F.col("s") + mean * mean * F.col("w")) / (F.col("w") + 1e-8)
    few = F.col("w") <= 1
    variance = F.when(few, F.raise_error(F.lit("whitening needs two unmasked tokens")).cast("double")).otherwise(spread2 * F.col("w") / (F.col("w") - 1))
    return sums.select(mean.alias("mean"), variance.alias("variance"))


def whiten_rows(df: DataFrame, value: Column, weight: Column, columns: list[str], name: str = "advantage") -> DataFrame:
    """Row values whitened by the moments over all their tokens (a single broadcast row)."""
    rows = df.withColumn("__v", value)
    one = token_moments(rows, F.col("__v"), weight)
    return rows.crossJoin(F.broadcast(one)).select(*columns, ((F.col("__v") - F.col("mean")) / F.sqrt(F.col("variance") + 1e-8)).alias(name))


def whiten_tokens(df: DataFrame, values: str, mask: str, name: str) -> DataFrame:
    """Arrays whitened by the moments over all unmasked tokens, 0 where masked."""
    sums = df.agg(F.sum(total(mask)).alias("w"), F.sum(masked_sum(values, mask)).alias("s"), F.sum(masked_sum(F.transform(values, lambda x: x * x), mask)).alias("q"))
    rows = df.crossJoin(F.broadcast(moments(sums)))
    return rows.withColumn(name, F.zip_with(values, mask, lambda v, m: (v - F.col("mean")) / F.sqrt(F.col("variance") + 1e-8) * m)).drop("mean", "variance")


@register("gdpo")
def gdpo(df: DataFrame, dimensions: tuple[str, ...] = (), key: str = "uid", by_std: bool = True, length: str = "len") -> DataFrame:
    """Each reward dimension normalised in its group, summed, then whitened over tokens; with fewer than two, ``grpo``."""
    if len(dimensions) < 2:
        return grpo(df, key=key, by_std=by_std)
    more = {}
    for i, d in enumerate(dimensions):
        more |= {f"m{i}": F.avg(d), f"s{i}": F.stddev_samp(d)}
    rows = with_group_stats(df, key, dimensions[0], **more)
    one, parts = F.col("g_n") == 1, F.lit(0.0)
    for i, d in enumerate(dimensions):
        centred = F.col(d) - F.when(one, 0.0).otherwise(F.col(f"m{i}"))
        parts = parts + (centred / (F.when(one, 1.0).otherwise(F.col(f"s{i}")) + EPS) if by_std else centred)
    return whiten_rows(rows, parts, F.col(length), df.columns)


@register("grpo_passk")
def grpo_passk(df: DataFrame, key: str = "uid", by_std: bool = True, score: str = "score", tie: str = "row_id") -> DataFrame:
    """Only a group's best row gets best minus second best; ties go to the smaller id; a group of one is an error.

    Best and second come from partial aggregates: the runner-up is the best
    among the rows that are not the winner.
    """
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t")))
    rows = with_group_stats(df, key, score, g_best=best)
    win = (F.col("g_best.s") == F.col(score)) & (F.col("g_best.t") == -F.col(tie))
    rows = rows.withColumn("g_win", win)
    second = rows.where("NOT g_win").groupBy(F.col(key).alias("k2")).agg(F.max(score).alias("g_second"))
    rows = rows.join(second, rows[key].eqNullSafe(second["k2"]), "left").drop("k2")
    gain = F.col(score) - F.col("g_second")
    gain = gain / (F.col("g_sd") + EPS) if by_std else gain
    alone = F.raise_error(F.lit("pass@k needs two samples in every group")).cast("double")
    return _finish(rows, F.when(F.col("g_n") < 2, alone).when(F.col("g_win"), gain).otherwise(0.0), df.columns)


@register("reinforce_plus_plus_baseline")
def reinforce_baseline(df: DataFrame, key: str = "uid", length: str = "len") -> DataFrame:
    rows = with_group_stats(df, key)
    return whiten_rows(rows, F.col("score") - F.col("g_mean"), F.col(length), df.columns)


@register("rloo")
def rloo(df: DataFrame, key: str = "uid") -> DataFrame:
    rows = with_group_stats(df, key)
    n = F.col("g_n").cast("double")
    return _finish(rows, F.when(n > 1, (F.col("score") - F.col("g_mean")) * n / (n - 1)).otherwise(F.col("score")), df.columns)


@register("opo")
def opo(df: DataFrame, key: str = "uid", length: str = "len") -> DataFrame:
    rows = with_group_stats(df, key, g_opt=F.sum(F.col("score") * F.col(length)) / F.sum(length))
    return _finish(rows, F.col("score") - F.when(F.col("g_n") == 1, 0.0).otherwise(F.col("g_opt")), df.columns)


@register("gpg")
def gpg(df: DataFrame, key: str = "uid", f_norm: float = 1.0) -> DataFrame:
    rows = with_group_stats(df, key)
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha"))
    return _finish(rows.crossJoin(F.broadcast(alpha)), F.col("alpha") * (F.col("score") - F.col("g_mean")) / f_norm, df.columns)


def discounted_returns(rewards: str, mask: str, gamma: float) -> Column:
    """Return of each position, right to left, started anew where masked."""
    pairs = F.reverse(F.arrays_zip(col(rewards).alias("r"), col(mask).alias("m")))
    zero = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        now = x["r"] + gamma * s["run"]
        return F.struct((now * x["m"]).alias("run"), F.concat(F.array(now), s["out"]).alias("out"))

    return F.aggregate(pairs, zero, step, lambda s: s["out"])


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, gamma: float = 1.0, rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    rows = df.withColumn("returns", discounted_returns(rewards, mask, gamma))
    return whiten_tokens(rows, "returns", mask, "advantages")


@register("remax")
def remax(df: DataFrame, baseline: str, rewards: str = "rewards", mask: str = "mask") -> DataFrame:
    kept = F.zip_with(rewards, mask, lambda r, m: r * m)
    returns = F.aggregate(F.reverse(kept), F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out")), lambda s, r: F.struct((s["run"] + r).alias("run"), F.concat(F.array(s["run"] + r), s["out"]).alias("out")), lambda s: s["out"])
    rows = df.withColumn("returns", returns)
    return rows.withColumn("advantages", F.zip_with("returns", spread(baseline, mask), lambda r, b: r - b))


def gae_advantages(rewards: str, values: str, mask: str, gamma: float, lam: float) -> Column:
    """Generalised advantage estimate; masked positions carry the state of the position after them."""
    cells = F.reverse(F.arrays_zip(col(rewards).alias("r"), col(values).alias("v"), col(mask).alias("m")))
    zero = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        fresh = x["r"] + gamma * s["next"] - x["v"] + gamma * lam * s["last"]
        on = x["m"] == 1
        last = F.when(on, fresh).otherwise(s["last"])
        return F.struct(F.when(on, x["v"]).otherwise(s["next"]).alias("next"), last.alias("last"), F.concat(F.array(last), s["out"]).alias("out"))

    return F.aggregate(cells, zero, step, lambda s: s["out"])


@register("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, rewards: str = "rewards", values: str = "values", mask: str = "mask") -> DataFrame:
    """``returns`` and whitened ``advantages``; whitened at masked positions too."""
    rows = df.withColumn("raw", gae_advantages(rewards, values, mask, gamma, lam)).withColumn("returns", F.zip_with("raw", values, lambda a, v: a + v))
    sums = rows.agg(F.sum(total(mask)).alias("w"), F.sum(masked_sum("raw", mask)).alias("s"), F.sum(masked_sum(F.transform("raw", lambda x: x * x), mask)).alias("q"))
    out = rows.crossJoin(F.broadcast(moments(sums)))
    return out.withColumn("advantages", F.transform("raw", lambda a: (a - F.col("mean")) / F.sqrt(F.col("variance") + 1e-8))).drop("raw", "mean", "variance")


__all__ = ["ESTIMATORS", "advantages", "gae", "gdpo", "gpg", "grpo", "grpo_batch", "grpo_passk", "opo", "register", "reinforce_baseline", "reinforce_plus_plus", "remax", "rloo"]
