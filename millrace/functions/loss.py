"""Policy, value and divergence losses over token-level arrays.

Per-token terms are array expressions; a loss is one aggregate over rows with
partial sums, so nothing is exploded unless a global rank over tokens is
part of the definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import clamp, col, masked_sum, total, zip3
from millrace.sources.io import shared_folder

LOSSES: dict[str, Callable[..., DataFrame]] = {}
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def register(name: str):
    def add(f):
        LOSSES[name] = f
        return f

    return add


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    return LOSSES[name]


def masked_mean(values: Column | str, mask: Column | str) -> Column:
    """Aggregate: mean over all unmasked tokens (divisor + 1e-8)."""
    return F.sum(masked_sum(values, mask)) / (F.sum(total(mask)) + 1e-8)


def agg_loss(values: Column | str, mask: Column | str, mode: str = "token-mean") -> Column:
    """Aggregate of a loss matrix in one of four modes."""
    if mode == "token-mean":
        return masked_mean(values, mask)
    if mode == "seq-mean-token-sum":
        return F.avg(masked_sum(values, mask))
    if mode == "seq-mean-token-mean":
        return F.avg(masked_sum(values, mask) / total(mask))
    if mode == "seq-mean-token-sum-norm":
        return F.sum(masked_sum(values, mask)) / F.max(F.size(col(mask)))
    raise ValueError(f"unknown mode {mode!r}; known: {MODES}")


def log_ratio(logp: str, old: str, bound: float | None = 20.0) -> Column:
    return F.zip_with(logp, old, lambda a, b: clamp(a - b, -bound, bound) if bound else a - b)


@register("vanilla")
def ppo_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean") -> DataFrame:
    """Dual-clip loss, share clipped above, mean divergence, share clipped below."""
    if dual <= 1:
        raise ValueError("dual must be over 1")
    rows = df.withColumn("lr", log_ratio("logp", "old_logp"))

    def parts(a, x):
        ratio = F.exp(x)
        plain, cut, floor = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high), -a * dual
        top = F.greatest(plain, cut)
        return plain, cut, floor, top

    def cell(f):
        return F.zip_with("adv", "lr", lambda a, x: f(a, *parts(a, x)))

    rows = rows.select("mask", "lr", cell(lambda a, p, c, f, t: F.when(a < 0, F.least(f, t)).otherwise(t)).alias("loss"), cell(lambda a, p, c, f, t: (c > p).cast("double")).alias("over"), cell(lambda a, p, c, f, t: ((t > f) & (a < 0)).cast("double")).alias("under"))
    return rows.agg(agg_loss("loss", "mask", mode).alias("pg_loss"), masked_mean("over", "mask").alias("clip_frac"), masked_mean(F.transform("lr", lambda x: -x), "mask").alias("kl"), masked_mean("under", "mask").alias("clip_frac_lower"))


@register("gpg")
def gpg_loss(df: DataFrame, mode: str = "token-mean") -> DataFrame:
    return df.agg(agg_loss(F.zip_with("logp", "adv", lambda p, a: -p * a), "mask", mode).alias("pg_loss"))


#: Ranges of places that are counted; rows of one bucket of cumulative weights.
PLACES = 4096
BUCKET_ROWS = 500_000


def _centred(df: DataFrame, mean_eps: float) -> tuple[DataFrame, int]:
    """Unmasked tokens with their covariance term, written once, and how many there are; the means come from the arrays, before anything is exploded."""
    seen = lambda x: total(F.zip_with(x, "mask", lambda v, m: F.when(m > 0, v).otherwise(0.0)))
    sums = df.agg(F.sum(seen("adv")).alias("a"), F.sum(seen("logp")).alias("p"), F.sum(F.size(F.filter("mask", lambda m: m > 0))).alias("n")).first()
    n = int(sums["n"] or 0)
    mean = lambda x: F.lit((x or 0.0) / (n + mean_eps) if n else 0.0)
    cells = F.arrays_zip("adv", "logp", "old_logp", "mask")
    tokens = df.select("row_id", F.posexplode(cells).alias("t", "x")).where("x.mask > 0").select("row_id", "t", "x.adv", "x.logp", "x.old_logp")
    tokens = tokens.withColumn("cov", (F.col("adv") - mean(sums["a"])) * (F.col("logp") - mean(sums["p"])))
    path = shared_folder(df.sparkSession, "tokens")
    tokens.write.parquet(path)
    return df.sparkSession.read.schema(tokens.schema).parquet(path), n


def first_rows(rows: DataFrame, n: int, place: Column, order: list[Column]) -> DataFrame:
    """The ``n`` first rows by ``place`` and then ``order``; only the rows of one narrow range of places are ever sorted.

    Places are counted in ranges, a bounded number of them: rows of ranges
    before the one that holds the ``n``-th row are in, and of that one the first.
    """
    placed = rows.withColumn("__p", place)
    lo, hi = placed.agg(F.min("__p"), F.max("__p")).first()
    if lo is None:
        return rows.limit(0)
    width = (hi - lo) / PLACES or 1.0
    placed = placed.withColumn("__at", F.floor((F.col("__p") - lo) / width).cast("int"))
    left = n
    for at, count in sorted(map(tuple, placed.groupBy("__at").count().collect())):
        if count >= left:
            edge = placed.where(F.col("__at") == at).orderBy("__p", *order).limit(left)
            return placed.where(F.col("__at") < at).union(edge).drop("__p", "__at")
        left -= count
    return rows


@register("clip_cov")
def clip_cov_loss(df: DataFrame, low: float = 0.2, high: float = 0.2, share: float = 0.0002, cov_low: float = 1.0, cov_high: float = 5.0, seed: int = 0) -> DataFrame:
    """A hashed pick among unclipped tokens with covariance inside a band loses its loss."""
    tokens, n = _centred(df, 1e-8)
    tokens = tokens.withColumn("ratio", F.exp(F.col("logp") - F.col("old_logp")))
    tokens = tokens.withColumns({"plain": -F.col("adv") * F.col("ratio"), "cut": -F.col("adv") * clamp(F.col("ratio"), 1 - low, 1 + high)})
    picks = max(int(share * n), 1)
    band = tokens.where((F.col("cut") <= F.col("plain")) & (F.col("cov") > cov_low) & (F.col("cov") < cov_high))
    band = band.select("row_id", "t", F.md5(F.concat_ws("|", F.lit(seed), "row_id", "t")).alias("u"))
    gone = first_rows(band, picks, F.conv(F.substring("u", 1, 12), 16, 10).cast("double"), [F.col("u"), F.col("row_id"), F.col("t")]).select("row_id", "t", F.lit(0.0).alias("corr"))
    kept = tokens.join(gone, ["row_id", "t"], "left").withColumn("corr", F.coalesce("corr", F.lit(1.0)))
    d = F.count(F.lit(1)) + 1e-8
    return kept.agg((F.sum(F.greatest("plain", "cut") * F.col("corr")) / d).alias("pg_loss"), (F.sum(1 - F.col("corr")) / d).alias("clip_frac"), (F.sum(F.col("old_logp") - F.col("logp")) / d).alias("kl"))


@register("kl_cov")
def kl_cov_loss(df: DataFrame, share: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """The tokens of greatest covariance also pay their absolute log-ratio."""
    tokens, n = _centred(df, 0.0)
    picks = max(1, int(n * share))
    top = first_rows(tokens.select("row_id", "t", "cov"), picks, -F.col("cov"), [F.col("row_id"), F.col("t")]).select("row_id", "t", F.lit(coef).alias("pay"))
    rows = tokens.join(top, ["row_id", "t"], "left").withColumn("x", F.col("logp") - F.col("old_logp"))
    loss = -F.col("adv") * F.exp("x") + F.coalesce("pay", F.lit(0.0)) * F.abs("x")
    d = F.count(F.lit(1)) + 1e-8
    return rows.agg((F.sum(loss) / d).alias("pg_loss"), (F.sum(F.abs("x")) / d).alias("kl_abs"))


def value_loss(df: DataFrame, clip: float = 0.5, mode: str = "token-mean", predicted: str = "vpreds", returns: str = "returns", values: str = "values", mask: str = "mask") -> DataFrame:
    plain = F.zip_with(predicted, returns, lambda p, r: (p - r) * (p - r))
    cut = zip3(predicted, returns, values, lambda p, r, v: F.pow(clamp(p, v - clip, v + clip) - r, F.lit(2.0)))
    rows = df.select(col(mask).alias("m"), plain.alias("a"), cut.alias("b"))
    return rows.agg((0.5 * agg_loss(F.zip_with("a", "b", lambda x, y: F.greatest(x, y)), "m", mode)).alias("vf_loss"), masked_mean(F.zip_with("a", "b", lambda x, y: (y > x).cast("double")), "m").alias("vf_clip_frac"))


def kl_penalty(logp: Column, ref: Column, kind: str) -> Column:
    """Divergence estimate of two log-probabilities of one token."""
    if kind in ("kl", "k1"):
        return logp - ref
    if kind == "abs":
        return F.abs(logp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (logp - ref) * (logp - ref)
    if kind in ("low_var_kl", "k3"):
        x = clamp(ref - logp, -20.0, 20.0)
        return clamp(F.exp(x) - x - 1, -10.0, 10.0)
    raise NotImplementedError(f"divergence {kind!r}")


class AdaptiveKL:
    """Coefficient that follows a target divergence; held on the driver."""

    def __init__(self, start: float, target: float, horizon: float):
        self.value, self.target, self.horizon = start, target, horizon

    def update(self, current: float, steps: int) -> float:
        error = max(-0.2, min(0.2, current / self.target - 1))
        self.value *= 1 + error * steps / self.horizon
        return self.value


class FixedKL:
    """A coefficient that never changes."""

    def __init__(self, value: float):
        self.value = value

    def update(self, current: float, steps: int) -> float:
        return self.value


def kl_controller(kind: str, coef: float, target: float = 0.1, horizon: float = 10_000.0):
    """``fixed`` or ``adaptive``."""
    if kind == "fixed":
        return FixedKL(coef)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        return AdaptiveKL(coef, target, horizon)
    raise NotImplementedError(kind)


def rewards_with_kl(scores: str, logp: str, ref: str, mask: str, beta: float, kind: str = "k1") -> Column:
    """Token rewards less the weighted masked divergence."""
    kl = zip3(logp, ref, mask, lambda a, b, m: kl_penalty(a, b, kind) * m)
    return F.zip_with(scores, kl, lambda s, k: s - beta * k)


def llds_loss(df: DataFrame) -> DataFrame:
    """Penalty on likelihood lost by responses with mean advantage of at least 0 and a net drop."""
    diff = zip3("old_logp", "logp", "mask", lambda a, b, m: (a - b) * m)
    rows = df.select(total("mask").alias("n"), (masked_sum("adv", "mask") / F.greatest(total("mask"), F.lit(1.0)) >= 0).alias("keep"), (total(diff) > 0).alias("drop"), total(F.transform(diff, lambda x: F.greatest(x, F.lit(0.0)))).alias("lost"))
    gate = (F.col("keep") & F.col("drop")).cast("double")
    return rows.agg((F.sum(F.col("lost") * gate) / F.greatest(F.sum(F.col("n") * gate), F.lit(1.0))).alias("llds_loss"), F.sum(gate).alias("gated_responses"), F.sum(F.col("n") * gate).alias("gated_tokens"), F.sum(F.col("keep").cast("double")).alias("preserving"))


def sampling_weights(df: DataFrame, method: str = "pow", power: float = 2.0, score: str = "score") -> DataFrame:
    """Importance weights for resampling."""
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.greatest(F.pow(F.abs(s), F.lit(power)) + 1e-8, F.lit(1e-8)))
    ends = df.agg(F.max(score).alias("hi"), F.min(score).alias("lo"))
    rows = df.crossJoin(F.broadcast(ends))
    if method == "max_min":
        w = F.when((s == F.col("hi")) | (s == F.col("lo")), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(s == F.col("hi"), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return rows.withColumn("weight", w + 1e-8).drop("hi", "lo")


def resample(weighted: DataFrame, size: int | None = None, seed: int = 0, buckets: int | None = None, id_col: str = "row_id") -> DataFrame:
    """``(draw, id)``: ``size`` draws (as many as rows by default) with replacement in proportion to ``weight``.

    Hashed uniforms meet cumulative weights by bucket: each row's interval of
    cumulative weight is split at bucket bounds, so the range condition is an
    equi-join on the bucket and no side is gathered.
    """
    n = weighted.count()
    size = n if size is None else size
    buckets = max(64, -(-n // BUCKET_ROWS)) if buckets is None else buckets
    parts = weighted.select(F.col(id_col), "weight", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("p"))
    sums = parts.groupBy("p").agg(F.sum("weight").alias("w"))
    starts = sums.select("p", (F.sum("w").over(Window.orderBy("p")) - F.col("w")).alias("base"), F.sum("w").over(Window.partitionBy()).alias("all"))  # ``buckets`` rows
    within = Window.partitionBy("p").orderBy(id_col)
    rows = parts.withColumn("upto", F.sum("weight").over(within)).join(F.broadcast(starts), "p")
    lo, hi = (F.col("base") + F.col("upto") - F.col("weight")) / F.col("all"), (F.col("base") + F.col("upto")) / F.col("all")
    spans = rows.select(F.col(id_col), lo.alias("lo"), hi.alias("hi"))
    spans = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") * buckets * 64).cast("long"), F.floor(F.least(F.col("hi"), F.lit(1.0)) * buckets * 64).cast("long"))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw")), 1, 13), 16, 10).cast("double") / float(2**52)
    draws = weighted.sparkSession.range(size).select(F.col("id").alias("draw")).withColumn("u", u)
    draws = draws.withColumn("b", F.floor(F.col("u") * buckets * 64).cast("long"))
    return draws.join(spans, "b").where("u >= lo AND u < hi").select("draw", id_col)


def _logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def distillation_token_loss(student: Column, teacher: Column, alpha: float = 0.5, add_tail: bool = True) -> Column:
    """Divergence of two top-k log-probability lists of one token, with a bucket for what is left or renormalised."""

    def whole(x):
        s = _logsumexp(x)
        if not add_tail:
            return F.transform(x, lambda v: v - s)
        return F.concat(x, F.array(F.ln(-F.expm1(F.least(s, F.lit(-1e-7))))))

    s, t = whole(student), whole(teacher)
    kl = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    if alpha == 0.0:
        return kl(t, s)
    if alpha == 1.0:
        return kl(s, t)
    import math

    mix = F.zip_with(s, t, lambda a, b: _logsumexp(F.array(a + math.log(1 - alpha), b + math.log(alpha))))
    return (1 - alpha) * kl(s, mix) + alpha * kl(t, mix)
