"""Advantage estimators over ``events`` as rollouts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import advantage as adv
from millrace.sources.views import ROLLOUTS, TOKENS, r6, rollouts, token_rows

DIMS = ("d_format", "d_difficulty", "d_acc")


def _scored(name, **options):
    def run(spark, sf_dir):
        return adv.advantages(rollouts(spark, sf_dir), name, **options).select("row_id", r6(F.col("advantage") + 1e-10).alias("advantage"))

    return run


def w4_gdpo(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    rows = r.select("*", (F.pmod("row_id", F.lit(3)) / 2.0).alias("d_format"), (F.col("score") / 100).alias("d_difficulty"), F.pmod("row_id", F.lit(2)).cast("double").alias("d_acc"))
    return adv.gdpo(rows, DIMS).select("row_id", r6(F.col("advantage")).alias("advantage"))


def w4_gdpo_fallback(spark, sf_dir):
    return adv.advantages(rollouts(spark, sf_dir), "gdpo", dimensions=("score",)).select("row_id", r6(F.col("advantage") + 1e-10).alias("advantage"))


def _exploded(df, *columns):
    cells = F.arrays_zip("mask", *columns)
    rows = df.select("row_id", F.posexplode(cells).alias("t", "x")).where("x.mask = 1")
    return rows.select("row_id", F.col("t").cast("int").alias("t"), *[r6(F.col(f"x.{c}") + 1e-10).alias(c) for c in columns])


def w9_gpg(spark, sf_dir):
    # A hair over the value: its exact decimals often end on a rounding tie.
    return adv.advantages(rollouts(spark, sf_dir), "gpg").select("row_id", r6(F.col("advantage") + 1e-10).alias("advantage"))


def w10_reinforce_plus_plus(spark, sf_dir):
    return _exploded(adv.advantages(token_rows(spark, sf_dir), "reinforce_plus_plus", gamma=0.95), "returns", "advantages")


def w11_remax(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("base", F.pmod("row_id", F.lit(10)).cast("double"))
    return _exploded(adv.advantages(rows, "remax", baseline="base"), "returns", "advantages")


def w12_gae(spark, sf_dir):
    return _exploded(adv.advantages(token_rows(spark, sf_dir), "gae", gamma=0.99, lam=0.95), "returns", "advantages")


def w13_estimators(spark, sf_dir):
    """The registry's names: the dispatch table itself."""
    return spark.createDataFrame([(n,) for n in sorted(adv.ESTIMATORS)], "estimator string")


QUERIES = {
    "w1_grpo": _scored("grpo"),
    "w1_grpo_mean_only": _scored("grpo", by_std=False),
    "w2_grpo_batch": _scored("grpo_batch"),
    "w3_group_normalise": _scored("grpo", key="data_source"),
    "w4_gdpo": w4_gdpo,
    "w4_gdpo_fallback": w4_gdpo_fallback,
    "w5_passk": _scored("grpo_passk"),
    "w5_passk_plain": _scored("grpo_passk", by_std=False),
    "w6_reinforce_baseline": _scored("reinforce_plus_plus_baseline"),
    "w7_rloo": _scored("rloo"),
    "w8_opo": _scored("opo"),
    "w9_gpg": w9_gpg,
    "w10_reinforce_plus_plus": w10_reinforce_plus_plus,
    "w11_remax": w11_remax,
    "w12_gae": w12_gae,
    "w13_estimators": w13_estimators,
}


def _group(key="uid", extra=""):
    return f"WITH {ROLLOUTS}, g AS (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 1 THEN 0.0 ELSE avg(score) OVER w END AS mu, CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE stddev_samp(score) OVER w END AS sd{extra} FROM r WINDOW w AS (PARTITION BY {key}))"


def _select(value, key="uid", extra="", tail=""):
    return f"{_group(key, extra)}{tail} SELECT row_id, round({value} + 1e-10, 6) + 0.0 AS advantage FROM g"


_WHITE = "(v - mean) / sqrt(var + 1e-8)"


def _whiten(source, weight="len"):
    return f", m0 AS (SELECT sum(v * {weight}) / (sum({weight}) + 1e-8) AS mean FROM {source}), m1 AS (SELECT mean, sum((v - mean) * (v - mean) * {weight}) / (sum({weight}) + 1e-8) * (sum({weight}) / (sum({weight}) - 1)) AS var FROM {source}, m0 GROUP BY mean)"


_RECURSE = """WITH RECURSIVE {tokens}, back AS (SELECT row_id, 15 AS t, {start} FROM tok WHERE t = 15
UNION ALL SELECT b.row_id, b.t - 1, {step} FROM back b JOIN tok x ON x.row_id = b.row_id AND x.t = b.t - 1)"""

_RPP = _RECURSE.format(tokens=TOKENS, start="reward AS ret, reward * m AS run", step="x.reward + 0.95 * b.run, (x.reward + 0.95 * b.run) * x.m")
_GAE = _RECURSE.format(
    tokens=TOKENS,
    start="CASE WHEN m = 1 THEN reward - v ELSE 0.0 END AS last, CASE WHEN m = 1 THEN v ELSE 0.0 END AS nxt",
    step="CASE WHEN x.m = 1 THEN x.reward + 0.99 * b.nxt - x.v + 0.99 * 0.95 * b.last ELSE b.last END, CASE WHEN x.m = 1 THEN x.v ELSE b.nxt END",
)

SQL = {
    "w1_grpo": _select("(score - mu) / (sd + 1e-6)"),
    "w1_grpo_mean_only": _select("score - mu"),
    "w2_grpo_batch": _select("(score - mu) / (sd + 1e-6)", "data_source"),
    "w3_group_normalise": _select("(score - mu) / (sd + 1e-6)", "data_source"),
    "w4_gdpo": f"""WITH {ROLLOUTS}, d AS (SELECT *, (row_id % 3) / 2.0::DOUBLE AS a, score / 100 AS b, (row_id % 2)::DOUBLE AS c FROM r),
g AS (SELECT row_id, len, (a - avg(a) OVER w) / (stddev_samp(a) OVER w + 1e-6) + (b - avg(b) OVER w) / (stddev_samp(b) OVER w + 1e-6) + (c - avg(c) OVER w) / (stddev_samp(c) OVER w + 1e-6) AS v FROM d WINDOW w AS (PARTITION BY uid))
{_whiten("g")} SELECT row_id, round({_WHITE}, 6) + 0.0 AS advantage FROM g, m1""",
    "w4_gdpo_fallback": _select("(score - mu) / (sd + 1e-6)"),
    "w5_passk": _select("CASE WHEN rk = 1 THEN (score - nx) / (sd + 1e-6) ELSE 0.0 END", extra=", row_number() OVER o AS rk, lead(score) OVER o AS nx").replace("WINDOW w AS (PARTITION BY uid)", "WINDOW w AS (PARTITION BY uid), o AS (PARTITION BY uid ORDER BY score DESC, row_id)"),
    "w5_passk_plain": _select("CASE WHEN rk = 1 THEN score - nx ELSE 0.0 END", extra=", row_number() OVER o AS rk, lead(score) OVER o AS nx").replace("WINDOW w AS (PARTITION BY uid)", "WINDOW w AS (PARTITION BY uid), o AS (PARTITION BY uid ORDER BY score DESC, row_id)"),
    "w6_reinforce_baseline": f"{_group()}, c AS (SELECT row_id, len, score - mu AS v FROM g){_whiten('c')} SELECT row_id, round({_WHITE}, 6) + 0.0 AS advantage FROM c, m1",
    "w7_rloo": _select("CASE WHEN n > 1 THEN score * n / (n - 1) - mu * n / (n - 1) ELSE score END"),
    "w8_opo": _select("score - CASE WHEN n = 1 THEN 0.0 ELSE opt END", extra=", sum(score * len) OVER w / sum(len) OVER w AS opt"),
    "w9_gpg": f"{_group()}, al AS (SELECT count(*)::DOUBLE / greatest(count(*) FILTER (score <> 0), 1) AS alpha FROM r) SELECT row_id, round(alpha * (score - mu) + 1e-10, 6) + 0.0 AS advantage FROM g, al",
    "w10_reinforce_plus_plus": f"{_RPP}, x AS (SELECT b.row_id, b.t, b.ret AS v FROM back b JOIN tok USING (row_id, t) WHERE m = 1), xx AS (SELECT *, 1 AS len FROM x){_whiten('xx')} SELECT row_id, t::INT AS t, round(v + 1e-10, 6) + 0.0 AS returns, round({_WHITE} + 1e-10, 6) + 0.0 AS advantages FROM x, m1",
    "w11_remax": f"WITH {TOKENS}, x AS (SELECT row_id, t, m, sum(reward * m) OVER (PARTITION BY row_id ORDER BY t DESC) AS ret FROM tok) SELECT row_id, t::INT AS t, round(ret + 1e-10, 6) + 0.0 AS returns, round(ret - row_id % 10 + 1e-10, 6) + 0.0 AS advantages FROM x WHERE m = 1",
    "w12_gae": f"{_GAE}, x AS (SELECT b.row_id, b.t, b.last AS v, tok.v AS val FROM back b JOIN tok USING (row_id, t) WHERE m = 1), xx AS (SELECT *, 1 AS len FROM x){_whiten('xx')} SELECT row_id, t::INT AS t, round(v + val + 1e-10, 6) + 0.0 AS returns, round({_WHITE} + 1e-10, 6) + 0.0 AS advantages FROM x, m1",
    "w13_estimators": "SELECT unnest(['gae', 'gdpo', 'gpg', 'grpo', 'grpo_batch', 'grpo_passk', 'opo', 'reinforce_plus_plus', 'reinforce_plus_plus_baseline', 'remax', 'rloo']) AS estimator",
}
