"""Training and validation metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.advantage import discounted_returns
from millrace.functions.loss import masked_mean
from millrace.operators import metrics as m
from millrace.sources.views import ROLLOUTS, TOKENS, r6, rollouts, token_rows


def _r(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def a1_reduce_metrics(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    keys = F.element_at(F.array(*[F.lit(k) for k in ("loss/max", "loss/min", "loss", "maximum_gain", "minmax")]), (F.pmod("row_id", F.lit(5)) + 1).cast("int"))
    return _r(m.reduce_metrics(r.select(keys.alias("key"), F.col("score").alias("value"))))


def _batch(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("returns", discounted_returns("rewards", "mask", 1.0))
    rows = rows.withColumn("adv", F.transform("adv", lambda x: F.round(x * 10)))  # whole numbers: signs of sums are exact
    return rows.withColumn("quality_entity_score", F.when(F.col("row_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("score")))


def a2_data_metrics(spark, sf_dir):
    return _r(m.data_metrics(_batch(spark, sf_dir), 16, ("quality_entity_score",)))


def _step(spark, sf_dir):
    tokens = rollouts(spark, sf_dir).select("len", (F.col("len") + 20).alias("all_len"))
    timings = spark.createDataFrame([("gen", 12.5), ("update", 30.0), ("gen", 2.0), ("ref", 4.25)], "part string, seconds double")
    return tokens, timings


def a3_timing(spark, sf_dir):
    tokens, timings = _step(spark, sf_dir)
    return _r(m.timing_metrics(timings, tokens))


def a4_throughput(spark, sf_dir):
    return _r(m.throughput(_step(spark, sf_dir)[0], 48.75, 6))


def _samples(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return r.select("data_source", F.concat(F.lit("p"), F.floor(F.col("row_id") / 20).cast("string")).alias("prompt"), F.lit("reward").alias("var"), F.col("row_id").alias("pos"), F.col("score").alias("value"), F.pmod(F.col("row_id") * 7, F.lit(3)).cast("string").alias("pred"))


def a5_validation_metrics(spark, sf_dir):
    out = m.validation_metrics(_samples(spark, sf_dir))
    return _r(out.where(F.col("metric").rlike("^(mean|std)@")))


def a6_bootstrap(spark, sf_dir):
    return m.validation_metrics(_samples(spark, sf_dir), votes=True)


def a6_expected_best(spark, sf_dir):
    return _r(m.expected_extreme(_samples(spark, sf_dir), 4).withColumn("value", F.col("value") + 1e-10))  # decides exact ties of rounding


def a7_worst_of_n(spark, sf_dir):
    return _r(m.expected_extreme(_samples(spark, sf_dir), 2, best=False).withColumn("value", F.col("value") + 1e-10))


def a8_majority(spark, sf_dir):
    rows = _samples(spark, sf_dir).withColumnRenamed("pred", "vote")
    return _r(m.majority_value(rows, ["data_source", "prompt"]))


def a9_roll_up(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("data_source", F.when(F.col("data_source") < "m", F.concat(F.lit("eval_"), "data_source")).otherwise(F.col("data_source")))
    each = s.groupBy("data_source", "var").agg(F.avg("value").alias("mean@4"), F.max("value").alias("best@4/mean"), F.min("value").alias("worst@2/mean"))
    both = each.unionByName(each.withColumn("var", F.lit("acc")))
    long = both.unpivot(["data_source", "var"], ["mean@4", "best@4/mean", "worst@2/mean"], "metric", "value")
    return _r(m.roll_up(long))


def a10_offline_eval(spark, sf_dir):
    return _r(m.offline_eval(_samples(spark, sf_dir).withColumnRenamed("value", "score")))


def a11_validity(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    errors = F.array_compact(F.array(F.when(F.col("row_id") % 3 == 0, F.lit("missing tag")), F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("bad "), "data_source"))))
    return m.validity(r.withColumn("errors", errors), 4)


def a12_source_counts(spark, sf_dir):
    return rollouts(spark, sf_dir).groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))


def a14_masked_stats(spark, sf_dir):
    return _r(m.masked_stats(token_rows(spark, sf_dir), "logp", "mask"))


def a17_distributed_stats(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return _r(r.agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_samp("score").alias("std"))).crossJoin(F.broadcast(_r(token_rows(spark, sf_dir).agg(masked_mean("logp", "mask").alias("masked_mean")))))


def a18_rates(spark, sf_dir):
    """Mean score, win rate and coverage by source."""
    r = rollouts(spark, sf_dir)
    return _r(r.groupBy("data_source").agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") > 20).cast("double")).alias("win_rate"), F.avg(F.least(F.col("score") / 100, F.lit(1.0))).alias("coverage")))


def x10_lengths(spark, sf_dir):
    rows = token_rows(spark, sf_dir)
    return rows.select("row_id", F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("response_length"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "ax" and k[1:2].isdigit() and callable(v)}

_S = ROLLOUTS + ", s AS (SELECT data_source, 'p' || (row_id // 20) AS prompt, 'reward' AS var, row_id AS pos, score AS value, ((row_id * 7) % 3)::VARCHAR AS pred FROM r)"

SQL = {
    "a1_reduce_metrics": f"WITH {ROLLOUTS}, k AS (SELECT (['loss/max', 'loss/min', 'loss', 'maximum_gain', 'minmax'])[row_id % 5 + 1] AS key, score AS value FROM r) SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM k GROUP BY key",
    "a2_data_metrics": f"""WITH {TOKENS}, x AS (SELECT * REPLACE (round(adv * 10) AS adv), sum(reward) OVER (PARTITION BY row_id ORDER BY t DESC) AS ret FROM tok),
u AS (SELECT * FROM x WHERE m = 1), q AS (SELECT row_id, sum(old_logp) / count(*) AS ll, sum(adv) / count(*) AS sa, sum(reward) AS sc, count(*)::DOUBLE AS n, any_value(score) AS score FROM u GROUP BY row_id),
a AS (SELECT avg(adv) AS adv_mean, max(adv) AS adv_max, min(adv) AS adv_min, avg(ret) AS returns_mean, max(ret) AS returns_max, min(ret) AS returns_min, avg(v) AS values_mean, max(v) AS values_max, min(v) AS values_min, 1.0 - var_samp(ret - v) / (var_samp(ret) + 1e-5) AS explained_var FROM u),
b AS (SELECT avg(sc) AS score_mean, max(sc) AS score_max, min(sc) AS score_min, avg(n) AS length_mean, max(n) AS length_max, min(n) AS length_min, avg((n = 16)::INT) AS length_clip_ratio, avg(ll) AS loglik_mean, avg(ll) FILTER (sa > 0) AS correct_loglik_mean, avg(ll) FILTER (sa < 0) AS incorrect_loglik_mean,
  avg(score) FILTER (row_id % 3 <> 0) AS quality_entity_score_mean, max(score) FILTER (row_id % 3 <> 0) AS quality_entity_score_max, min(score) FILTER (row_id % 3 <> 0) AS quality_entity_score_min FROM q)
SELECT round(COLUMNS(*), 6) + 0.0 FROM a, b""",
    "a3_timing": f"WITH {ROLLOUTS}, n AS (SELECT sum(len) AS resp, sum(len + 20) AS everything FROM r), t AS (SELECT part, sum(s) AS seconds FROM (VALUES ('gen', 12.5::DOUBLE), ('update', 30.0), ('gen', 2.0), ('ref', 4.25)) v(part, s) GROUP BY part) SELECT part, round(seconds, 6) + 0.0 AS seconds, round(seconds * 1000 / CASE WHEN part = 'gen' THEN resp ELSE everything END, 6) + 0.0 AS ms_per_token FROM t, n",
    "a4_throughput": f"WITH {ROLLOUTS} SELECT sum(len + 20)::BIGINT AS total_tokens, 48.75::DOUBLE AS seconds, round(sum(len + 20) / (48.75 * 6)::DOUBLE, 6) + 0.0 AS throughput FROM r",
    "a5_validation_metrics": f"WITH {_S}, g AS (SELECT data_source, var, prompt, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM s GROUP BY ALL), l AS (SELECT data_source, var, 'mean@' || n AS metric, mu AS v FROM g UNION ALL SELECT data_source, var, 'std@' || n, sd FROM g WHERE n > 1) SELECT data_source, var, metric, round(avg(v), 6) + 0.0 AS value FROM l GROUP BY ALL",
    "a6_expected_best": f"WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY data_source, prompt, var ORDER BY value, pos) AS i, count(*) OVER (PARTITION BY data_source, prompt, var) AS n FROM s) SELECT data_source, prompt, var, round(sum(value * (pow(i / n, 4) - pow((i - 1) / n, 4))) + 1e-10, 6) + 0.0 AS value FROM k GROUP BY ALL",
    "a7_worst_of_n": f"WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY data_source, prompt, var ORDER BY value DESC, pos) AS i, count(*) OVER (PARTITION BY data_source, prompt, var) AS n FROM s) SELECT data_source, prompt, var, round(sum(value * (pow(i / n, 2) - pow((i - 1) / n, 2))) + 1e-10, 6) + 0.0 AS value FROM k GROUP BY ALL",
    "a8_majority": f"WITH {_S}, c AS (SELECT data_source, prompt, pred, count(*) AS n, min(pos) AS first, arg_min(value, pos) AS value FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY data_source, prompt ORDER BY n DESC, first) AS i FROM c) SELECT data_source, prompt, round(value, 6) + 0.0 AS value FROM k WHERE i = 1",
    "a9_roll_up": f"""WITH {_S}, e AS (SELECT CASE WHEN data_source < 'm' THEN 'eval_' || data_source ELSE data_source END AS ds, value FROM s),
g AS (SELECT ds, avg(value) AS a, max(value) AS b, min(value) AS c FROM e GROUP BY ds),
l AS (SELECT ds, 'mean@4' AS metric, a AS value FROM g UNION ALL SELECT ds, 'best@4/mean', b FROM g UNION ALL SELECT ds, 'worst@2/mean', c FROM g),
h AS (SELECT ds AS name, metric, value FROM l UNION ALL SELECT 'avg', metric, avg(value) FROM l GROUP BY metric HAVING count(*) > 1
 UNION ALL SELECT CASE WHEN starts_with(ds, 'eval_') THEN 'avg_long' ELSE 'avg_short' END AS k, metric, avg(value) FROM l GROUP BY ALL HAVING count(*) > 1)
SELECT CASE WHEN var = 'acc' AND metric <> 'worst@2/mean' THEN 'val-core/' ELSE 'val-aux/' END || name || '/' || var || '/' || metric AS name, round(value, 6) + 0.0 AS value FROM h, (SELECT unnest(['acc', 'reward']) AS var)""",
    "a10_offline_eval": f"WITH {_S}, g AS (SELECT data_source, prompt, avg(value) AS v FROM s GROUP BY ALL) SELECT data_source, round(avg(v), 6) + 0.0 AS score FROM g GROUP BY 1",
    "a11_validity": f"WITH {ROLLOUTS}, e AS (SELECT row_id, unnest(list_filter([CASE WHEN row_id % 3 = 0 THEN 'missing tag' END, CASE WHEN row_id % 5 = 0 THEN 'bad ' || data_source END], lambda x: x IS NOT NULL)) AS name FROM r) SELECT 'count' AS kind, 'total' AS name, count(*) AS n FROM r UNION ALL SELECT 'count', 'passed', count(*) FROM r WHERE row_id % 3 <> 0 AND row_id % 5 <> 0 UNION ALL SELECT * FROM (SELECT 'error', name, count(*) AS n FROM e GROUP BY name ORDER BY n DESC, name LIMIT 4)",
    "a12_source_counts": f"WITH {ROLLOUTS} SELECT data_source, count(*) AS n FROM r GROUP BY 1",
    "a14_masked_stats": f"WITH {TOKENS}, a AS (SELECT sum(logp * m) AS s, sum(m) AS w, sum(logp * m) / (sum(m) + 1e-8) AS mu FROM tok) SELECT round(any_value(s), 6) + 0.0 AS masked_sum, round(any_value(mu), 6) + 0.0 AS masked_mean, round(sum((logp - mu) ^ 2 * m) / (any_value(w) + 1e-8) * any_value(w) / (any_value(w) - 1), 6) + 0.0 AS masked_var FROM tok, a",
    "a17_distributed_stats": f"WITH {TOKENS}, a AS (SELECT sum(logp * m) / (sum(m) + 1e-8) AS mm FROM tok) SELECT round(avg(score), 6) + 0.0 AS mean, round(max(score), 6) + 0.0 AS max, round(min(score), 6) + 0.0 AS min, round(stddev_samp(score), 6) + 0.0 AS std, round(any_value(mm), 6) + 0.0 AS masked_mean FROM r, a",
    "a18_rates": f"WITH {ROLLOUTS} SELECT data_source, round(avg(score), 6) + 0.0 AS mean_score, round(avg((score > 20)::INT), 6) + 0.0 AS win_rate, round(avg(least(score / 100, 1.0)), 6) + 0.0 AS coverage FROM r GROUP BY 1",
    "x10_lengths": f"WITH {ROLLOUTS} SELECT row_id, len::INT AS response_length FROM r",
}
