"""Losses and divergences over the token views, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import logits as G
from millrace.functions import loss
from millrace.functions import work as W
from millrace.functions.arrays import total
from millrace.sources.views import ROLLOUTS, TOKENS, r6, rollouts, table, token_rows


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) for c in df.columns])


def _named(name, **options):
    def run(spark, sf_dir):
        return _rounded(loss.policy_loss(name)(token_rows(spark, sf_dir), **options))

    return run


def a15_agg_loss(spark, sf_dir):
    rows = token_rows(spark, sf_dir).select("mask", F.zip_with("logp", "adv", lambda p, a: -p * a).alias("x"))
    return rows.agg(*[r6(loss.agg_loss("x", "mask", m)).alias(m.replace("-", "_")) for m in loss.MODES])


def l5_value_loss(spark, sf_dir):
    rows = token_rows(spark, sf_dir).select("mask", F.transform("logp", lambda x: -x).alias("vpreds"), "values", F.transform("adv", lambda x: x + 1.5).alias("returns"))
    return _rounded(loss.value_loss(rows))


def l6_kl_penalty(spark, sf_dir):
    rows = token_rows(spark, sf_dir)
    kinds = {"k1": "k1", "abs_kl": "abs", "k2": "k2", "k3": "k3"}
    return rows.agg(*[r6(loss.masked_mean(F.zip_with("logp", "ref_logp", _kl(k)), "mask")).alias(n) for n, k in kinds.items()])


def _kl(kind):
    return lambda a, b: loss.kl_penalty(a, b, kind)


def l7_kl_in_reward(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("out", loss.rewards_with_kl("rewards", "logp", "ref_logp", "mask", 0.1, "k3"))
    return rows.select("row_id", r6(total("out")).alias("reward"))


def l7_kl_controller(spark, sf_dir):
    control, out = loss.kl_controller("adaptive", 0.2, target=6.0, horizon=1000.0), []
    for step, kl in enumerate([1.0, 6.0, 9.0, 6.6, 100.0]):
        out.append((step, round(control.update(kl, 64), 9)))
    return spark.createDataFrame(out, "step int, coef double")


def l8_llds(spark, sf_dir):
    return _rounded(loss.llds_loss(token_rows(spark, sf_dir)))


def _weights(method):
    def run(spark, sf_dir):
        return loss.sampling_weights(rollouts(spark, sf_dir), method).select("row_id", r6(F.col("weight")).alias("weight"))

    return run


def l9_resample(spark, sf_dir):
    rows = rollouts(spark, sf_dir)
    return loss.resample(loss.sampling_weights(rows), seed=3).join(rows, "row_id").select("draw", "row_id", "score")


def _distill(alpha, tail):
    def run(spark, sf_dir):
        rows = token_rows(spark, sf_dir)
        top = lambda c: F.transform(F.slice(c, 1, 4), lambda x: x - 1.5)
        each = loss.distillation_token_loss(top("logp"), top("ref_logp"), alpha, tail)
        return rows.select("row_id", r6(each).alias("token_loss"))

    return run


def l12_token_rewards(spark, sf_dir):
    rows = token_rows(spark, sf_dir).withColumn("out", loss.zip3("rewards", "old_logp", "ref_logp", lambda s, a, b: s - (a - b) * 0.05))
    return rows.select("row_id", r6(total("out")).alias("reward"))


def l11_entropy(spark, sf_dir):
    """Embeddings as logits, also ten thousandfold, in blocks of a vocabulary and in one cell."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", (F.col("vec_id") % 64).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    wide = e.withColumn("x", F.transform("x", lambda x: x * 10_000.0))
    blocks = lambda df: df.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 16).cast("int"))).alias("b"), "x").select("vec_id", "label", (F.col("b") * 16).alias("first"), F.slice("x", F.col("b") * 16 + 1, F.lit(16)).alias("logits"))
    whole = e.select("vec_id", G.from_row(F.col("x"), F.col("label")).alias("m")).select("vec_id", F.col("m.entropy").alias("e1"), F.col("m.logp").alias("p1"))
    parts = G.from_blocks(blocks(e), "vec_id")
    far = G.from_blocks(blocks(wide), "vec_id").select("vec_id", F.col("entropy").alias("e2"), F.col("logp").alias("p2"))
    return parts.join(whole, "vec_id").join(far, "vec_id").select("vec_id", r6(F.col("entropy")).alias("entropy"), r6(F.col("logp")).alias("logp"), r6(F.col("e1")).alias("row_entropy"), r6(F.col("p1")).alias("row_logp"), F.round(F.col("e2"), 3).alias("wide_entropy"), F.round(F.col("p2"), 3).alias("wide_logp"))


# A model of each family of formulas, and one of none.
MODELS = [
    {"model": "m0", "type": "qwen2", "hidden": 64, "vocab": 1000, "layers": 4, "heads": 8, "kv_heads": 2, "inner": 256},
    {"model": "m1", "type": "qwen3_moe", "hidden": 64, "vocab": 1000, "layers": 4, "heads": 8, "kv_heads": 4, "head_dim": 16, "expert_inner": 32, "experts": 16, "top_experts": 4},
    {"model": "m2", "type": "deepseek_v3", "hidden": 96, "vocab": 2000, "layers": 6, "heads": 4, "inner": 128, "expert_inner": 48, "experts": 8, "top_experts": 2, "shared_experts": 1, "dense_layers": 2, "nope_dim": 12, "rope_dim": 8, "value_dim": 10, "q_rank": 24, "kv_rank": 20},
    {"model": "m3", "type": "gemma3_text", "hidden": 64, "vocab": 1000, "layers": 13, "heads": 4, "kv_heads": 4, "head_dim": 32, "inner": 96, "window": 5},
    {"model": "m4", "type": "other", "hidden": 64, "vocab": 1000, "layers": 4, "heads": 8},
]


def d25_work(spark, sf_dir):
    """Work of each user's rollouts under a model of each family."""
    r = rollouts(spark, sf_dir).select(F.col("uid").alias("batch"), F.concat(F.lit("m"), F.pmod("uid", F.lit(5)).cast("string")).alias("model"), F.col("len").alias("length"), (1.0 + F.pmod("uid", F.lit(3))).alias("seconds"))
    return W.estimate(r, W.architectures(spark, MODELS), "NVIDIA A100-SXM").select("batch", F.round(F.col("achieved") * 1e6, 6).alias("achieved"), "promised")


QUERIES = {
    "a15_agg_loss": a15_agg_loss,
    "l1_ppo_dual_clip": _named("vanilla"),
    "l2_gpg_loss": _named("gpg"),
    "l3_clip_cov": _named("clip_cov", share=0.01),
    "l4_kl_cov": _named("kl_cov", share=0.01),
    "l5_value_loss": l5_value_loss,
    "l6_kl_penalty": l6_kl_penalty,
    "l7_kl_in_reward": l7_kl_in_reward,
    "l7_kl_controller": l7_kl_controller,
    "l8_llds": l8_llds,
    "l9_weights_pow": _weights("pow"),
    "l9_weights_max_min": _weights("max_min"),
    "l9_weights_max_random": _weights("max_random"),
    "l9_resample": l9_resample,
    "l10_distill_mixed": _distill(0.5, True),
    "l10_distill_forward": _distill(0.0, True),
    "l10_distill_reverse": _distill(1.0, False),
    "l12_token_rewards": l12_token_rewards,
    "l11_entropy": l11_entropy,
    "d25_work": d25_work,
}

_MEAN = "sum({x} * m) / (sum(m) + 1e-8)"


def _mean(x):
    return _MEAN.format(x=x)


_CLAMP = "greatest(least(logp - old_logp, 20.0), -20.0)"
_PPO = f"""WITH {TOKENS}, a AS (SELECT m, adv, {_CLAMP} AS x, exp({_CLAMP}) AS ratio FROM tok),
b AS (SELECT *, -adv * ratio AS p, -adv * greatest(least(ratio, 1.2), 0.8) AS c, -adv * 3.0 AS f FROM a), d AS (SELECT *, greatest(p, c) AS t FROM b)
SELECT round({_mean("CASE WHEN adv < 0 THEN least(f, t) ELSE t END")}, 6) + 0.0 AS pg_loss, round({_mean("(c > p)::INT")}, 6) + 0.0 AS clip_frac, round({_mean("(-x)")}, 6) + 0.0 AS kl, round({_mean("(t > f AND adv < 0)::INT")}, 6) + 0.0 AS clip_frac_lower FROM d"""
_COV = f"""WITH {TOKENS}, a AS (SELECT * FROM tok WHERE m = 1), mm AS (SELECT sum(adv) / (count(*) + {{eps}}) AS ma, sum(logp) / (count(*) + {{eps}}) AS mp, count(*) AS n FROM a),
c AS (SELECT a.*, n, (adv - ma) * (logp - mp) AS cov, exp(logp - old_logp) AS ratio, -adv * exp(logp - old_logp) AS p, -adv * greatest(least(exp(logp - old_logp), 1.2), 0.8) AS cut FROM a, mm)"""

_KS = {"k1": "logp - ref_logp", "abs_kl": "abs(logp - ref_logp)", "k2": "0.5 * (logp - ref_logp) * (logp - ref_logp)", "k3": "greatest(least(exp(greatest(least(ref_logp - logp, 20.0), -20.0)) - greatest(least(ref_logp - logp, 20.0), -20.0) - 1, 10.0), -10.0)"}


def _distill_sql(alpha, tail):
    """Each row's first four tokens as top-4 lists; a fifth bucket or a renormalisation follows."""
    rest = (
        "w AS (SELECT row_id, s, q FROM k4 UNION ALL SELECT row_id, ln(1 - exp(least(ln(sum(exp(s))), -1e-7))), ln(1 - exp(least(ln(sum(exp(q))), -1e-7))) FROM k4 GROUP BY row_id)"
        if tail
        else "w AS (SELECT row_id, s - ln(sum(exp(s)) OVER (PARTITION BY row_id)) AS s, q - ln(sum(exp(q)) OVER (PARTITION BY row_id)) AS q FROM k4)"
    )
    value = {0.0: "exp(q) * (q - s)", 1.0: "exp(s) * (s - q)"}.get(alpha, "0.5 * exp(s) * (s - ln(0.5 * exp(s) + 0.5 * exp(q))) + 0.5 * exp(q) * (q - ln(0.5 * exp(s) + 0.5 * exp(q)))")
    return f"WITH {TOKENS}, k4 AS (SELECT row_id, logp - 1.5 AS s, ref_logp - 1.5 AS q FROM tok WHERE t < 4), {rest} SELECT row_id, round(sum({value}), 6) + 0.0 AS token_loss FROM w GROUP BY row_id"


SQL = {
    "a15_agg_loss": f"""WITH {TOKENS}, s AS (SELECT row_id, sum(-logp * adv * m) AS x, sum(m) AS n FROM tok GROUP BY row_id)
SELECT round(sum(x) / (sum(n) + 1e-8), 6) + 0.0 AS token_mean, round(avg(x), 6) + 0.0 AS seq_mean_token_sum, round(avg(x / n), 6) + 0.0 AS seq_mean_token_mean, round(sum(x) / 16, 6) + 0.0 AS seq_mean_token_sum_norm FROM s""",
    "l1_ppo_dual_clip": _PPO,
    "l2_gpg_loss": f"WITH {TOKENS} SELECT round({_mean('(-logp * adv)')}, 6) + 0.0 AS pg_loss FROM tok",
    "l3_clip_cov": _COV.format(eps="1e-8") + """, band AS (SELECT row_id, t, row_number() OVER (ORDER BY md5('0|' || row_id || '|' || t), row_id, t) AS k FROM c WHERE cut <= p AND cov > 1.0 AND cov < 5.0),
e AS (SELECT c.*, CASE WHEN band.k <= greatest(floor(0.01 * n), 1) THEN 0.0 ELSE 1.0 END AS corr FROM c LEFT JOIN band USING (row_id, t))
SELECT round(sum(greatest(p, cut) * corr) / (count(*) + 1e-8), 6) + 0.0 AS pg_loss, round(sum(1 - corr)::DOUBLE / (count(*) + 1e-8), 6) + 0.0 AS clip_frac, round(sum(old_logp - logp) / (count(*) + 1e-8), 6) + 0.0 AS kl FROM e""",
    "l4_kl_cov": _COV.format(eps="0.0") + """, e AS (SELECT *, row_number() OVER (ORDER BY cov DESC, row_id, t) AS k FROM c)
SELECT round(sum(p + CASE WHEN k <= greatest(1, floor(n * 0.01)) THEN abs(logp - old_logp) ELSE 0 END) / (count(*) + 1e-8), 6) + 0.0 AS pg_loss, round(sum(abs(logp - old_logp)) / (count(*) + 1e-8), 6) + 0.0 AS kl_abs FROM e""",
    "l5_value_loss": f"""WITH {TOKENS}, a AS (SELECT m, (-logp - (adv + 1.5)) ^ 2 AS x, (greatest(least(-logp, v + 0.5), v - 0.5) - (adv + 1.5)) ^ 2 AS y FROM tok)
SELECT round(0.5 * {_mean("greatest(x, y)")}, 6) + 0.0 AS vf_loss, round({_mean("(y > x)::INT")}, 6) + 0.0 AS vf_clip_frac FROM a""",
    "l6_kl_penalty": f"WITH {TOKENS} SELECT " + ", ".join(f"round({_mean('(' + x + ')')}, 6) + 0.0 AS {k}" for k, x in _KS.items()) + " FROM tok",
    "l7_kl_in_reward": f"WITH {TOKENS} SELECT row_id, round(sum(reward - 0.1 * ({_KS['k3']}) * m), 6) + 0.0 AS reward FROM tok GROUP BY row_id",
    "l7_kl_controller": """WITH RECURSIVE k(step, kl) AS (VALUES (0, 1.0::DOUBLE), (1, 6.0), (2, 9.0), (3, 6.6), (4, 100.0)),
c AS (SELECT -1 AS step, 0.2::DOUBLE AS coef UNION ALL SELECT k.step, coef * (1 + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, kl / 6.0 - 1)) * 64 / 1000.0) FROM c JOIN k ON k.step = c.step + 1)
SELECT step::INT AS step, round(coef, 9) AS coef FROM c WHERE step >= 0""",
    "l8_llds": f"""WITH {TOKENS}, s AS (SELECT row_id, sum(m) AS n, sum(adv * m) / greatest(sum(m), 1) >= 0 AS keep, sum((old_logp - logp) * m) > 0 AS drp, sum(greatest((old_logp - logp) * m, 0.0)) AS lost FROM tok GROUP BY row_id),
g AS (SELECT *, (keep AND drp)::INT AS gate FROM s)
SELECT round(sum(lost * gate) / greatest(sum(n * gate), 1), 6) + 0.0 AS llds_loss, sum(gate)::DOUBLE AS gated_responses, sum(n * gate)::DOUBLE AS gated_tokens, sum(keep::INT)::DOUBLE AS preserving FROM g""",
    "l9_weights_pow": f"WITH {ROLLOUTS} SELECT row_id, round(greatest(pow(abs(score), 2.0) + 1e-8, 1e-8), 6) + 0.0 AS weight FROM r",
    "l9_weights_max_min": f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN score = max(score) OVER () OR score = min(score) OVER () THEN 1.0::DOUBLE ELSE 0.0 END + 1e-8, 6) + 0.0 AS weight FROM r",
    "l9_weights_max_random": f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN score = max(score) OVER () THEN 0.4::DOUBLE ELSE 0.1 END + 1e-8, 6) + 0.0 AS weight FROM r",
    "l10_distill_mixed": _distill_sql(0.5, True),
    "l10_distill_forward": _distill_sql(0.0, True),
    "l10_distill_reverse": _distill_sql(1.0, False),
    "l12_token_rewards": f"WITH {TOKENS} SELECT row_id, round(sum(reward - (old_logp - ref_logp) * 0.05), 6) + 0.0 AS reward FROM tok GROUP BY row_id",
    "l11_entropy": """WITH x AS (SELECT vec_id, vec_id % 64 AS label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
a AS (SELECT vec_id, max(v) AS m FROM x GROUP BY vec_id), n AS (SELECT vec_id, ln(sum(exp(v - m))) - sum(exp(v - m) * (v - m)) / sum(exp(v - m)) AS e, max(v) FILTER (i = label) - max(m) - ln(sum(exp(v - m))) AS p FROM x JOIN a USING (vec_id) GROUP BY vec_id),
w AS (SELECT vec_id, ln(sum(exp(1e4 * v - 1e4 * m))) - sum(exp(1e4 * v - 1e4 * m) * (1e4 * v - 1e4 * m)) / sum(exp(1e4 * v - 1e4 * m)) AS e, max(1e4 * v) FILTER (i = label) - max(1e4 * m) - ln(sum(exp(1e4 * v - 1e4 * m))) AS p FROM x JOIN a USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(n.e, 6) + 0.0 AS entropy, round(n.p, 6) + 0.0 AS logp, round(n.e, 6) + 0.0 AS row_entropy, round(n.p, 6) + 0.0 AS row_logp, round(w.e, 3) AS wide_entropy, round(w.p, 3) AS wide_logp FROM n JOIN w USING (vec_id)""",
    "d25_work": f"""WITH {ROLLOUTS}, m(model, n, width, layers, near) AS (VALUES
(0, (3*64*256 + 64*(64+16+16+64))*4 + 2*1000*64, 64, 4, 0), (1, (64*4*32*3 + 64*16 + 64*(128+64+64+128))*4 + 2*1000*64, 128, 4, 0),
(2, (96*8 + 96*48*9 + 96*24 + 4*20*24 + 96*28 + 4*22*20 + 4*10*96)*4 + (96*128*3 + 96*24 + 4*20*24 + 96*28 + 4*22*20 + 4*10*96)*2 + 2*2000*96, 80, 6, 0),
(3, (3*64*96 + 64*512)*13 + 2*1000*64, 128, 2, 11), (4, 0, 0, 0, 0)),
s AS (SELECT uid, sum(len) AS tokens, sum(len * len) AS sq, sum(len * least(len, 5)) AS near_sq FROM r GROUP BY uid)
SELECT uid AS batch, round((6.0 * n * tokens + 12.0 * width * (layers * sq + near * near_sq)) / (1.0 + uid % 3) / 1e12 * 1e6, 6) AS achieved, 312.0::DOUBLE AS promised FROM s JOIN m ON model = uid % 5""",
}
