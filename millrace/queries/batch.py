"""Batch-shape operators over rollouts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import batch as b
from millrace.sources.views import ROLLOUTS, TOKENS, rollouts, token_rows, trajectories


def b1_head(spark, sf_dir):
    return b.head(rollouts(spark, sf_dir).withColumn("iteration", F.pmod("row_id", F.lit(3))), 250, "iteration", "row_id").select("iteration", "row_id")


def b2_concat(spark, sf_dir):
    r = rollouts(spark, sf_dir).select("row_id", "score")
    return b.concat(r.where("row_id % 2 = 0"), r.where("row_id % 2 = 1").select("score", "row_id"), r.where("row_id < 5"))


def b3_shuffled_slice(spark, sf_dir):
    return b.shuffled_slice(rollouts(spark, sf_dir), 7, 100).select("row_id", "ord")


def b4_partition(spark, sf_dir):
    return b.partition_of(rollouts(spark, sf_dir), 3).select("row_id", "ord")


def b5_select_positions(spark, sf_dir):
    return b.select_positions(rollouts(spark, sf_dir), [5, 3, 3, 99, 0]).select("at", "row_id", "score")


def b5_slice(spark, sf_dir):
    return b.slice_rows(rollouts(spark, sf_dir), 10, 500, 7).select("row_id")


def b6_columns(spark, sf_dir):
    return rollouts(spark, sf_dir).drop("len").withColumnRenamed("score", "reward").select("row_id", "reward")


def b7_chunk(spark, sf_dir):
    return b.chunk(rollouts(spark, sf_dir), 8, pad=True).select("row_id", "chunk")


def b7_split(spark, sf_dir):
    return b.split(rollouts(spark, sf_dir), 37).select("row_id", "chunk")


def b8_repeat(spark, sf_dir):
    return b.repeat(rollouts(spark, sf_dir), 3).select("row_id", "rep", "pos")


def b8_repeat_whole(spark, sf_dir):
    return b.repeat(rollouts(spark, sf_dir), 2, interleave=False).select("row_id", "rep", "pos")


def b9_repeat_each(spark, sf_dir):
    return b.repeat_each(rollouts(spark, sf_dir).withColumn("k", F.pmod("row_id", F.lit(4))), "k").select("row_id", "rep")


def b10_unfold_chunks(spark, sf_dir):
    rows = b.unfold_chunks(token_rows(spark, sf_dir), 4, ["logp"])
    return rows.select("row_id", "part", F.round(F.aggregate("logp", F.lit(0.0), lambda s, x: s + x), 6).alias("s"), F.size("logp").alias("n"))


def b11_pad(spark, sf_dir):
    padded, _ = b.pad_to_divisor(rollouts(spark, sf_dir), 768)
    return padded.select("row_id", "ord", "pad")


def b11_unpad(spark, sf_dir):
    padded, _ = b.pad_to_divisor(rollouts(spark, sf_dir), 64)
    return b.unpad(padded).select("row_id").unionByName(padded.where("pad").groupBy("row_id").count().select("row_id"))


def b12_fold(spark, sf_dir):
    folded = b.fold(rollouts(spark, sf_dir), 9, "score")
    return folded.select("chunk", F.size("score").alias("n"), F.element_at("score", 1).alias("first"), F.element_at("score", -1).alias("last"))


def b12_unfold(spark, sf_dir):
    return b.unfold(b.fold(rollouts(spark, sf_dir), 9, "score"), 9, "score").select("ord", "score")


def b13_collate(spark, sf_dir):
    """Rows as columns of lists: one row per batch of 100, all columns in the order of ids."""
    return b.collate(rollouts(spark, sf_dir), 100)


def b14_mini_batches(spark, sf_dir):
    return b.mini_batches(rollouts(spark, sf_dir), 100).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))


def _coverage(parts, part):
    return parts.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(part).alias("parts"), F.sum("len").alias("tokens"))


def b15_karmarkar_karp(spark, sf_dir):
    return _coverage(b.balance(rollouts(spark, sf_dir), 8), "part")


def b16_greedy(spark, sf_dir):
    return _coverage(b.balance(rollouts(spark, sf_dir), 8, method=b.greedy), "part")


def b17_micro_batches(spark, sf_dir):
    return _coverage(b.micro_batches(rollouts(spark, sf_dir), 256), "micro")


def b18_balance_ranks(spark, sf_dir):
    parts = b.balance(rollouts(spark, sf_dir), 8, equal_size=True)
    return parts.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("rows"))


def a16_unbalance(spark, sf_dir):
    loads = b.unbalance(b.balance(rollouts(spark, sf_dir), 8))
    return loads.select("batch", F.round("mean_load", 6).alias("mean_load"), (F.col("max_load") - F.col("min_load") <= 16).alias("even"))


def b19_split_turns(spark, sf_dir):
    rows = trajectories(spark, sf_dir).withColumns({"advantage": F.col("conv_id") / 10.0, "reward": F.pmod("conv_id", F.lit(5)).cast("double")})
    out = b.split_turns(rows)
    return out.select("conv_id", "at", F.size("prompt").alias("n_prompt"), F.md5("response").alias("response"), "advantage", F.element_at("token_scores", -1).alias("last_score"))


def b20_samplers(spark, sf_dir):
    """Random order beside curriculum order (shortest first)."""
    r = b.by_hash(rollouts(spark, sf_dir), 11, name="random_at")
    easy = b.ordinal(r, F.col("len").cast("int"), [F.col("row_id")], "curriculum_at")
    return easy.select("row_id", "random_at", "curriculum_at")


def b21_stratified(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("level", F.pmod("row_id", F.lit(4)).cast("int"))
    return b.stratified(r, "level", {0: 10, 1: 50, 3: 7}, seed=5).select("level", "row_id")


def b22_masks(spark, sf_dir):
    r = token_rows(spark, sf_dir).withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.pmod(F.col("row_id") * 3 + t * 5, F.lit(11))))
    m = b.eos_mask("ids", [2, 7])
    return r.select("row_id", F.aggregate(m, F.lit(0), lambda s, x: s + x).alias("upto_eos"), F.aggregate(b.tail_mask("mask", 6), F.lit(0), lambda s, x: s + x).alias("tail"))


def b23_padding(spark, sf_dir):
    r = token_rows(spark, sf_dir).select("row_id", F.transform(F.sequence(F.lit(1), F.col("len").cast("int")), lambda t: t.cast("long")).alias("ids"), "mask", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: t).alias("full"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("row_id", text(b.pad("ids", 5, 0)).alias("right"), text(b.pad("ids", 5, 0, left=True)).alias("left"), text(b.remove_pad("full", "mask")).alias("kept"))


def j5_union_columns(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return b.union_columns(r.select("row_id", "score"), r.select("row_id", "score", "len")).select("row_id", "score", "len")


def x23_ceil(spark, sf_dir):
    return spark.createDataFrame([(a, n, b.ceil_div(a, n), b.round_up(a, n)) for a in (0, 1, 7, 8, 9) for n in (1, 4, 8)], "a int, n int, ceil_div int, round_up int")


QUERIES = {k: v for k, v in globals().items() if k[:1] in "bajx" and k[1:2].isdigit() and callable(v)}

_ORD = f"WITH {ROLLOUTS}, o AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS ord FROM r)"

SQL = {
    "b1_head": f"WITH {ROLLOUTS} SELECT row_id % 3 AS iteration, row_id FROM r ORDER BY 1, 2 LIMIT 250",
    "b2_concat": f"WITH {ROLLOUTS} SELECT row_id, score FROM r UNION ALL SELECT row_id, score FROM r WHERE row_id < 5",
    "b3_shuffled_slice": f"WITH {ROLLOUTS}, o AS (SELECT row_id, row_number() OVER (ORDER BY md5('7|' || row_id), row_id) - 1 AS ord FROM r) SELECT * FROM o WHERE ord >= 100",
    "b4_partition": _ORD + " SELECT row_id, ord FROM o, (SELECT count(*) // 5 AS k FROM r) WHERE ord >= 3 * k AND ord < 4 * k",
    "b5_select_positions": _ORD + " SELECT w.k::BIGINT AS \"at\", row_id, score FROM o JOIN (VALUES (0, 5), (1, 3), (2, 3), (3, 99), (4, 0)) w(k, ord) USING (ord)",
    "b5_slice": _ORD + " SELECT row_id FROM o WHERE ord >= 10 AND ord < 500 AND (ord - 10) % 7 = 0",
    "b6_columns": f"WITH {ROLLOUTS} SELECT row_id, score AS reward FROM r",
    "b7_chunk": _ORD + " SELECT row_id, (ord // ((SELECT count(*) + 7 FROM r) // 8))::BIGINT AS chunk FROM o",
    "b7_split": _ORD + " SELECT row_id, (ord // 37)::BIGINT AS chunk FROM o",
    "b8_repeat": _ORD + " SELECT row_id, rep::INT AS rep, ord * 3 + rep AS pos FROM o, (SELECT unnest(range(3)) AS rep)",
    "b8_repeat_whole": _ORD + " SELECT row_id, rep::INT AS rep, rep * (SELECT count(*) FROM r) + ord AS pos FROM o, (SELECT unnest(range(2)) AS rep)",
    "b9_repeat_each": f"WITH {ROLLOUTS} SELECT row_id, unnest(range(row_id % 4))::INT AS rep FROM r",
    "b10_unfold_chunks": f"WITH {TOKENS} SELECT row_id, (t // 4)::INT AS part, round(sum(logp), 6) AS s, count(*)::INT AS n FROM tok GROUP BY ALL",
    "b11_pad": _ORD + ", n AS (SELECT count(*) AS n, (768 - count(*) % 768) % 768 AS p FROM r) SELECT row_id, ord, false AS pad FROM o UNION ALL SELECT row_id, ord + n, true FROM o, n WHERE ord < p",
    "b11_unpad": _ORD + " SELECT row_id FROM o UNION ALL SELECT row_id FROM o WHERE ord < (SELECT (64 - count(*) % 64) % 64 FROM r)",
    "b12_fold": _ORD + " SELECT ord // 9 AS chunk, count(*)::INT AS n, arg_min(score, ord) AS first, arg_max(score, ord) AS last FROM o GROUP BY 1",
    "b12_unfold": _ORD + " SELECT ord, score FROM o",
    "b13_collate": _ORD + " SELECT ord // 100 AS chunk, " + ", ".join(f"list({c} ORDER BY ord) AS {c}" for c in ("row_id", "uid", "data_source", "score", "len")) + " FROM o GROUP BY 1",
    "b14_mini_batches": _ORD + " SELECT ord // 100 AS chunk, count(*) AS n, min(row_id) AS first FROM o GROUP BY 1",
    "b15_karmarkar_karp": _ORD + " SELECT ord // 512 AS batch, count(*) AS rows, 8::BIGINT AS parts, sum(len)::BIGINT AS tokens FROM o GROUP BY 1",
    "b16_greedy": _ORD + " SELECT ord // 512 AS batch, count(*) AS rows, 8::BIGINT AS parts, sum(len)::BIGINT AS tokens FROM o GROUP BY 1",
    "b17_micro_batches": _ORD + " SELECT ord // 512 AS batch, count(*) AS rows, least(count(*), ceil(sum(len) / 256.0))::BIGINT AS parts, sum(len)::BIGINT AS tokens FROM o GROUP BY 1",
    "b18_balance_ranks": _ORD + ", n AS (SELECT ord // 512 AS batch, count(*) AS n FROM o GROUP BY 1) SELECT batch, part::BIGINT AS part, n // 8 AS rows FROM n, (SELECT unnest(range(8)) AS part) WHERE n % 8 = 0",
    "a16_unbalance": _ORD + " SELECT ord // 512 AS batch, round(sum(len) / 8.0, 6)::DOUBLE AS mean_load, true AS even FROM o GROUP BY 1",
    "b19_split_turns": """WITH t AS (SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) - 1 AS i FROM conversations)
SELECT conv_id, i::INT AS at, i::INT AS n_prompt, md5(text) AS response, conv_id / 10.0::DOUBLE AS advantage, (conv_id % 5)::DOUBLE AS last_score FROM t WHERE role = 'assistant' AND trim(text) <> ''""",
    "b20_samplers": f"WITH {ROLLOUTS} SELECT row_id, row_number() OVER (ORDER BY md5('11|' || row_id), row_id) - 1 AS random_at, row_number() OVER (ORDER BY len, row_id) - 1 AS curriculum_at FROM r",
    "b21_stratified": f"WITH {ROLLOUTS}, k AS (SELECT (row_id % 4)::INT AS level, row_id, row_number() OVER (PARTITION BY row_id % 4 ORDER BY md5('5|' || row_id), row_id) AS rk FROM r) SELECT level, row_id FROM k JOIN (VALUES (0, 10), (1, 50), (3, 7)) q(level, n) USING (level) WHERE rk <= n",
    "b22_masks": f"WITH {TOKENS}, e AS (SELECT row_id, coalesce(min(t) FILTER ((row_id * 3 + t * 5) % 11 IN (2, 7)), 16) AS first, sum(m) FILTER (t >= 10) AS tail FROM tok GROUP BY row_id) SELECT row_id, least(first + 1, 16)::INT AS upto_eos, tail::INT AS tail FROM e",
    "b23_padding": f"""WITH {ROLLOUTS} SELECT row_id, array_to_string(list_concat(range(1, len + 1), list_transform(range(greatest(5 - len, 0)), lambda x: 0)), ',') AS right,
array_to_string(list_concat(list_transform(range(greatest(5 - len, 0)), lambda x: 0), range(1, len + 1)), ',') AS left, array_to_string(range(len), ',') AS kept FROM r""",
    "j5_union_columns": f"WITH {ROLLOUTS} SELECT row_id, score, len FROM r",
    "x23_ceil": "SELECT a::INT AS a, n::INT AS n, ((a + n - 1) // n)::INT AS ceil_div, ((a + n - 1) // n * n)::INT AS round_up FROM (SELECT unnest([0, 1, 7, 8, 9]) AS a), (SELECT unnest([1, 4, 8]) AS n)",
}
