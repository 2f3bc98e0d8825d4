"""Typed views over the base tables that the trajectory operators start from.

Each view exists twice: as a DataFrame and as a DuckDB common table
expression, so queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Response length of the fixed-width token views.
WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, uid, data_source, score, len)``: one scored response per event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("uid"), F.col("event_type").alias("data_source"), F.col("value").alias("score"), (1 + F.pmod("event_id", F.lit(WIDTH))).alias("len"))


ROLLOUTS = "r AS (SELECT event_id AS row_id, user_id AS uid, event_type AS data_source, value AS score, 1 + event_id % 16 AS len FROM events)"


def _each(f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), f)


def _mod(a: int, b: int, n: int, t: Column) -> Column:
    return F.pmod(F.col("row_id") * a + t.cast("long") * b, F.lit(n)).cast("double")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with their token-level arrays: mask, rewards, three log-probabilities, advantages, values."""
    r = rollouts(spark, sf_dir)
    return r.select(
        "*",
        _each(lambda t: (t < F.col("len")).cast("int")).alias("mask"),
        _each(lambda t: F.when(t == F.col("len") - 1, F.col("score")).otherwise(0.0)).alias("rewards"),
        _each(lambda t: -_mod(7, 3, 97, t) / 25.0).alias("old_logp"),
        _each(lambda t: -_mod(11, 5, 89, t) / 25.0).alias("logp"),
        _each(lambda t: -_mod(13, 2, 83, t) / 25.0).alias("ref_logp"),
        _each(lambda t: (_mod(5, 3, 41, t) - 20.0) / 10.0).alias("adv"),
        _each(lambda t: _mod(3, 7, 31, t) / 10.0).alias("values"),
    )


TOKENS = (
    ROLLOUTS
    + """,
tok AS (SELECT row_id, uid, data_source, score, len, t, (t < len)::INT AS m, CASE WHEN t = len - 1 THEN score ELSE 0.0 END AS reward,
        -((row_id * 7 + t * 3) % 97)::DOUBLE / 25.0 AS old_logp, -((row_id * 11 + t * 5) % 89)::DOUBLE / 25.0 AS logp,
        -((row_id * 13 + t * 2) % 83)::DOUBLE / 25.0 AS ref_logp, (((row_id * 5 + t * 3) % 41)::DOUBLE - 20.0) / 10.0 AS adv,
        ((row_id * 3 + t * 7) % 31)::DOUBLE / 10.0 AS v
        FROM r, (SELECT unnest(range(16)) AS t))"""
)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turns, traj)``: conversations as tagged chat text.

    Assistant turns think about their first five words, then search, or
    answer in the last one; user turns after the first are information.
    """
    c = table(spark, sf_dir, "conversations")
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i).otherwise(-1)))

    def body(t, i):
        words = F.array_join(F.slice(F.split(t["text"], " "), 1, 5), " ")
        inner = F.concat(F.lit("<think>"), words, F.lit("</think>"))
        search = F.concat(inner, F.lit("<search>"), words, F.lit("</search>"))
        answer = F.concat(inner, F.lit("<answer>"), F.array_join(F.slice(F.split(t["text"], " "), 1, 3), " "), F.lit("</answer>"))
        info = F.concat(F.lit("<information>"), t["text"], F.lit("</information>"))
        said = F.when(t["role"] == "assistant", F.when(i == last, answer).otherwise(search)).when((t["role"] == "user") & (i > 1), info).otherwise(t["text"])
        return F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), said, F.lit("<|im_end|>\n"))

    return rows.select("conv_id", "turns", F.array_join(F.transform("turns", body), "").alias("traj"))


TRAJ = r"""
ct AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) - 1 AS i FROM conversations),
cl AS (SELECT *, max(CASE WHEN role = 'assistant' THEN i ELSE -1 END) OVER (PARTITION BY conv_id) AS last, array_to_string(string_split(text, ' ')[1:5], ' ') AS w5, array_to_string(string_split(text, ' ')[1:3], ' ') AS w3 FROM ct),
cs AS (SELECT conv_id, i, role, text, CASE WHEN role = 'assistant' AND i = last THEN '<think>' || w5 || '</think><answer>' || w3 || '</answer>'
       WHEN role = 'assistant' THEN '<think>' || w5 || '</think><search>' || w5 || '</search>'
       WHEN role = 'user' AND i > 1 THEN '<information>' || text || '</information>' ELSE text END AS said FROM cl),
tr AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || said || '<|im_end|>' || chr(10), '' ORDER BY i) AS traj FROM cs GROUP BY conv_id)"""


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, rubric_idx, judge_text)``: five verdicts for each document, some unreadable, some missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    j = d.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rubric_idx"))
    k = F.col("item_id") * 5 + F.col("rubric_idx")
    score = F.element_at(F.array(F.lit("0"), F.lit("0.5"), F.lit("1")), (F.pmod(k * 7, F.lit(3)) + 1).cast("int"))
    text = F.when(k % 7 == 0, F.lit("no verdict here")).otherwise(F.concat(F.lit("<think>x</think><score>"), score, F.lit("</score>")))
    return j.where(k % 11 != 0).select("item_id", "rubric_idx", text.alias("judge_text"))


JUDGED = """
j0 AS (SELECT doc_id AS item_id, rubric_idx::INT AS rubric_idx, doc_id * 5 + rubric_idx AS k FROM documents, (SELECT unnest(range(5)) AS rubric_idx)),
j AS (SELECT item_id, rubric_idx, CASE WHEN k % 7 = 0 THEN 'no verdict here' ELSE '<think>x</think><score>' || (['0', '0.5', '1'])[(k * 7) % 3 + 1] || '</score>' END AS judge_text FROM j0 WHERE k % 11 <> 0)"""


def pick(id_col: str, salt: str, n: int) -> Column:
    """A number below ``n`` hashed from an id; ``picked`` is its SQL."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("int"), F.lit(n))


def picked(id_col: str, salt: str, n: int) -> str:
    return f"(('0x' || md5('{salt}|' || {id_col})[1:6])::INT % {n})"


def one_of(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def r6(x: Column) -> Column:
    """Rounded for comparison; adding zero turns minus zero into zero."""
    return F.round(x, 6) + F.lit(0.0)
