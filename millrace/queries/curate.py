"""Filters and caps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.sources.views import JUDGED, ROLLOUTS, judgements, rollouts, table


def f1_prompt_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return C.filter_length(d, F.col("n_chars"), 2000).select("doc_id", "n_chars")


def f2_token_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("n_words", F.size(F.split("text", " ")))
    return C.filter_length(d, F.col("n_words"), 300).select("doc_id", "n_words")


def f3_quality_gates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    tag = lambda v: F.concat(F.lit("<think>x</think><score>"), v.cast("string"), F.lit("</score>"))
    gates = F.array(F.struct(F.lit("entity").alias("gate"), tag(F.col("quality")).alias("judge_text")), F.struct(F.lit("source_relevance").alias("gate"), tag(1 - F.col("toxic")).alias("judge_text")))
    judged = labels.select(F.col("doc_id").alias("item_id"), F.explode(gates).alias("x")).select("item_id", "x.*")
    return C.filter_quality(items, judged, C.parse_gates("entity,source_relevance"), 2)


def f4_difficulty_band(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("difficulty_score", F.pmod("row_id", F.lit(11)) / 10.0)
    return C.filter_difficulty(r, 0.2, 0.8).select("row_id", "difficulty_score")


def _tasks(spark, sf_dir):
    k = F.col("row_id") % 13
    return rollouts(spark, sf_dir).select("row_id", F.when(k % 3 == 1, F.array(F.lit("gold"))).when(k % 3 == 2, F.array().cast("array<string>")).alias("target"), F.slice(F.array(*[F.lit(str(i)) for i in range(12)]), F.lit(1), k.cast("int")).alias("rubrics"))


def f5_needs_rubrics(spark, sf_dir):
    return C.needs_rubrics(_tasks(spark, sf_dir)).select("row_id")


def f6_rubric_count(spark, sf_dir):
    return C.rubric_count_gate(_tasks(spark, sf_dir)).select("row_id", F.size("rubrics").alias("n"))


def f7_early_reject(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return r.select("row_id", F.when((F.col("row_id") % 3 != 0) | (F.col("row_id") % 2 != 0), 0.0).otherwise(F.col("score")).alias("reward"))


def f8_skip_grading(spark, sf_dir):
    k = F.col("row_id")
    return rollouts(spark, sf_dir).select("row_id", C.skip_grading(k % 5, k % 7, k % 11 == 0, k % 13 == 0).alias("skip"))


def f9_parse_gates(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(C.parse_gates(" retrieval, entity "))), "pos int, gate string")


def w14_cap_per_source(spark, sf_dir):
    return C.cap_per_source(rollouts(spark, sf_dir), 40, 9).select("row_id", "data_source")


def w15_cap_per_prompt(spark, sf_dir):
    r = rollouts(spark, sf_dir).withColumn("src", F.when(F.col("row_id") % 17 != 0, F.col("uid")))
    first, later = r.where("row_id < 5000"), r.where("row_id >= 5000")
    kept = C.cap_per_prompt(first, 20, "src", "row_id")
    more = C.cap_per_prompt(later, 20, "src", "row_id", C.carry(kept, "src"))
    return kept.unionByName(more).select("row_id")


def w16_turn_index(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    return t.select("conv_id", F.size("ts").alias("n"), F.posexplode("ts").alias("pos", "x")).select("conv_id", F.col("pos").cast("int").alias("pos"), (F.col("pos") == F.col("n") - 1).alias("is_last"))


def r2_continue_rule(spark, sf_dir):
    n = rollouts(spark, sf_dir).count()
    return spark.createDataFrame([(t, C.continue_generating(n, t), C.generations_needed(n, t, 100)) for t in (n - 1, n, n + 50, n + 200)], "target long, go boolean, speculate boolean")


def r7_judge_retry(spark, sf_dir):
    """A second verdict is used only where the first one cannot be read."""
    from millrace.functions.score import single_grade

    j = judgements(spark, sf_dir)
    again = j.select("item_id", "rubric_idx", F.lit("<score>0.5</score>").alias("retry"))
    rows = j.join(again, ["item_id", "rubric_idx"])
    return rows.select("item_id", "rubric_idx", F.coalesce(single_grade(F.col("judge_text")), single_grade(F.col("retry"))).alias("grade"))


def x6_force_answer(spark, sf_dir):
    """Rows without an answer get the regenerated one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("<think>x</think>")).otherwise(F.lit("<answer>a</answer>")).alias("x"))
    return d.select("doc_id", F.coalesce(T.solver_answer(F.col("x")), T.solver_answer(F.lit("<answer>forced</answer>"))).alias("answer"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "fwrx" and k[1:2].isdigit() and callable(v)}

_T = f"WITH {ROLLOUTS}, k AS (SELECT row_id, row_id % 13 AS k FROM r)"

SQL = {
    "f1_prompt_length": "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000",
    "f2_token_length": "SELECT doc_id, len(string_split(text, ' '))::INT AS n_words FROM documents WHERE len(string_split(text, ' ')) <= 300",
    "f3_quality_gates": "SELECT doc_id AS item_id, quality AS quality_entity_score, 1 - toxic AS quality_source_relevance_score, quality + 1 - toxic AS quality_sum FROM documents JOIN labels USING (doc_id) WHERE quality + 1 - toxic >= 2",
    "f4_difficulty_band": f"WITH {ROLLOUTS} SELECT row_id, (row_id % 11) / 10.0::DOUBLE AS difficulty_score FROM r WHERE row_id % 11 BETWEEN 2 AND 8",
    "f5_needs_rubrics": _T + " SELECT row_id FROM k WHERE k % 3 <> 1 AND k = 0",
    "f6_rubric_count": _T + " SELECT row_id, least(k, 12)::INT AS n FROM k WHERE k BETWEEN 3 AND 10",
    "f7_early_reject": f"WITH {ROLLOUTS} SELECT row_id, CASE WHEN row_id % 3 <> 0 OR row_id % 2 <> 0 THEN 0.0 ELSE score END AS reward FROM r",
    "f8_skip_grading": f"WITH {ROLLOUTS} SELECT row_id, row_id % 5 = 0 OR row_id % 7 = 0 OR row_id % 11 = 0 OR row_id % 13 = 0 AS skip FROM r",
    "f9_parse_gates": "SELECT * FROM (VALUES (0::INT, 'retrieval'), (1, 'entity')) v(pos, gate)",
    "w14_cap_per_source": f"WITH {ROLLOUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY md5('9|' || row_id), row_id) AS rk FROM r) SELECT row_id, data_source FROM k WHERE rk <= 40",
    "w15_cap_per_prompt": f"WITH {ROLLOUTS}, k AS (SELECT row_id, row_number() OVER (PARTITION BY uid ORDER BY row_id) AS rk FROM r WHERE row_id % 17 <> 0), a AS (SELECT row_id, rk FROM k) SELECT row_id FROM a WHERE rk <= 20 UNION ALL SELECT row_id FROM r WHERE row_id % 17 = 0",
    "w16_turn_index": "WITH k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, pos::INT AS pos, pos = n - 1 AS is_last FROM k",
    "r2_continue_rule": "WITH n AS (SELECT count(*) AS n FROM events) SELECT n + d AS target, n < n + d AS go, n + 100 < n + d AS speculate FROM n, (SELECT unnest([-1, 0, 50, 200]) AS d)",
    "r7_judge_retry": f"WITH {JUDGED} SELECT item_id, rubric_idx, coalesce(try_cast(nullif(regexp_extract(judge_text, '<score>([0-9.]+)</score>', 1), '') AS DOUBLE), 0.5) AS grade FROM j",
    "x6_force_answer": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'forced' ELSE 'a' END AS answer FROM documents",
}
