"""Search and correlation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.score import single_grade
from millrace.functions.text import let
from millrace.operators import retrieve as R
from millrace.operators.inverted import StoredIndex
from millrace.sources.io import shared_folder
from millrace.sources.views import JUDGED, ROLLOUTS, judgements, r6, rollouts, table


def j1_dense_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return R.dense_top_k(q, e, 3).select("query_id", "rank", "vec_id", r6(F.col("score")).alias("score"))


def _bench_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def s15_postings(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "benchmark"), "item_id")


def s15_stored_index(spark, sf_dir):
    """An index of all documents in blocks, stored, and searched for each benchmark text without the blocks that cannot matter."""
    index = StoredIndex.build(table(spark, sf_dir, "documents"), shared_folder(spark, "index"))
    return index.search(_bench_queries(spark, sf_dir), 3).select("query_id", "rank", "doc_id", r6(F.col("score")).alias("score"))


def j2_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.bm25(_bench_queries(spark, sf_dir), R.postings(docs), 3, stats=R.lengths(docs)).select("query_id", "rank", "doc_id", r6(F.col("score")).alias("score"))


def s3_fetch(spark, sf_dir):
    wanted = spark.createDataFrame([(0, [5, 3, 5]), (1, [7]), (2, [10**9])], "request int, ids array<bigint>")
    return R.fetch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), wanted).select("request", F.col("pos").cast("int").alias("pos"), "doc_id", "n_chars")


def _fan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(F.lit("q"), i.cast("string"))).alias("queries"))


def j3_fan_out_in(spark, sf_dir):
    tasks = _fan(spark, sf_dir)
    answers = R.fan_out(tasks).where("task_id % 10 <> 0 OR pos > 0").select("task_id", "pos", F.upper("query").alias("answer"))
    return R.fan_in(tasks, answers).select("task_id", F.array_join("answers", ",").alias("answers"), "error")


def j4_grades_to_items(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lit(5).alias("n_rubrics"))
    grades = judgements(spark, sf_dir).select("item_id", "rubric_idx", single_grade(F.col("judge_text")).alias("grade"))
    return R.grades_to_items(items, grades).select("item_id", "rubric_idx", "grade")


def j6_regroup(spark, sf_dir):
    return R.regroup(rollouts(spark, sf_dir).select("row_id"), 4)


def j7_semi_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    kept = R.only(d, labels, "doc_id").withColumn("handled", F.lit(True))
    return kept.unionByName(R.without(d, labels, "doc_id").withColumn("handled", F.lit(False)))


def j8_ngram_membership(spark, sf_dir):
    """Documents that hold a five-word sequence of a benchmark text."""
    fives = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(5)), " "))
    grams = lambda t: F.explode(let(F.split(t, " "), fives))
    d = table(spark, sf_dir, "documents").select("doc_id", grams("text").alias("g"))
    b = table(spark, sf_dir, "benchmark").select(grams("text").alias("g")).distinct()
    return d.join(b, "g", "left_semi").groupBy("doc_id").agg(F.countDistinct("g").alias("n"))


def j9_baseline_join(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    base = b.where("item_id % 3 <> 0").select("item_id", F.md5("text").alias("baseline"))
    return b.where("item_id % 2 = 0").select("item_id").join(base, "item_id")


def x14_search_status(spark, sf_dir):
    k = F.col("row_id") % 4
    error = F.when(k == 0, "api").when(k == 1, "parse")
    return rollouts(spark, sf_dir).select("row_id", R.search_status(k - 2, error).alias("status"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "jsx" and k[1:2].isdigit() and callable(v)}

SQL = {
    "j1_dense_top_k": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) + 0.0 AS score FROM k WHERE rank <= 3",
    "s15_postings": "WITH w AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS ws FROM benchmark), x AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) SELECT doc_id, term, count(*) AS tf, any_value(dl)::INT AS dl FROM x GROUP BY doc_id, term",
    "j2_bm25": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS ws FROM documents), x AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w), p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM x GROUP BY ALL),
st AS (SELECT count(DISTINCT doc_id) AS n, (SELECT avg(dl) FROM (SELECT DISTINCT doc_id, dl FROM p)) AS a FROM p), q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / a)) * qtf) AS score FROM p JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) + 0.0 AS score FROM k WHERE rank <= 3""",
    "s3_fetch": "SELECT request::INT AS request, pos::INT AS pos, doc_id, n_chars FROM (VALUES (0, 0, 5), (0, 1, 3), (0, 2, 5), (1, 0, 7)) w(request, pos, doc_id) JOIN documents USING (doc_id)",
    "j3_fan_out_in": "SELECT doc_id AS task_id, array_to_string(list_transform(list_filter(range(doc_id % 3 + 1), lambda i: doc_id % 10 <> 0 OR i > 0), lambda i: 'Q' || i), ',') AS answers, CASE WHEN doc_id % 10 = 0 THEN 'count mismatch' END AS error FROM documents",
    "j4_grades_to_items": f"WITH {JUDGED} SELECT j0.item_id, j0.rubric_idx, try_cast(nullif(regexp_extract(judge_text, '<score>([0-9.]+)</score>', 1), '') AS DOUBLE) AS grade FROM j0 LEFT JOIN j ON j.item_id = j0.item_id AND j.rubric_idx = j0.rubric_idx",
    "j6_regroup": f"WITH {ROLLOUTS} SELECT row_id, unnest(range(4))::INT AS attempt FROM r",
    "j7_semi_filter": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS handled FROM documents",
    "j8_ngram_membership": "WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), b AS (SELECT string_split(text, ' ') AS w FROM benchmark), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d)), bg AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b)) SELECT doc_id, count(*) AS n FROM dg SEMI JOIN bg USING (g) GROUP BY doc_id",
    "j9_baseline_join": "SELECT item_id, md5(text) AS baseline FROM benchmark WHERE item_id % 2 = 0 AND item_id % 3 <> 0",
    "x14_search_status": f"WITH {ROLLOUTS} SELECT row_id, (['api_error', 'processing_error', 'no_results', 'success'])[row_id % 4 + 1] AS status FROM r",
}
SQL["s15_stored_index"] = SQL["j2_bm25"]
