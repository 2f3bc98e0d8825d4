"""Validation, sinks, hooks and registries, and their SQL."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import maps
from millrace.functions import text as T
from millrace.functions.timed import timed_scorer
from millrace.operators import validate as V
from millrace.operators.batch import fit
from millrace.operators.chatrow import chat_rows
from millrace.plans.stages import run_stages
from millrace.sources import io
from millrace.sources.io import shared_folder
from millrace.sources.views import JUDGED, ROLLOUTS, TRAJ, judgements, pick, picked, r6, rollouts, table, trajectories


def _folder(spark) -> str:
    return shared_folder(spark, "io")


def _bad(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(5))
    turn = lambda x: F.concat(F.lit("<|im_start|>assistant\n"), x, F.lit("<|im_end|>"))
    good = turn(F.lit("<think>t</think><search>q</search>"))
    last = F.when(k == 0, "<think>t</think><answer>a</answer>").when(k == 1, "<think>t</think><answer>a").when(k == 2, "<think>t</think><answer> </answer>").when(k == 3, "<answer>a</answer>")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.concat(good, turn(last)), F.lit("nothing")).alias("x"))


def d7_token_budget(spark, sf_dir):
    b = V.token_budget(F.col("traj"), 4, 2)
    t = trajectories(spark, sf_dir).select("conv_id", b.alias("b"))
    return t.select("conv_id", F.col("b.think_budget_violations").alias("violations"), F.col("b.answer_over_limit").alias("over"))


def d16_record_errors(spark, sf_dir):
    return _bad(spark, sf_dir).select("doc_id", F.array_join(V.record_errors(F.col("x")), "; ").alias("errors"))


def x1_turn_errors(spark, sf_dir):
    return _bad(spark, sf_dir).select("doc_id", F.array_join(V.tag_errors(F.col("x"), "answer"), "; ").alias("errors"))


def x5_python_calls(spark, sf_dir):
    x = F.concat(F.lit("go search(query_list=[\"a "), F.col("n_name"), F.lit("\", 'b']) end"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(V.python_style_queries(x), "|").alias("queries"))


def x7_usage(spark, sf_dir):
    calls = judgements(spark, sf_dir).select("item_id", "rubric_idx", F.length("judge_text").alias("tokens"))
    return V.usage_records(calls).select("item_id", "n_calls", "tokens", F.col("calls")[0]["rubric_idx"].alias("first"))


def x9_stage_chain(spark, sf_dir):
    """Length, quality and cap filters chained."""
    from millrace.operators.curate import cap_per_source

    d = table(spark, sf_dir, "documents")
    return V.chain(d, lambda x: x.where("n_chars <= 4000"), lambda x: x.where("lang = 'en'"), lambda x: cap_per_source(x, 5, 1, "source", "doc_id")).select("doc_id")


def _reply(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: hashlib.md5(p.encode()).hexdigest()[:6])


def x15_generate(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.col("n_name").alias("prompt"))
    return V.generate(p, _reply, 3).select("row_id", F.array_join("responses", ",").alias("responses"))


def x20_rolling_context(spark, sf_dir):
    lens = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.pmod(F.col("row_id") + i, F.lit(4)) + 1).cast("int"))
    return rollouts(spark, sf_dir).select("row_id", V.rolling_context(lens, 7).alias("first"))


def x20_chat_rows(spark, sf_dir):
    """Conversations as training rows of at most 40 prompt, 60 response and 90 tokens in all."""
    t = trajectories(spark, sf_dir).select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return chat_rows(t, 40, 60, 90).select("conv_id", digest("prompt").alias("prompt"), digest("response").alias("response"), digest("loss_mask").alias("loss_mask"), F.size("positions").alias("n"))


def s8_write_tasks(spark, sf_dir):
    at = _folder(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.struct(F.array("text").alias("target")).alias("ground_truth"))
    io.write_tasks(rows, at)
    return spark.read.schema(rows.schema).parquet(at).select("item_id", F.md5(F.col("ground_truth.target")[0]).alias("target"))


def s9_trajectory_jsonl(spark, sf_dir):
    at = _folder(spark)
    rows = trajectories(spark, sf_dir).select("conv_id", "traj")
    io.write_jsonl(rows, at)
    return io.read_jsonl(spark, at, "conv_id long, traj string").select("conv_id", F.md5("traj").alias("traj"))


def s10_step_dump(spark, sf_dir):
    at = _folder(spark)
    rows = rollouts(spark, sf_dir).select("row_id", "score", F.pmod("row_id", F.lit(3)).alias("step"))
    io.write_jsonl(rows, at, by="step")
    return io.read_jsonl(spark, at, "row_id long, score double, step long").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last"))


def _encode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), float(t.count("e")), 1.0])


def s14_encode(spark, sf_dir):
    """The encoder hook with a stand-in model: length, letters e and a constant, normalised."""
    v = io.encode(table(spark, sf_dir, "benchmark"), _encode)
    return v.select("item_id", *[r6(F.col("v")[i]).alias(f"v{i}") for i in range(3)])


def s2_read_jsonl(spark, sf_dir):
    """Any rows read back from JSON lines by their schema; blank texts and nulls stay apart."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    io.write_jsonl(rows, at)
    back = io.read_jsonl(spark, at, rows.schema)
    return back.select("doc_id", F.md5("text").alias("text"), "lang", "n_chars")


def s14_index_table(spark, sf_dir):
    """An index built as a table of unit vectors of prefixed texts, and read back."""
    at = _folder(spark)
    index = io.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"), at, _encode)
    return index.select("doc_id", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length"), F.round(F.col("v")[1].cast("double") / F.col("v")[2], 2).alias("n_e"))


def x16_fit(spark, sf_dir):
    """Token lists padded or cut to one length, on either side."""
    ids = F.transform(F.sequence(F.lit(1), F.col("len").cast("int")), lambda t: F.col("row_id") + t)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    r = rollouts(spark, sf_dir).withColumn("ids", ids)
    return r.select("row_id", text(fit("ids", 6, 0)).alias("right"), text(fit("ids", 6, 0, left=True, keep_end=True)).alias("left"))


def u2_reward_managers(spark, sf_dir):
    """The same rollouts under each registered manager: reward on the last token."""
    r = rollouts(spark, sf_dir).withColumn("solution", F.when(pick("row_id", "fails", 5) == 0, F.lit("")).otherwise(F.concat(F.lit("v"), F.col("row_id").cast("string"))))
    out = None
    for name in V.managers():
        rows = V.reward(name, r, lambda x: float(x[1:]) % 7).select(F.lit(name).alias("manager"), "row_id", r6(F.col("reward")).alias("reward"))
        out = rows if out is None else out.unionByName(rows)
    return out


def x24_stages(spark, sf_dir):
    """Three stages run twice: the second time from what the first one left."""
    at = _folder(spark)
    calls = []
    stages = [("long", lambda d: d.where("n_chars > 200")), ("lengths", lambda d: d.select("source", "n_chars")), ("totals", lambda d: d.groupBy("source").agg(F.sum("n_chars").alias("n")))]
    counted = [(name, lambda d, f=f, name=name: (calls.append(name), f(d))[1]) for name, f in stages]
    for _ in range(2):
        out = run_stages(table(spark, sf_dir, "documents"), counted, at)
    return out.withColumn("runs", F.lit(len(calls)))


def s16_vector_table(spark, sf_dir):
    at = _folder(spark)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e.write.parquet(at)
    return spark.read.schema(e.schema).parquet(at).select("vec_id", F.size("embedding").alias("dim"))


def p4_descriptions(spark, sf_dir):
    """A folder of description files read as name and text."""
    at = _folder(spark)
    table(spark, sf_dir, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit("\n"), "r_name").alias("value")).write.option("lineSep", "\u0001").text(at)
    rows = spark.read.option("lineSep", "\u0001").text(at)
    return rows.select(F.substring_index("value", "\n", 1).cast("int").alias("name"), F.substring_index("value", "\n", -1).alias("description"))


def u1_reward_registry(spark, sf_dir):
    reg = V.RewardRegistry()
    reg.register("em", lambda x, g: T.exact_match(x, F.array(g)))
    reg.register_batch("ratio", lambda x, g: len(x) / len(g))
    b = table(spark, sf_dir, "nation")
    gold = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(""))
    return b.select("n_nationkey", reg.score("em", F.lower("n_name"), F.col("n_name")).alias("em"), reg.score("ratio", F.col("n_name"), gold).alias("ratio"))


def _slow_scorer(text: str, way: int) -> float:
    if way == 0:  # never ends
        while True:
            pass
    if way == 1:  # takes its process along
        os._exit(1)
    if way == 2:
        raise ValueError("no score")
    return float(len(text))


def u8_timed_scores(spark, sf_dir):
    """Lengths of documents by a scorer that hangs, ends its process or raises on a few of them."""
    scored = timed_scorer(_slow_scorer, seconds=0.2)
    way = F.when(F.col("doc_id") % 997 == 5, 0).when(F.col("doc_id") % 499 == 7, 1).when(F.col("doc_id") % 97 == 9, 2).otherwise(3)
    return table(spark, sf_dir, "documents").select("doc_id", scored(F.coalesce("text", F.lit("")), way).alias("score"))


def _props():
    return F.from_json("props", "map<string,string>")


def _spelled(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def x21_merge(spark, sf_dir):
    """Properties of events merged with a map that shares a key of equal value."""
    e = table(spark, sf_dir, "events")
    other = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), _props()["k"])).otherwise(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    return e.select("event_id", _spelled(maps.merge(_props(), other)).alias("merged"))


def x21_append(spark, sf_dir):
    """Properties of each user's events, every name with its values in order of the events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.map_concat(_props(), F.create_map(F.col("event_type"), F.col("event_id").cast("string"))).alias("metrics"))
    out = maps.append(e, "user_id", "event_id")
    return out.select("user_id", F.md5(_spelled(F.transform_values("metrics", lambda k, v: F.array_join(v, " ")))).alias("metrics"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "dxspu" and k[1:2].isdigit() and callable(v)}

SQL = {
    "d16_record_errors": "SELECT doc_id, (['', 'turn 2: Unclosed <answer> tag', 'turn 2: Empty <answer> tag', 'turn 2: Missing <think> tag', 'no assistant turn'])[doc_id % 5 + 1] AS errors FROM documents",
    "x1_turn_errors": "SELECT doc_id, (['', 'Unclosed <answer> tag', 'Empty <answer> tag', '', 'Missing <answer> tag'])[doc_id % 5 + 1] AS errors FROM documents",
    "x5_python_calls": "SELECT n_nationkey, 'a ' || n_name || '|b' AS queries FROM nation",
    "x7_usage": f"WITH {JUDGED} SELECT item_id, count(*) AS n_calls, sum(length(judge_text))::BIGINT AS tokens, min(rubric_idx)::INT AS first FROM j GROUP BY 1",
    "x9_stage_chain": "WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id), doc_id) AS rk FROM documents WHERE n_chars <= 4000 AND lang = 'en') SELECT doc_id FROM k WHERE rk <= 5",
    "x15_generate": "SELECT n_nationkey::BIGINT AS row_id, md5(n_name || '#0')[1:6] || ',' || md5(n_name || '#1')[1:6] || ',' || md5(n_name || '#2')[1:6] AS responses FROM nation",
    "x20_rolling_context": f"WITH {ROLLOUTS}, m AS (SELECT row_id, i, sum((row_id + i) % 4 + 1) OVER (PARTITION BY row_id ORDER BY i DESC) AS used FROM r, (SELECT unnest(range(6)) AS i)) SELECT row_id, coalesce(min(i) FILTER (used <= 7), 6)::INT AS first FROM m GROUP BY 1",
    "s8_write_tasks": "SELECT item_id, md5(text) AS target FROM benchmark",
    "s9_trajectory_jsonl": "WITH " + TRAJ + " SELECT conv_id, md5(traj) AS traj FROM tr",
    "s10_step_dump": f"WITH {ROLLOUTS} SELECT row_id % 3 AS step, count(*) AS n, max(row_id) AS last FROM r GROUP BY 1",
    "s14_encode": "WITH v AS (SELECT item_id, (length(text) + 9)::DOUBLE AS a, (length('passage: ' || text) - length(replace('passage: ' || text, 'e', '')))::DOUBLE AS b FROM benchmark), n AS (SELECT *, sqrt(a * a + b * b + 1) AS n FROM v) SELECT item_id, round(a / n, 6) + 0.0 AS v0, round(b / n, 6) + 0.0 AS v1, round(1 / n, 6) + 0.0 AS v2 FROM n",
    "s2_read_jsonl": "SELECT doc_id, md5(text) AS text, lang, n_chars FROM documents",
    "s14_index_table": "SELECT doc_id, 1.0::DOUBLE AS length, (length('passage: ' || coalesce(text, '')) - length(replace('passage: ' || coalesce(text, ''), 'e', '')))::DOUBLE AS n_e FROM documents",
    "x16_fit": f"WITH {ROLLOUTS}, i AS (SELECT row_id, list_transform(range(1, len + 1), lambda t: row_id + t) AS ids, len FROM r) SELECT row_id, array_to_string((ids || [0, 0, 0, 0, 0, 0])[1:6], ',') AS right, array_to_string(([0, 0, 0, 0, 0, 0] || ids)[len + 1:len + 6], ',') AS left FROM i",
    "u2_reward_managers": f"WITH {ROLLOUTS}, s AS (SELECT row_id, CASE WHEN {picked('row_id', 'fails', 5)} = 0 THEN 0.0 ELSE (row_id % 7)::DOUBLE END AS score, len FROM r) SELECT manager, row_id, round(CASE WHEN manager = 'dapo' THEN score + least(-(len - 12) / 4.0, 0.0) ELSE score END, 6) + 0.0 AS reward FROM s, (SELECT unnest(['naive', 'batch', 'dapo', 'prime']) AS manager)",
    "x24_stages": "SELECT source, sum(n_chars)::BIGINT AS n, 3::INT AS runs FROM documents WHERE n_chars > 200 GROUP BY source",
    "s16_vector_table": "SELECT vec_id, len(embedding)::INT AS dim FROM embeddings",
    "p4_descriptions": "SELECT r_regionkey::INT AS name, r_name AS description FROM region",
    "u1_reward_registry": "SELECT n_nationkey, 1.0::DOUBLE AS em, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ratio FROM nation",
    "u8_timed_scores": "SELECT doc_id, CASE WHEN doc_id % 997 = 5 OR doc_id % 499 = 7 OR doc_id % 97 = 9 THEN 0.0 ELSE coalesce(length(text), 0) END::DOUBLE AS score FROM documents",
    "x21_merge": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || (props::JSON ->> 'k') || ',type=' || event_type ELSE 'k=' || (props::JSON ->> 'k') || ',type=' || event_type || ',user=' || user_id END AS merged FROM events",
    "x21_append": "WITH c AS (SELECT user_id, event_id, 'k' AS name, props::JSON ->> 'k' AS v FROM events UNION ALL SELECT user_id, event_id, event_type, event_id::VARCHAR FROM events), l AS (SELECT user_id, name || '=' || string_agg(v, ' ' ORDER BY event_id) AS s FROM c GROUP BY user_id, name) SELECT user_id, md5(string_agg(s, ',' ORDER BY s)) AS metrics FROM l GROUP BY user_id",
    "x20_chat_rows": f"""WITH {TRAJ}, k AS (SELECT conv_id, i, role, ['<|im_start|>', role] || regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') || ['<|im_end|>'] AS toks FROM ct),
f AS (SELECT conv_id, min(i) FILTER (role = 'assistant') AS first FROM k GROUP BY 1),
c AS (SELECT conv_id, i, unnest(toks) AS tok, generate_subscripts(toks, 1) AS j, role, first FROM k JOIN f USING (conv_id)),
d AS (SELECT conv_id, tok, (role = 'assistant' AND j > 2)::INT AS loss, (first IS NULL OR i < first OR (i = first AND j <= 2)) AS pre, row_number() OVER (PARTITION BY conv_id ORDER BY i, j) AS place FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pre ORDER BY place) AS up, row_number() OVER (PARTITION BY conv_id, pre ORDER BY place DESC) AS down FROM d),
z AS (SELECT conv_id, least(count(*) FILTER (NOT pre), 60) AS nr FROM n GROUP BY 1),
q AS (SELECT n.*, nr FROM n JOIN z USING (conv_id) WHERE CASE WHEN pre THEN down <= least(40, 90 - nr) ELSE up <= 60 END)
SELECT conv_id, md5(coalesce(string_agg(tok, ' ' ORDER BY place) FILTER (pre), '')) AS prompt, md5(coalesce(string_agg(tok, ' ' ORDER BY place) FILTER (NOT pre), '')) AS response, md5(string_agg(CASE WHEN pre THEN '0' ELSE loss::VARCHAR END, ' ' ORDER BY place)) AS loss_mask, count(*)::INT AS n FROM q GROUP BY conv_id""",
    "d7_token_budget": rf"""WITH {TRAJ}, b AS (SELECT conv_id, list_filter(list_transform(regexp_extract_all(traj, '(?s)<think>(.*?)</think>', 1), lambda x: trim(x, chr(10) || chr(9) || ' ')), lambda x: x <> '') AS th, list_filter(list_transform(regexp_extract_all(traj, '(?s)<answer>(.*?)</answer>', 1), lambda x: trim(x, chr(10) || chr(9) || ' ')), lambda x: x <> '') AS an FROM tr)
SELECT conv_id, len(list_filter(th, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]')) > 4))::INT AS violations, coalesce(len(regexp_extract_all(an[-1], '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]')), 0) > 2 AS over FROM b""",
}
