"""Rendering of prompts and training rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import render as R
from millrace.sources import benchmarks as B
from millrace.sources import io
from millrace.sources.benchfolder import Layout, PromptFormat, load_folder, prompt_text
from millrace.sources.io import shared_folder
from millrace.sources.views import ROLLOUTS, TOKENS, TRAJ, r6, rollouts, table, token_rows, trajectories

TYPES = ["short_form_qa", "long_form_qa", "report"]


def s1_corpus(spark, sf_dir):
    """Documents as contents strings, split into title and body."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("contents"))
    return d.select("doc_id", F.md5(F.substring_index("contents", "\n", 1)).alias("title"), F.length(F.regexp_replace("contents", r"(?s)\A[^\n]*\n?", "")).alias("body_chars"))


def s4_union_scan(spark, sf_dir):
    return io.read_tables(spark, f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet").select("n_nationkey", "r_regionkey", "n_name", "r_name")


def s5_nested_scan(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.struct(F.col("text").alias("question"), F.length("text").alias("answer")).alias("extra"))
    return io.project(t, item_id="item_id", prompt="extra.question", response="extra.answer")


def s6_multi_turn_scan(spark, sf_dir):
    return trajectories(spark, sf_dir).select("conv_id", F.size("turns").alias("n_turns"))


def s7_preference_scan(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt"), F.lit("good").alias("chosen"), F.lit("bad").alias("rejected"))
    return io.preference_rows(b).select("prompt", "side", "response")


def s13_eight_sets(spark, sf_dir):
    """All eight evaluation sets, each made of an eighth of the benchmark texts, in one table."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")
    part = lambda k, *columns: b.where(F.pmod("idx", F.lit(8)) == k).select("idx", *columns)
    text, none = F.col("text"), F.lit(None).cast("string")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    talk = F.array(said("user", text), said("assistant", F.lit("yes?")), said("user", F.repeat(text, 9)))
    graded = F.array(F.struct(text.alias("criterion"), F.lit(2.0).alias("points"), F.array(F.lit("t")).alias("tags")))
    weighed = F.array(F.struct(text.alias("criterion"), F.lit(0.5).alias("weight"), F.lit("x").alias("axis")))
    answers = b.where(F.col("idx") % 3 > 0).select(F.col("idx").cast("string").alias("uid"), F.concat(F.lit("A "), "text").alias("answer"))
    rows = B.unite(
        B.healthbench(part(0, F.when(F.col("idx") % 5 > 0, talk).otherwise(F.slice(talk, 1, 0)).alias("prompt"), graded.alias("rubrics")), "P: "),
        B.researchqa(part(1, F.concat(F.lit(" "), text, F.lit("\n")).alias("query"), F.array(text).alias("rubric")), "Q: "),
        B.drb_race(part(2, F.when(F.col("idx") % 4 > 0, text).alias("prompt"), F.concat(F.lit("A "), "text").alias("topic")), "Q: "),
        B.sqa_cs_v2(part(3, text.alias("question")), "Q: "),
        B.researchrubrics(part(4, text.alias("prompt"), weighed.alias("rubrics")), "Q: "),
        B.research_plan_gen(part(5, text.alias("Goal"), F.array(text, F.lit("r")).alias("Rubric")), "Q: ", "Plan: "),
        B.arena_hard_cw(part(6, F.col("idx").cast("string").alias("uid"), F.when(F.col("idx") % 4 == 2, "creative_writing").otherwise("hard").alias("category"), text.alias("prompt")), answers),
        B.wildbench(part(7, talk.alias("conversation_input"), F.array(text).alias("checklist"), none.alias("primary_tag")), "P: "),
    )
    field = lambda name: F.get_json_object("ground_truth", f"$.{name}")
    detail = F.coalesce(field("healthbench_rubrics[0].criterion"), field("researchqa_rubric_items[0]"), field("drb_prompt"), field("sqa_question"), field("researchrubrics_rubrics[0].axis"), field("research_plan_gen_rubrics[1].weight"), field("arena_hard_baseline_answer"), field("wildbench_checklist[0]"))
    return rows.select("idx", "data_source", "ability", field("eval_type").alias("eval_type"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.size("prompt").alias("n_messages"), F.md5("question").alias("question"), F.md5(detail).alias("detail"))


def x22_benchmark_folder(spark, sf_dir):
    """Three raw sets of documents in a folder, stored in three ways and read by their layouts, one under a format of its own."""
    at = shared_folder(spark, "raw")
    d = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    part = lambda k: d.where(F.pmod("n", F.lit(3)) == k)
    part(0).select("n", F.col("text").alias("query"), F.array("text").alias("rubric")).write.json(f"{at}/research.jsonl")
    part(1).select("n", F.col("text").alias("asked")).write.parquet(f"{at}/science.parquet")
    part(2).select("n", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"), F.array(F.struct(F.col("text").alias("criterion"), F.lit(1.0).alias("points"), F.array(F.lit("t")).alias("tags"))).alias("rubrics")).write.orc(f"{at}/health.orc")
    layouts = [
        Layout("researchqa", "research.jsonl", "json", "n long, query string, rubric array<string>", {"idx": "n"}),
        Layout("sqa_cs_v2", "science.parquet", "parquet", "n long, asked string", {"idx": "n", "question": "asked"}),
        Layout("healthbench", "health.orc", "orc", "n long, prompt array<struct<role:string,content:string>>, rubrics array<struct<criterion:string,points:double,tags:array<string>>>", {"idx": "n"}),
    ]
    formats = {"short": PromptFormat("Q: ", "Talk: "), "thinking": PromptFormat("Think. Q: ", "Think. Talk: ")}
    rows = load_folder(spark, at, layouts, formats, {"healthbench": "thinking"}, "short")
    return rows.select("idx", "data_source", "ability", F.md5(prompt_text()).alias("prompt"))


def s13_benchmark_rows(spark, sf_dir):
    """Two benchmark sources projected to one schema and united."""
    b = table(spark, sf_dir, "benchmark")
    even = F.coalesce(F.col("item_id") % 2 == 0, F.lit(False))
    one = b.where(even).select(*R.task_row(F.lit("eval_points"), F.col("text"), "rubric", "rule", F.lit(None).cast("array<string>"), F.col("item_id"), F.col("text"), F.array(F.lit("a"), F.lit("b"))))
    two = b.where(~even).select(*R.task_row(F.lit("eval_pair"), T.upper(F.col("text")), "rubric", "rule", F.array(F.lit("gold")), F.col("item_id"), F.col("text")))
    return one.unionByName(two).select("data_source", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.size(F.coalesce(F.col("reward_model.ground_truth.rubrics"), F.array().cast("array<string>"))).alias("n_rubrics"), F.col("extra_info.index").alias("idx"))


def p1_preprocess(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(R.preprocess_document(F.col("text"), 10_000)).alias("doc"))


def p2_template(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", R.fill("Use {name} of {brand}; {name}. {other}", name=F.col("p_name"), brand=F.col("p_brand")).alias("prompt"))


def p3_task_types(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", R.draw_task_type(F.col("row_id"), TYPES, 0.4, 5).alias("task_type"))


def p5_select_types(spark, sf_dir):
    kept = R.select_task_types({t: t.upper() for t in TYPES}, exclude=["report"])
    return spark.createDataFrame(sorted(kept.items()), "name string, description string")


def p6_parse_turns(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(R.parse_turns("4:3:2"))), "pos int, weight int")


def p7_turns_schedule(spark, sf_dir):
    return R.turns_schedule(spark, 1000, R.parse_turns("4:3:3"), 1).groupBy("turns").agg(F.count(F.lit(1)).alias("n"))


def p8_gold_rubric(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", R.gold_rubric(F.array("n_name", F.lower("n_name"))).alias("rubric"))


def p9_qa_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    # Fixed value: the tag before the source's name.
    rows = b.select(*R.task_row(F.concat(F.lit("searchR1_"), F.lit("nq")), F.col("text"), "fact-reasoning", "rule", F.array("text"), F.col("item_id"), F.col("text")))
    return rows.select("data_source", "ability", F.col("reward_model.style").alias("style"), F.col("extra_info.index").alias("idx"))


def p11_numbered(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("x")).select("n_regionkey", R.numbered(F.col("x")).alias("rubrics"))


def p12_passages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(R.passages(F.array(F.concat(F.lit("T\n"), F.col("lang")), F.concat(F.lit("U\n"), F.col("source"))))).alias("text"))


def p13_join_results(spark, sf_dir):
    d = table(spark, sf_dir, "nation")
    return d.select("n_nationkey", R.join_results(F.array("n_name", "n_name"), 12).alias("wrapped"), R.join_results(F.array("n_name", "n_name"), 12, raw=True).alias("raw"))


def p14_flatten(spark, sf_dir):
    k = F.col("doc_id")
    roll = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.pmod(k + i, F.lit(2))).cast("int").alias("tool"), F.pmod(k * 3 + i, F.lit(3)).cast("int").alias("structure"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    return R.flatten_rollouts(table(spark, sf_dir, "documents").select(k.alias("item_id"), roll.alias("rollouts")))


def p15_per_turn_prompts(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    turns = T.search_turns(F.col("traj"))
    prompts = R.per_turn_prompts(F.lit("task"), F.lit("src"), turns, T.all_documents(F.col("traj")), "I {task_prompt} {documents}", "T {search_query}", "S {task_prompt}")
    return t.select("conv_id", F.explode(prompts).alias("x")).select("conv_id", "x.stage", F.md5(F.col("x.prompt")).alias("prompt"))


def p16_teacher(spark, sf_dir):
    k = F.col("doc_id") % 3
    x = R.teacher_prompt(F.lit("P"), F.when(k == 0, "<think> good </think>").otherwise("none"), F.when(k == 1, F.array(F.lit("e1"), F.lit("e2"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("prompt"))


def p17_rl_row(spark, sf_dir):
    r = token_rows(spark, sf_dir).select("row_id", F.sequence(F.lit(0).cast("long"), F.pmod("row_id", F.lit(12))).alias("ids"))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("row_id", *[show(R.truncate(F.col("ids"), 5, how)).alias(how + "_cut") for how in ("left", "right", "middle")])


def p18_sft_mask(spark, sf_dir):
    m = R.sft_mask((F.col("row_id") % 5 + 1).cast("int"), F.col("len").cast("int"))
    return rollouts(spark, sf_dir).select("row_id", F.array_join(F.transform(m, lambda x: x.cast("string")), "").alias("mask"))


def p19_multi_turn_mask(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    m = R.multi_turn_mask(F.col("turns"))
    return t.select("conv_id", F.size(m).alias("n"), F.aggregate(m, F.lit(0), lambda s, x: s + x).alias("n_loss"))


def p19_tool_runs(spark, sf_dir):
    return R.tool_runs(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "run")


def p20_split_media(spark, sf_dir):
    x = F.concat(F.lit("a<image>"), F.col("n_name"), F.lit("<video><image>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(R.split_media(x), "|").alias("parts"))


def x12_mean_pool(spark, sf_dir):
    r = token_rows(spark, sf_dir).select("row_id", F.arrays_zip("logp", "adv").alias("z"), "mask").select("row_id", "mask", F.transform("z", lambda x: F.array(x["logp"], x["adv"])).alias("vs"))
    v = io.mean_pool("vs", "mask")
    return r.select("row_id", r6(v[0]).alias("a"), r6(v[1]).alias("b"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "spx" and k[1:2].isdigit() and callable(v)}

_U = "('0x' || substr(md5('5|{s}|' || row_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"

SQL = {
    "s1_corpus": "SELECT doc_id, md5(string_split(text, chr(10))[1]) AS title, (CASE WHEN contains(text, chr(10)) THEN length(text) - instr(text, chr(10)) ELSE 0 END)::INT AS body_chars FROM documents",
    "s4_union_scan": "SELECT n_nationkey, NULL::INT AS r_regionkey, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, r_regionkey, NULL, r_name FROM region",
    "s5_nested_scan": "SELECT item_id, text AS prompt, length(text)::INT AS response FROM benchmark",
    "s6_multi_turn_scan": "SELECT conv_id, count(*)::INT AS n_turns FROM conversations GROUP BY 1",
    "s7_preference_scan": "SELECT item_id AS prompt, side, CASE side WHEN 'chosen' THEN 'good' ELSE 'bad' END AS response FROM benchmark, (SELECT unnest(['chosen', 'rejected']) AS side)",
    "s13_eight_sets": """WITH m AS (SELECT * FROM (VALUES (0, 'healthbench', 'medical-qa'), (1, 'researchqa', 'research-qa'), (2, 'drb_race', 'deep-research'), (3, 'sqa_cs_v2', 'scientific-qa'), (4, 'researchrubrics', 'deep-research'), (5, 'research_plan_gen', 'research-planning'), (6, 'arena_hard_cw', 'creative-writing'), (7, 'wildbench', 'instruction-following')) v(k, kind, ability)),
b AS (SELECT item_id AS idx, item_id % 8 AS k, text AS t, trim(text, ' ' || chr(10)) AS s, CASE WHEN item_id % 4 > 0 THEN text ELSE 'A ' || text END AS d FROM benchmark)
SELECT idx, 'eval_' || kind AS data_source, ability, kind AS eval_type, md5(CASE WHEN k IN (0, 7) THEN 'P: ' || t WHEN k = 2 THEN 'Q: ' || trim(d, ' ' || chr(10)) WHEN k = 5 THEN 'Q: Plan: ' || s WHEN k = 6 THEN s ELSE 'Q: ' || s END) AS prompt, CASE WHEN k IN (0, 7) THEN 3 ELSE 1 END::INT AS n_messages,
md5(CASE WHEN k IN (0, 7) THEN repeat(t, 9)[1:200] WHEN k = 1 THEN ' ' || t || chr(10) WHEN k = 2 THEN d ELSE t END) AS question, md5(CASE k WHEN 2 THEN d WHEN 4 THEN 'x' WHEN 5 THEN '1.0' WHEN 6 THEN 'A ' || t ELSE t END) AS detail
FROM b JOIN m USING (k) WHERE (k <> 0 OR idx % 5 > 0) AND (k <> 6 OR (idx % 4 = 2 AND idx % 3 > 0))""",
    "s13_benchmark_rows": "SELECT CASE WHEN item_id % 2 = 0 THEN 'eval_points' ELSE 'eval_pair' END AS data_source, md5(CASE WHEN item_id % 2 = 0 THEN text ELSE upper(text) END) AS prompt, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END::INT AS n_rubrics, item_id AS idx FROM benchmark",
    "p1_preprocess": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5('(Title: ' || l[1] || ')' || chr(10) || rtrim(coalesce(l[2], '')) || chr(10)) AS doc FROM l",
    "p2_template": "SELECT p_partkey, 'Use ' || p_name || ' of ' || p_brand || '; ' || p_name || '. {other}' AS prompt FROM part",
    "p3_task_types": f"WITH {ROLLOUTS} SELECT row_id, CASE WHEN {_U.format(s='short')} < 0.4 THEN 'short_form_qa' ELSE (['long_form_qa', 'report'])[floor({_U.format(s='other')} * 2)::INT + 1] END AS task_type FROM r",
    "p5_select_types": "SELECT * FROM (VALUES ('long_form_qa', 'LONG_FORM_QA'), ('short_form_qa', 'SHORT_FORM_QA')) v(name, description)",
    "p6_parse_turns": "SELECT pos::INT AS pos, weight::INT AS weight FROM (VALUES (0, 4), (1, 3), (2, 2)) v(pos, weight)",
    "p7_turns_schedule": "SELECT turns::INT AS turns, n::BIGINT AS n FROM (VALUES (1, 400), (2, 300), (3, 300)) v(turns, n)",
    "p8_gold_rubric": "SELECT n_nationkey, '\"' || n_name || '\"; \"' || lower(n_name) || '\"' AS rubric FROM nation",
    "p9_qa_rows": "SELECT 'searchR1_nq' AS data_source, 'fact-reasoning' AS ability, 'rule' AS style, item_id AS idx FROM benchmark",
    "p11_numbered": "WITH k AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) SELECT n_regionkey, string_agg(i || '. ' || n_name, chr(10) ORDER BY i) AS rubrics FROM k GROUP BY 1",
    "p12_passages": "SELECT doc_id, md5('Doc 1 (Title: T)' || chr(10) || lang || chr(10) || chr(10) || 'Doc 2 (Title: U)' || chr(10) || source) AS text FROM documents",
    "p13_join_results": r"""WITH x AS (SELECT n_nationkey, n_name || chr(10) || '---' || chr(10) || n_name AS t FROM nation), c AS (SELECT n_nationkey, CASE WHEN length(t) > 12 THEN t[1:12] || '...(truncated)' ELSE t END AS raw FROM x) SELECT n_nationkey, '{"result":"' || replace(raw, chr(10), '\n') || '"}' AS wrapped, raw FROM c""",
    "p14_flatten": "SELECT doc_id AS item_id, i::INT AS attempt, 't' || i AS text FROM documents, (SELECT unnest(range(4)) AS i) WHERE (doc_id + i) % 2 = 1 AND (doc_id * 3 + i) % 3 = 1",
    "p16_teacher": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'P' || chr(10) || chr(10) || 'Feedback:' || chr(10) || 'good' WHEN 1 THEN 'P' || chr(10) || chr(10) || 'Feedback:' || chr(10) || 'Format errors: e1; e2' END AS prompt FROM documents",
    "p17_rl_row": f"WITH {ROLLOUTS}, x AS (SELECT row_id, range(row_id % 12 + 1) AS v, row_id % 12 + 1 AS n FROM r) SELECT row_id, array_to_string(CASE WHEN n > 5 THEN v[n - 4:n] ELSE v END, ',') AS left_cut, array_to_string(v[1:5], ',') AS right_cut, array_to_string(CASE WHEN n > 5 THEN list_concat(v[1:2], v[n - 2:n]) ELSE v END, ',') AS middle_cut FROM x",
    "p18_sft_mask": f"WITH {ROLLOUTS} SELECT row_id, repeat('0', row_id % 5) || repeat('1', len) || '0' AS mask FROM r",
    "p19_multi_turn_mask": "WITH w AS (SELECT conv_id, role, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT conv_id, sum(n)::INT AS n, coalesce(sum(n) FILTER (role = 'assistant'), 0)::INT AS n_loss FROM w GROUP BY 1",
    "p19_tool_runs": "WITH c AS (SELECT conv_id, turn, (role IS DISTINCT FROM lag(role, 1, '') OVER w)::INT AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sum(c) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c",
    "p20_split_media": "SELECT n_nationkey, 'a|<image>|' || n_name || '|<video>|<image>' AS parts FROM nation",
    "x12_mean_pool": "WITH " + TOKENS + " SELECT row_id, round(sum(logp * m) / sum(m), 6) + 0.0 AS a, round(sum(adv * m) / sum(m), 6) + 0.0 AS b FROM tok GROUP BY 1",
    "p15_per_turn_prompts": "WITH " + TRAJ + """, b AS (SELECT conv_id, list_transform(regexp_extract_all(traj, '(?s)<search>(.*?)</search>', 1), lambda x: trim(x)) AS q, list_transform(regexp_extract_all(traj, '(?s)<information>(.*?)</information>', 1), lambda x: trim(x)) AS d FROM tr),
t AS (SELECT conv_id, unnest(range(1, len(q) + 1)) AS i, q, d FROM b)
SELECT conv_id, 'initial' AS stage, md5('I task src') AS prompt FROM b UNION ALL SELECT conv_id, 'synthesis', md5('S task') FROM b UNION ALL SELECT conv_id, 'turn_' || i, md5('T ' || q[i]) FROM t WHERE coalesce(d[i], '') <> ''""",
    "x22_benchmark_folder": r"SELECT doc_id AS idx, (['eval_researchqa', 'eval_sqa_cs_v2', 'eval_healthbench'])[doc_id % 3 + 1] AS data_source, (['research-qa', 'scientific-qa', 'medical-qa'])[doc_id % 3 + 1] AS ability, md5(CASE WHEN doc_id % 3 = 2 THEN 'Think. Talk: ' || coalesce(text, '') ELSE 'Q: ' || regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END) AS prompt FROM documents",
}
