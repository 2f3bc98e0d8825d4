"""Difficulty, reward and judge scores over derived grades and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import score as S
from millrace.functions import text as T
from millrace.sources.views import JUDGED, ROLLOUTS, TRAJ, judgements, one_of, pick, picked, r6, rollouts, table, trajectories


def _grid(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return r.select("row_id", (F.pmod("row_id", F.lit(11)) / 2.0).alias("s"), F.pmod("row_id", F.lit(6)).cast("int").alias("n"))


def _difficulty(kind):
    def run(spark, sf_dir):
        return _grid(spark, sf_dir).select("row_id", r6(S.difficulty(F.col("s"), F.col("n"), kind)).alias("difficulty"))

    return run


def d4_recovered_sum(spark, sf_dir):
    g = rollouts(spark, sf_dir).select("row_id", F.slice(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(1.0)), F.lit(1), F.pmod("row_id", F.lit(6)).cast("int")).alias("g"), F.pmod(F.col("row_id") * 3, F.lit(5)).cast("int").alias("n"))
    return g.select("row_id", S.recovered_sum(F.col("g"), F.col("n")).alias("total"))


def _spoilt(spark, sf_dir):
    """Trajectories of which some give a task instead of an answer, leave searches open or begin turns without a thought."""
    x = F.when(pick("conv_id", "task", 2) == 0, F.replace(F.replace("traj", F.lit("<answer>"), F.lit("<task>")), F.lit("</answer>"), F.lit("</task>"))).otherwise(F.col("traj"))
    x = F.when(pick("conv_id", "open", 3) == 0, F.replace(x, F.lit("</search>"), F.lit("</sear>"))).otherwise(x)
    return trajectories(spark, sf_dir).select("conv_id", F.when(pick("conv_id", "idea", 2) == 0, F.regexp_replace(x, "<think>([a-m])", "<idea>$1")).otherwise(x).alias("x"))


def d5_format_score(spark, sf_dir):
    rows = _spoilt(spark, sf_dir).select("conv_id", S.task_format(F.col("x")).alias("f"), S.task_format(F.col("x"), 2).alias("g"))
    return rows.select("conv_id", *[r6(F.col(f"f.{c}")).alias(c) for c in ("think", "tool", "structure", "format")], r6(F.col("g.tool")).alias("tool_of_two"))


def d7_solver_format(spark, sf_dir):
    f = S.answer_format(F.col("x"), think_budget=4)
    rows = _spoilt(spark, sf_dir).select("conv_id", S.answer_format(F.col("x")).alias("f"), f.alias("g"))
    return rows.select("conv_id", *[r6(F.col(f"f.{c}")).alias(c) for c in ("think", "tool", "answer", "format")], r6(F.col("g.think")).alias("think_within"))


def d6_short_form(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, F.pmod("doc_id", F.lit(13)).cast("int")), " ").alias("a"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("text")).alias("info"))
    return d.select("doc_id", S.short_form_reward(F.concat(F.lit("<answer>"), "a", F.lit("</answer>")), F.concat(F.lit("<information>"), "info", F.lit("</information>"))).alias("reward"))


def d8_length_penalty(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", r6(S.length_penalty(F.col("row_id") % 3000, 1024, 2048, 0.05)).alias("penalty"))


def d9_solver_total(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    k = lambda n: F.pmod("row_id", F.lit(n)).cast("double") / (n - 1)
    return r.select("row_id", r6(S.solver_total(k(3), k(5), S.length_penalty(F.col("row_id") % 3000, 1024, 2048, 0.05), S.copy_deduction(k(7)), S.search_reward(F.col("row_id") % 9, 4), F.col("row_id") % 10 != 0)).alias("total"))


def d10_challenger_total(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    fmt, diff, quality = F.pmod("row_id", F.lit(3)) / 2.0, F.pmod("row_id", F.lit(7)) / 6.0, F.pmod("row_id", F.lit(2)).cast("double")
    return r.select("row_id", r6(S.challenger_total(fmt, diff, quality)).alias("additive"), r6(S.challenger_total(fmt, diff, quality, "gated")).alias("gated"), r6(S.short_form_format(fmt, quality)).alias("short_format"))


def d11_overlong(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", r6(S.overlong_penalty(F.col("row_id") % 3000, 1000, 512)).alias("penalty"))


def _lists(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(6))
    x = F.when(k == 0, "<think>t</think><scores>1, 0.5, 0</scores>").when(k == 1, "<think>t</think>\n1,0,0.5, 1").when(k == 2, "<scores>1, 2, x</scores>").when(k == 3, "<scores>1, 0").when(k == 4, "nothing").otherwise("<scores>0</scores> and <scores>1</scores>")
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))


def d12_grader_lists(spark, sf_dir):
    x = F.col("x")
    return _lists(spark, sf_dir).select("doc_id", F.array_join(S.comma_grades(x), ",", "?").alias("grades"), (F.size(S.grade_errors(x)) == 0).alias("is_valid"))


# Ends of assessments: a good grade, wrong ones, none.
_ENDS = ["<rubric>r</rubric><reasoning>w</reasoning><score>1</score>", "<rubric>r</rubric><reasoning>w</reasoning><score> 0.5 </score>", "<rubric>r</rubric><score>0</score>", "<reasoning>w</reasoning><score>2</score>", "<rubric>r</rubric><reasoning>w</reasoning><score>1.0.1</score>", "<rubric>r</rubric><reasoning>w</reasoning>", "<rubric>r</rubric><reasoning>w</reasoning><score>x</score>"]
_ITEMS = ['{"rubric": "r", "reasoning": "w", "score": 1}', '{"rubric": "r", "score": 0.5}', '{"score": "0"}', '{"rubric": "r", "score": 3}', '{"rubric": "r"}', '{"rubric": "r", "score": "much"}', "7"]


def _joined_picks(values, sep, most=4):
    """Up to ``most - 1`` hashed choices from ``values``."""
    return F.array_join(F.transform(F.slice(F.array(*[pick("doc_id", f"p{i}", len(values)) for i in range(most - 1)]), F.lit(1), pick("doc_id", "count", most)), lambda k: one_of(values, k)), sep)


def _graded(df, x, read):
    rows = df.select("doc_id", read(x).alias("g"))
    return rows.select("doc_id", F.array_join(F.transform("g.scores", lambda v: v.cast("string")), ",").alias("scores"), F.array_join("g.errors", "; ").alias("errors"))


def d12_grader_xml(spark, sf_dir):
    body = F.concat(F.lit("<think>t</think><evaluation>"), F.when(pick("doc_id", "count", 4) > 0, F.concat(F.lit("<rubric_assessment>"), _joined_picks(_ENDS, "</rubric_assessment>\n<rubric_assessment>"), F.lit("</rubric_assessment>"))).otherwise(F.lit("nothing")))
    x = F.when(pick("doc_id", "whole", 9) == 0, F.lit("no tags")).when(pick("doc_id", "whole", 9) == 1, body).otherwise(F.concat(body, F.lit("</evaluation>")))
    return _graded(table(spark, sf_dir, "documents"), x, S.xml_grades)


def d12_grader_json(spark, sf_dir):
    body = F.concat(F.lit("Here it is: ["), _joined_picks(_ITEMS, ", "))
    x = F.when(pick("doc_id", "whole", 9) == 0, F.lit("none")).when(pick("doc_id", "whole", 9) == 1, F.concat(body, F.lit("{]"))).otherwise(F.concat(body, F.lit("] done")))
    return _graded(table(spark, sf_dir, "documents"), x, S.json_grades)


def d12_single_grades(spark, sf_dir):
    return judgements(spark, sf_dir).select("item_id", "rubric_idx", S.single_grade(F.col("judge_text")).alias("grade"))


def d13_merge_grades(spark, sf_dir):
    j = judgements(spark, sf_dir).select("item_id", "rubric_idx", S.single_grade(F.col("judge_text")).alias("g"))
    cells = F.array_sort(F.collect_list(F.struct("rubric_idx", F.coalesce(F.col("g").cast("string"), F.lit("?")).alias("g"))))
    return j.groupBy("item_id").agg(F.array_join(F.transform(cells, lambda c: c["g"]), ",").alias("grades"), F.sum("g").alias("total"), F.count("g").alias("n_valid"))


def d14_quality_parse(spark, sf_dir):
    return judgements(spark, sf_dir).select("item_id", "rubric_idx", S.quality_score(F.col("judge_text")).alias("score"))


def d15_rubrics(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(3))
    x = F.when(k == 0, '<rubric priority="high">a</rubric>\n<rubric> b </rubric><rubric></rubric>').when(k == 1, '```json\n{"rubrics": [{"rubric": " c ", "priority": "low"}, {"rubric": "d"}]}\n```').otherwise("none")
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    show = lambda rs: F.array_join(F.transform(rs, lambda r: F.concat_ws(":", r["text"], r["priority"])), "|")
    return d.select("doc_id", show(S.rubrics(F.col("x"))).alias("tags"), F.coalesce(show(S.json_rubrics(F.col("x"))), F.lit("")).alias("json"))


def d17_points(spark, sf_dir):
    j = judgements(spark, sf_dir).select("item_id", (F.pmod(F.col("item_id") + F.col("rubric_idx") * 3, F.lit(7)) - 2).cast("double").alias("points"), (S.single_grade(F.col("judge_text")) == 1.0).alias("met"))
    return j.groupBy("item_id").agg(r6(S.points_score(F.coalesce("met", F.lit(False)), F.col("points"))).alias("score"))


def d18_coverage(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(4))
    x = F.when(k == 0, "Mostly\ncompletely\nwell").when(k == 1, "barely").when(k == 2, " moderately \n\nNot at all").otherwise("unsure")
    return table(spark, sf_dir, "documents").select("doc_id", r6(S.coverage_score(x)).alias("score"))


def d19_dimensions(spark, sf_dir):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('ok ```json {"depth": '), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit(', "style": 5}```'))).otherwise("broken {")
    return table(spark, sf_dir, "documents").select("doc_id", r6(S.dimension_score(x, ["depth", "style", "insight", "clarity", "rigour"])).alias("score"))


def d20_scale(spark, sf_dir):
    x = F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.concat(F.lit('{"score": "'), F.pmod("doc_id", F.lit(15)).cast("string"), F.lit('"}')))
    return table(spark, sf_dir, "documents").select("doc_id", S.scale_score(x).alias("score"))


def d21_fraction_met(spark, sf_dir):
    j = judgements(spark, sf_dir)
    return j.groupBy("item_id").agg(r6(F.avg(F.coalesce((S.single_grade(F.col("judge_text")) == 1.0).cast("double"), F.lit(0.0)))).alias("score"))


def d22_pairwise(spark, sf_dir):
    labels = ["A>>B", "A>B", "A=B", "B>A", "B>>A", "C"]
    pick = lambda k: F.concat(F.lit("so [["), F.element_at(F.array(*[F.lit(v) for v in labels]), (F.pmod(k, F.lit(6)) + 1).cast("int")), F.lit("]]"))
    d = table(spark, sf_dir, "documents").select("doc_id", S.verdict(pick(F.col("doc_id"))).alias("a"), S.verdict(pick(F.floor(F.col("doc_id") / 6))).alias("b"))
    return d.select("doc_id", r6(S.pairwise_score(F.col("a"), F.col("b"))).alias("score"))


def d23_lenient_json(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(3))
    x = F.when(k == 0, 'a ```json\n{"v": 1}\n``` b').when(k == 1, 'x {"v": 2} y').otherwise("no")
    return table(spark, sf_dir, "documents").select("doc_id", F.from_json(T.lenient_json(x), "v int")["v"].alias("v"))


def d24_search_reward(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", r6(S.search_reward(F.col("row_id") % 9, 4)).alias("reward"))


def a13_difficulty(spark, sf_dir):
    j = judgements(spark, sf_dir).select("item_id", F.coalesce(S.single_grade(F.col("judge_text")), F.lit(0.0)).alias("g"))
    s = j.groupBy("item_id").agg(F.sum("g").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == 1).alias("c"))
    return s.select("item_id", r6(S.difficulty(F.col("s"), F.col("n"), "tent")).alias("tent"), r6(S.em_difficulty(F.col("c"), F.col("n"))).alias("em"))


def t21_routing(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return r.select("row_id", S.route(F.col("data_source"), {"click": F.col("score"), "view": F.lit(1.0)}).alias("score"))


def x3_grade_totals(spark, sf_dir):
    g = _lists(spark, sf_dir).select("doc_id", F.filter(F.coalesce(S.comma_grades(F.col("x")), F.array().cast("array<double>")), lambda v: v.isNotNull()).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda s, v: s + v)
    return g.select("doc_id", total.alias("total"), F.size("g").alias("most"), r6(F.when(F.size("g") > 0, total / F.greatest(F.size("g"), F.lit(1))).otherwise(0.0)).alias("share"))


QUERIES = {"d1_continuous": _difficulty("continuous"), "d2_tent": _difficulty("tent"), "d3_normalized": _difficulty("normalized")} | {k: v for k, v in globals().items() if k[:1] in "datx" and k[1:2].isdigit() and callable(v)}

_G = f"WITH {ROLLOUTS}, g AS (SELECT row_id, (row_id % 11) / 2.0::DOUBLE AS s, (row_id % 6)::INT AS n FROM r)"
_PEN = "CASE WHEN row_id % 3000 <= 1024 THEN 1.0 WHEN row_id % 3000 >= 2048 THEN 0.05 ELSE 0.05 + 0.95 * 0.5 * (1 + cos(pi() * (row_id % 3000 - 1024) / 1024.0)) END"
_J = f"WITH {JUDGED}, g AS (SELECT *, try_cast(nullif(regexp_extract(judge_text, '<score>([0-9.]+)</score>', 1), '') AS DOUBLE) AS g FROM j)"

def _picks(meanings, none, broken, empty):
    """What the hashed pieces mean, each stated by hand: its grade and its errors."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    lists = [", ".join(quote(m[k]) for m in meanings) for k in (0, 1)]
    at = ", ".join(picked("doc_id", f"p{i}", len(meanings)) for i in range(3))
    return f"""WITH p AS (SELECT doc_id, {picked("doc_id", "whole", 9)} AS w, ([{at}])[:{picked("doc_id", "count", 4)}] AS k FROM documents),
m AS (SELECT doc_id, w, len(k) AS n, list_transform(k, lambda x: ([{lists[0]}])[x + 1]) AS s, list_transform(k, lambda x, i: replace(([{lists[1]}])[x + 1], '#', i::VARCHAR)) AS e FROM p)
SELECT doc_id, CASE WHEN w < 2 THEN '' ELSE array_to_string(list_filter(s, lambda x: x <> ''), ',') END AS scores, CASE w WHEN 0 THEN {quote(none)} WHEN 1 THEN {quote(broken)} ELSE CASE WHEN n = 0 THEN {quote(empty)} ELSE array_to_string(list_filter(e, lambda x: x <> ''), '; ') END END AS errors FROM m"""


_SPOILT = "WITH " + TRAJ + f""", x1 AS (SELECT conv_id, CASE WHEN {picked("conv_id", "task", 2)} = 0 THEN replace(replace(traj, '<answer>', '<task>'), '</answer>', '</task>') ELSE traj END AS x FROM tr),
x2 AS (SELECT conv_id, CASE WHEN {picked("conv_id", "open", 3)} = 0 THEN replace(x, '</search>', '</sear>') ELSE x END AS x FROM x1),
x3 AS (SELECT conv_id, CASE WHEN {picked("conv_id", "idea", 2)} = 0 THEN regexp_replace(x, '<think>([a-m])', '<idea>\\1', 'g') ELSE x END AS x FROM x2),
b AS (SELECT conv_id, regexp_extract_all(x, '(?s)<\\|im_start\\|>assistant\n(.*?)<\\|im_end\\|>', 1) AS t FROM x3)"""

SQL = {
    "d1_continuous": _G + " SELECT row_id, round(CASE WHEN n <= 1 OR s <= 0 OR s >= n THEN 0.0 ELSE least((n - s) / (n - 1), 1.0) END, 6) + 0.0 AS difficulty FROM g",
    "d2_tent": _G + " SELECT row_id, round(CASE WHEN n <= 0 OR s <= 0 OR s >= n THEN 0.0 WHEN s / n <= 0.5 THEN s / n / 0.5 ELSE (1 - s / n) / 0.5 END, 6) + 0.0 AS difficulty FROM g",
    "d3_normalized": _G + " SELECT row_id, round(CASE WHEN n <= 0 THEN 0.0 ELSE greatest(0.0, least(s / n, 1.0)) END, 6) + 0.0 AS difficulty FROM g",
    "d4_recovered_sum": f"WITH {ROLLOUTS}, g AS (SELECT row_id, ([1.0::DOUBLE, 0.5, 0.0, 1.0, 1.0])[1:row_id % 6] AS g, (row_id * 3 % 5)::INT AS n FROM r) SELECT row_id, CASE WHEN len(g) = 0 THEN NULL WHEN n = 0 THEN 0.0 WHEN len(g) >= n THEN list_sum(g[1:n]) WHEN len(g) / n >= 0.5 THEN list_sum(g) END::DOUBLE AS total FROM g",
    "d5_format_score": _SPOILT + r""", c AS (SELECT conv_id, t, len(t) AS n, array_to_string(t, chr(10)) AS every, len(list_filter(t, lambda y: regexp_matches(y, '(?s)^\s*<think>.*?</think>'))) AS thinking,
 len(list_filter(t, lambda y: regexp_matches(y, '(?s)<search>\s*[^<\s].*?</search>'))) AS good, len(list_filter(t, lambda y: contains(y, '<search>') AND NOT regexp_matches(y, '(?s)<search>\s*[^<\s].*?</search>'))) AS broken FROM b),
d AS (SELECT conv_id, n, good, broken, CASE WHEN n > 0 THEN thinking / n ELSE 0.0 END AS think,
 len(regexp_extract_all(every, '(?s)<search>\s*[^<\s].*?</search>')) AS calls, coalesce(trim((regexp_extract_all(t[-1], '(?s)<task>(.*?)</task>', 1))[-1]) <> '', false)::INT AS structure FROM c),
e AS (SELECT *, CASE WHEN n <= 1 THEN (calls = 0)::INT ELSE least(calls / (n - 1), 1.0) END AS tool FROM d)
SELECT conv_id, round(think, 6) + 0.0 AS think, round(tool, 6) + 0.0 AS tool, structure::DOUBLE AS structure, round((think + tool + structure) / 3.0, 6) + 0.0 AS format, round(least(greatest(good - broken, 0) / 2, 1.0), 6) + 0.0 AS tool_of_two FROM e""",
    "d7_solver_format": _SPOILT + r""", c AS (SELECT conv_id, len(t) AS n, len(list_filter(t, lambda y: regexp_matches(y, '(?s)^\s*<think>.*?</think>'))) AS thinking,
 len(list_filter(t, lambda y: regexp_matches(y, '(?s)^\s*<think>.*?</think>') AND len(regexp_extract_all(regexp_extract(y, '(?s)<think>(.*?)</think>', 1), '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]')) <= 4)) AS within,
 len(regexp_extract_all(array_to_string(t[:len(t) - 1], chr(10)), '(?s)<search>\s*[^<\s].*?</search>')) AS calls,
 coalesce(trim((regexp_extract_all(array_to_string(t, chr(10)), '(?s)<answer>(.*?)</answer>', 1))[-1]) <> '', false)::INT AS answer FROM b),
d AS (SELECT *, CASE WHEN n > 0 THEN thinking / n ELSE 0.0 END AS think, CASE WHEN n > 0 THEN within / n ELSE 0.0 END AS inside, CASE WHEN n > 1 THEN least(calls / (n - 1), 1.0) ELSE 0.0 END AS tool FROM c)
SELECT conv_id, round(think, 6) + 0.0 AS think, round(tool, 6) + 0.0 AS tool, answer::DOUBLE AS answer, round((think + tool + answer) / 3.0, 6) + 0.0 AS format, round(inside, 6) + 0.0 AS think_within FROM d""",
    "d6_short_form": r"""WITH d AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:doc_id % 13], ' ') AS a, CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE text END AS i FROM documents),
p AS (SELECT doc_id, a, trim(regexp_replace(regexp_replace(lower(a), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS x, trim(regexp_replace(regexp_replace(lower(i), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')) AS y FROM d)
SELECT doc_id, CASE WHEN trim(a) = '' OR (x NOT IN ('yes', 'no') AND NOT contains(y, x)) OR x = '' THEN 0.0 WHEN len(string_split(x, ' ')) <= 5 THEN 1.0 WHEN len(string_split(x, ' ')) <= 10 THEN 0.5 ELSE 0.0 END::DOUBLE AS reward FROM p""",
    "d8_length_penalty": f"WITH {ROLLOUTS} SELECT row_id, round({_PEN}, 6) + 0.0 AS penalty FROM r",
    "d9_solver_total": f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN row_id % 10 = 0 THEN 0.0 ELSE 0.1 * (row_id % 3) / 2 + 0.8 * (row_id % 5) / 4 * ({_PEN}) - greatest((row_id % 7)::DOUBLE / 6 - 0.5, 0.0) + 0.1 * least(row_id % 9, 4) / 4.0 END, 6) + 0.0 AS total FROM r",
    "d10_challenger_total": f"WITH {ROLLOUTS}, x AS (SELECT row_id, (row_id % 3) / 2.0::DOUBLE AS f, (row_id % 7) / 6.0::DOUBLE AS d, (row_id % 2)::DOUBLE AS q FROM r) SELECT row_id, round(0.3 * f + 0.6 * d + 0.1 * q, 6) + 0.0 AS additive, round(CASE WHEN f <> 1 OR q <> 1 THEN 0.0 ELSE d END, 6) + 0.0 AS gated, round(CASE WHEN q = 0 THEN 0.0 ELSE (3 * f + q) / 4 END, 6) + 0.0 AS short_format FROM x",
    "d11_overlong": f"WITH {ROLLOUTS} SELECT row_id, round(least(-(row_id % 3000 - 1000) / 512.0::DOUBLE, 0.0), 6) + 0.0 AS penalty FROM r",
    "d12_grader_lists": "SELECT doc_id, (['1.0,0.5,0.0', '1.0,0.0,0.5,1.0', '1.0,?,?', NULL, NULL, '0.0'])[doc_id % 6 + 1] AS grades, doc_id % 6 IN (0, 1, 5) AS is_valid FROM documents",
    "d12_grader_xml": _picks([("1.0", ""), ("0.5", ""), ("0.0", "Assessment #: Missing <reasoning> tag"), ("", "Assessment #: Missing <rubric> tag; Assessment #: Invalid score 2.0, must be 0, 0.5, or 1"), ("", "Assessment #: Non-numeric score: 1.0.1"), ("", "Assessment #: Missing <score> tag"), ("", "Assessment #: Missing <score> tag")], "Missing <evaluation> tags", "Unclosed <evaluation> tag", "No <rubric_assessment> blocks found"),
    "d12_grader_json": _picks([("1.0", ""), ("0.5", ""), ("0.0", ""), ("", "Assessment #: Invalid score 3.0, must be 0, 0.5, or 1"), ("", "Assessment #: Missing 'score' field"), ("", "Assessment #: Invalid score type: much"), ("", "Assessment #: Expected object")], "No JSON array found in response", "JSON parse error", ""),
    "d12_single_grades": _J + " SELECT item_id, rubric_idx, g AS grade FROM g",
    "d13_merge_grades": _J + " SELECT item_id, string_agg(coalesce(g::VARCHAR, '?'), ',' ORDER BY rubric_idx) AS grades, sum(g) AS total, count(g) AS n_valid FROM g GROUP BY item_id",
    "d14_quality_parse": _J + " SELECT item_id, rubric_idx, try_cast(nullif(regexp_extract(judge_text, '<score>([01])</score>', 1), '') AS INT) AS score FROM g",
    "d15_rubrics": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a:high|b' ELSE '' END AS tags, CASE WHEN doc_id % 3 = 1 THEN 'c:low|d' ELSE '' END AS json FROM documents",
    "d17_points": _J + ", p AS (SELECT item_id, ((item_id + rubric_idx * 3) % 7 - 2)::DOUBLE AS p, coalesce(g = 1, false) AS met FROM g) SELECT item_id, round(CASE WHEN sum(greatest(p, 0)) > 0 THEN greatest(least(sum(CASE WHEN met THEN p ELSE 0 END) / sum(greatest(p, 0)), 1.0), 0.0) ELSE 0.0 END, 6) + 0.0 AS score FROM p GROUP BY 1",
    "d18_coverage": "SELECT doc_id, ([0.875::DOUBLE, 0.25, 0.25, 0.0])[doc_id % 4 + 1] AS score FROM documents",
    "d19_dimensions": "SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 5 + 5 + 9) / 5.0::DOUBLE ELSE 3.0 END, 6) + 0.0 AS score FROM documents",
    "d20_scale": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE greatest(least((doc_id % 15)::DOUBLE, 10.0), 1.0) END::DOUBLE AS score FROM documents",
    "d21_fraction_met": _J + " SELECT item_id, round(avg(coalesce(g = 1, false)::INT), 6) + 0.0 AS score FROM g GROUP BY 1",
    "d22_pairwise": """WITH v(i, s, n) AS (VALUES (0, 1.0::DOUBLE, 3), (1, 1.0, 1), (2, 0.5, 1), (3, 0.0, 1), (4, 0.0, 3)), d AS (SELECT doc_id, doc_id % 6 AS a, doc_id // 6 % 6 AS b FROM documents)
SELECT doc_id, round(CASE WHEN x.n IS NULL AND y.n IS NULL THEN 0.5 ELSE (coalesce((1 - x.s) * x.n, 0) + coalesce(y.s * y.n, 0)) / (coalesce(x.n, 0) + coalesce(y.n, 0)) END, 6) + 0.0 AS score FROM d LEFT JOIN v x ON x.i = a LEFT JOIN v y ON y.i = b""",
    "d23_lenient_json": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::INT AS v FROM documents",
    "d24_search_reward": f"WITH {ROLLOUTS} SELECT row_id, round(least(row_id % 9, 4) / 4.0::DOUBLE, 6) + 0.0 AS reward FROM r",
    "a13_difficulty": _J + ", s AS (SELECT item_id, sum(coalesce(g, 0)) AS s, count(*) AS n, count(*) FILTER (g = 1) AS c FROM g GROUP BY 1) SELECT item_id, round(CASE WHEN s <= 0 OR s >= n THEN 0.0 WHEN s / n <= 0.5 THEN s / n / 0.5 ELSE (1 - s / n) / 0.5 END, 6) + 0.0 AS tent, round(CASE WHEN n <= 1 OR c = 0 OR c = n THEN 0.0 ELSE (n - c)::DOUBLE / (n - 1) END, 6) + 0.0 AS em FROM s",
    "t21_routing": f"WITH {ROLLOUTS} SELECT row_id, CASE WHEN starts_with(data_source, 'view') THEN 1.0 WHEN starts_with(data_source, 'click') THEN score ELSE -1.0 END::DOUBLE AS score FROM r",
    "x3_grade_totals": "SELECT doc_id, ([1.5::DOUBLE, 2.5, 1.0, 0.0, 0.0, 0.0])[doc_id % 6 + 1] AS total, ([3, 4, 1, 0, 0, 1])[doc_id % 6 + 1]::INT AS most, ([0.5::DOUBLE, 0.625, 1.0, 0.0, 0.0, 0.0])[doc_id % 6 + 1] AS share FROM documents",
}
