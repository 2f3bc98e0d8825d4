"""Parsers and comparisons over trajectories, documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieve as R
from millrace.sources.views import TRAJ, one_of, pick, picked, r6, table, trajectories


def _joined(x, sep="|"):
    return F.array_join(x, sep)


def t1_solver_answer(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.select("conv_id", T.solver_answer(F.col("traj")).alias("answer"), F.size(T.solver_errors(F.col("traj"))).alias("n_errors"))


def t2_strip_env(spark, sf_dir):
    return trajectories(spark, sf_dir).select("conv_id", F.length(T.strip_env_turns(F.col("traj"))).alias("n_left"))


def t3_think_blocks(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.select("conv_id", _joined(T.stripped_blocks(F.col("traj"), "think")).alias("thoughts"), F.size(T.blocks(F.col("traj"), "tool_call")).alias("n_calls"))


def t4_search_queries(spark, sf_dir):
    return trajectories(spark, sf_dir).select("conv_id", _joined(T.search_queries(F.col("traj"))).alias("queries"))


# Tool calls with, stated by hand, the answer, the queries and the task that each gives, and whether it is a valid search.
CALLS = [
    ('{"name": "search", "arguments": {"query_list": ["a b", "b"]}}', "", "", "", 1),
    ('{"name": "search", "arguments": {"query_list": []}}', "", "", "", 0),
    ("{broken", "", "", "", 0),
    ('{"name": "submit_answer", "arguments": {"answer": " 42 "}}', "42", "", "", 0),
    ('{"name": "submit_answer", "arguments": {"answer": "it, \\"quoted\\""}}', 'it, "quoted"', "", "", 0),
    ('{"name": "submit_answer", "arguments": {"answer": "  "}}', "", "", "", 0),
    ('{"name": "browse", "arguments": {"query": "q"}}', "", "q", "", 0),
    ('{"name": "search", "arguments": {"queries": ["x", " ", "y z"]}}', "", "x|y z", "", 0),
    ('{"name": "submit_task", "arguments": {"task_prompt": " do it "}}', "", "", "do it", 0),
    ('{"name": "submit_task", "arguments": {"task_prompt": ""}}', "", "", "", 0),
]
# Ends of solutions with, stated by hand, the strict and the flexible number; ``#`` stands for the row's number.
SUMS = [("so\n#### #", "#", "#"), ("it is $#.", None, "#."), ("no number at all", None, None), ("x\nAnswer: #\nbye", None, "#"), ("#### 7 no,\n#### -#,000", "-#000", "-#,000"), ("####7 then .. and . ", None, ".."), ("3 or #, of 5" + " x" * 160, None, None), ("#### #" + " pad" * 10 + ".", "#", "#")]


def _calls(spark, sf_dir):
    """Three hashed tool calls of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    cells = [F.concat(F.lit("<tool_call>\n"), one_of([c[0] for c in CALLS], pick("doc_id", f"call{i}", len(CALLS))), F.lit("\n</tool_call>")) for i in range(3)]
    return d.select("doc_id", F.concat_ws(" and ", *cells).alias("x"))


def t5_turn_parse(spark, sf_dir):
    return _calls(spark, sf_dir).select("doc_id", T.submitted_answer(F.col("x")).alias("answer"), _joined(T.search_queries(F.col("x"))).alias("queries"))


def t6_valid_calls(spark, sf_dir):
    return _calls(spark, sf_dir).select("doc_id", T.valid_tool_calls(F.col("x")).alias("n_valid"))


def t7_documents(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.select("conv_id", F.md5(T.all_documents(F.col("traj"))).alias("docs"), F.md5(T.search_turn_text(F.col("traj"))).alias("turns"))


def t8_evidence(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    return t.select("conv_id", F.size(T.stripped_blocks(F.col("traj"), "information")).alias("n_blocks"))


def t9_normalize(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("norm"))


def t10_dedup_docs(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    twice = F.flatten(F.array(T.search_turns(F.col("traj")), T.search_turns(F.col("traj"))))
    out = T.dedup_docs(twice)
    return t.select("conv_id", F.size(twice).alias("n_turns"), F.size(F.filter(out, lambda x: x["docs"] != "")).alias("n_kept"))


def t11_dedup_rubrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat_ws(" ", F.lit("checks"), F.concat(F.lit("a"), F.pmod(F.col("doc_id") + i, F.lit(3)).cast("string")), F.concat(F.lit("b"), F.pmod(F.col("doc_id") * i, F.lit(2)).cast("string")))).alias("r"))
    return d.select("doc_id", F.array_join(F.transform(T.dedup_rubrics(F.col("r")), lambda i: i.cast("string")), ",").alias("kept"))


def t12_ngram_overlap(spark, sf_dir):
    """Share of each document's four-word sequences that benchmark texts have."""
    out = R.ngram_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 4)
    return out.select("doc_id", r6(F.col("overlap")).alias("overlap"))


def t13_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark")
    cut = T.truncate_tokens(F.col("text"), 8)
    return d.select("item_id", T.token_count(F.col("text")).alias("n"), T.token_count(cut).alias("n_cut"))


def t14_exact_match(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    gold = F.array(F.concat(F.lit(" "), F.col("text"), F.lit("??")), F.lit("nothing"))
    answer = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("The "), "text", F.lit("!"))).otherwise(F.lit("other"))
    x = F.concat(F.lit("<answer>Beijing</answer> <answer>"), answer, F.lit("</answer>"))
    return b.select("item_id", T.qa_score(x, gold).alias("em"), T.qa_score(x, gold, part=True).alias("sub_em"), T.qa_score(answer, gold).alias("without_tags"))


def _sums(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", F.replace(one_of([c[0] for c in SUMS], pick("doc_id", "sum", len(SUMS))), F.lit("#"), F.lit("@")).alias("form")).select("doc_id", F.replace(F.replace("form", F.lit("@@@@"), F.lit("####")), F.lit("@"), F.col("doc_id").cast("string")).alias("x"))


def t15_gsm8k(spark, sf_dir):
    """Both extractions, and the score beside a gold answer that is the row's number."""
    gold, x = F.col("doc_id").cast("string"), F.col("x")
    return _sums(spark, sf_dir).select("doc_id", T.gsm8k_answer(x).alias("strict"), T.gsm8k_answer(x, strict=False).alias("flexible"), T.gsm8k_score(x, gold, format_score=0.1).alias("score"), T.gsm8k_score(x, gold, strict=False).alias("flexible_score"))


def x2_submitted_task(spark, sf_dir):
    return _calls(spark, sf_dir).select("doc_id", T.submitted_task(F.col("x")).alias("task"))


def x4_parse_flags(spark, sf_dir):
    t = trajectories(spark, sf_dir)
    x = F.col("traj")
    return t.select("conv_id", (T.solver_answer(x).isNotNull() & (F.size(T.solver_errors(x)) == 0)).alias("is_valid"), (F.size(T.blocks(x, "tool_call")) > 0).alias("has_calls"), F.size(T.stripped_blocks(x, "think")).alias("n_think"))


def x8_last_assistant(spark, sf_dir):
    return trajectories(spark, sf_dir).select("conv_id", F.md5(F.coalesce(T.last_assistant(F.col("turns")), F.lit(""))).alias("last"))


def _called(field, first=True):
    """What the three hashed calls give, from the meanings stated by hand."""
    values = ", ".join("'" + str(c[field]).replace("'", "''") + "'" for c in CALLS)
    cells = ", ".join(f"([{values}])[{picked('doc_id', f'call{i}', len(CALLS))} + 1]" for i in range(3))
    return f"list_filter([{cells}], lambda v: v <> '')" + ("[1]" if first else "")


def _summed(field):
    values = ", ".join("NULL" if c[field] is None else "'" + c[field] + "'" for c in SUMS)
    return f"replace(([{values}])[{picked('doc_id', 'sum', len(SUMS))} + 1], '#', doc_id::VARCHAR)"


QUERIES = {k: v for k, v in globals().items() if k[:1] in "tx" and k[1:2].isdigit() and callable(v)}

_WT = "WITH " + TRAJ
_STRIPPED = "list_filter(list_transform(regexp_extract_all(traj, '(?s)<{t}>(.*?)</{t}>', 1), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"


def _blocks(tag):
    return _STRIPPED.format(t=tag)


_SEEN = "regexp_replace(traj, '(?s)<\\|im_start\\|>user\\n.*?<\\|im_end\\|>', '', 'g')"
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"

SQL = {
    "t1_solver_answer": _WT + ", a AS (SELECT conv_id, regexp_extract_all(" + _SEEN + ", '(?s)<answer>(.*?)</answer>', 1) AS found FROM tr) SELECT conv_id, nullif(trim(found[-1]), '') AS answer, (found[-1] IS NOT NULL AND trim(found[-1]) = '')::INT AS n_errors FROM a",
    "t2_strip_env": _WT + " SELECT conv_id, length(" + _SEEN + ")::INT AS n_left FROM tr",
    "t3_think_blocks": _WT + f" SELECT conv_id, array_to_string({_blocks('think')}, '|') AS thoughts, 0 AS n_calls FROM tr",
    "t4_search_queries": _WT + f" SELECT conv_id, array_to_string({_blocks('search')}, '|') AS queries FROM tr",
    "t5_turn_parse": f"SELECT doc_id, {_called(1)} AS answer, array_to_string({_called(2, False)}, '|') AS queries FROM documents",
    "t6_valid_calls": f"SELECT doc_id, len(list_filter({_called(4, False)}, lambda v: v = '1')) AS n_valid FROM documents",
    "x2_submitted_task": f"SELECT doc_id, {_called(3)} AS task FROM documents",
    "t7_documents": _WT + f", b AS (SELECT conv_id, {_blocks('information')} AS i, list_transform(regexp_extract_all(traj, '(?s)<search>(.*?)</search>', 1), lambda x: trim(x, ' ' || chr(10))) AS q, list_transform(regexp_extract_all(traj, '(?s)<information>(.*?)</information>', 1), lambda x: trim(x, ' ' || chr(10))) AS d FROM tr) SELECT conv_id, md5(array_to_string(i, chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS docs, md5(array_to_string(list_transform(range(1, len(q) + 1), lambda k: '[Search turn ' || k || ': \"' || q[k] || '\"]' || chr(10) || coalesce(d[k], '(no results)')), chr(10) || chr(10))) AS turns FROM b",
    "t8_evidence": _WT + f" SELECT conv_id, len({_blocks('information')})::INT AS n_blocks FROM tr",
    "t9_normalize": "SELECT item_id, " + _NORM.format(x="text") + " AS norm FROM benchmark",
    "t10_dedup_docs": _WT + ", b AS (SELECT conv_id, list_transform(regexp_extract_all(traj, '(?s)<information>(.*?)</information>', 1), lambda x: trim(x, ' ' || chr(10))) AS d, len(regexp_extract_all(traj, '(?s)<search>(.*?)</search>', 1)) AS n FROM tr) SELECT conv_id, (2 * n)::INT AS n_turns, len(list_distinct(list_filter(list_transform(d[1:n], lambda x: x[1:200]), lambda x: x <> '')))::INT AS n_kept FROM b",
    "t12_ngram_overlap": r"""WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') AS ws FROM documents UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?') FROM benchmark),
g AS (SELECT k, id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 2)) AS i FROM w)), b AS (SELECT DISTINCT g FROM g WHERE k = 'b'),
n AS (SELECT g.id, count(*) AS n, count(b.g) AS hit FROM g LEFT JOIN b USING (g) WHERE k = 'd' GROUP BY g.id)
SELECT doc_id, round(coalesce(hit / n, 0), 6) + 0.0 AS overlap FROM documents LEFT JOIN n ON n.id = doc_id""",
    "t13_tokens": r"WITH k AS (SELECT item_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]'))::INT AS n FROM benchmark) SELECT item_id, n, least(n, 8)::INT AS n_cut FROM k",
    "t14_exact_match": "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS em, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sub_em, 0.0::DOUBLE AS without_tags FROM benchmark",
    "t15_gsm8k": f"WITH a AS (SELECT doc_id, {_summed(1)} AS strict, {_summed(2)} AS flexible FROM documents) SELECT doc_id, strict, flexible, CASE WHEN strict IS NULL THEN 0.0 WHEN strict = doc_id::VARCHAR THEN 1.0 ELSE 0.1 END::DOUBLE AS score, coalesce((flexible = doc_id::VARCHAR)::INT, 0)::DOUBLE AS flexible_score FROM a",
    "x4_parse_flags": _WT + f" SELECT conv_id, coalesce(trim((regexp_extract_all({_SEEN}, '(?s)<answer>(.*?)</answer>', 1))[-1]) <> '', false) AS is_valid, false AS has_calls, len({_blocks('think')})::INT AS n_think FROM tr",
    "x8_last_assistant": _WT + " SELECT conv_id, md5(coalesce(max(text) FILTER (i = last), '')) AS last FROM cl GROUP BY conv_id",
}
