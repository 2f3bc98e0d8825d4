"""Evaluation sets projected to one row shape, so that they can be united.

Each loader takes the set's own rows, as read from its JSON, with their number
in ``idx``, and returns ``data_source, prompt, ability, ground_truth, question,
idx``: the messages for the model, and what the set's judge needs as JSON.
Rows without a prompt are left out where the set has such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.operators.render import message

# Names of the sets, the kinds of ability they test, and the model behind recorded answers.
SOURCES = {
    "healthbench": ("eval_healthbench", "medical-qa"),
    "researchqa": ("eval_researchqa", "research-qa"),
    "drb_race": ("eval_drb_race", "deep-research"),
    "sqa_cs_v2": ("eval_sqa_cs_v2", "scientific-qa"),
    "researchrubrics": ("eval_researchrubrics", "deep-research"),
    "research_plan_gen": ("eval_research_plan_gen", "research-planning"),
    "arena_hard_cw": ("eval_arena_hard_cw", "creative-writing"),
    "wildbench": ("eval_wildbench", "instruction-following"),
}
BASELINE_MODEL = "gemini-2.0-flash-001"
QUESTION_CHARS = 200


def _rows(df: DataFrame, kind: str, prompt: Column, question: Column, **truth: Column) -> DataFrame:
    source, ability = SOURCES[kind]
    judged = F.to_json(F.struct(F.lit(kind).alias("eval_type"), *[c.alias(name) for name, c in truth.items()]))
    return df.select(F.lit(source).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"), judged.alias("ground_truth"), question.alias("question"), F.col("idx").cast("long").alias("idx"))


def _asked(text: Column, prefix: str) -> Column:
    """One user message: the search instructions and the question."""
    return F.array(message("user", F.concat(F.lit(prefix), strip(text))))


def _introduced(conversation: Column, preamble: str) -> Column:
    """A conversation whose first message begins with the search instructions."""
    return F.transform(conversation, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(preamble), m["content"])).otherwise(m["content"]).alias("content")))


def _last(conversation: Column) -> Column:
    return F.substring(F.coalesce(F.element_at(conversation, -1)["content"], F.lit("")), 1, QUESTION_CHARS)


def healthbench(df: DataFrame, preamble: str) -> DataFrame:
    """``prompt`` (messages) and ``rubrics`` (criterion, points, tags)."""
    df = df.where(F.size("prompt") > 0)
    return _rows(df, "healthbench", _introduced(F.col("prompt"), preamble), _last(F.col("prompt")), healthbench_rubrics=F.col("rubrics"), healthbench_conversation=F.col("prompt"))


def researchqa(df: DataFrame, prefix: str) -> DataFrame:
    """``query`` and ``rubric`` (items)."""
    return _rows(df, "researchqa", _asked(F.col("query"), prefix), F.col("query"), researchqa_rubric_items=F.col("rubric"))


def drb_race(df: DataFrame, prefix: str) -> DataFrame:
    """``prompt``, or ``topic`` where there is none."""
    text = F.coalesce("prompt", "topic", F.lit(""))
    return _rows(df, "drb_race", _asked(text, prefix), text, drb_prompt=text)


def sqa_cs_v2(df: DataFrame, prefix: str) -> DataFrame:
    """``question``."""
    return _rows(df, "sqa_cs_v2", _asked(F.col("question"), prefix), F.col("question"), sqa_question=F.col("question"))


def researchrubrics(df: DataFrame, prefix: str) -> DataFrame:
    """``prompt`` and ``rubrics`` (criterion, weight, axis)."""
    return _rows(df, "researchrubrics", _asked(F.col("prompt"), prefix), F.col("prompt"), researchrubrics_rubrics=F.col("rubrics"), researchrubrics_prompt=F.col("prompt"))


def research_plan_gen(df: DataFrame, prefix: str, plan_prefix: str) -> DataFrame:
    """``Goal`` and ``Rubric`` (texts, each of weight 1)."""
    rubrics = F.transform("Rubric", lambda r: F.struct(r.alias("criterion"), F.lit(1.0).alias("weight")))
    return _rows(df, "research_plan_gen", _asked(F.concat(F.lit(plan_prefix), strip(F.col("Goal"))), prefix), F.col("Goal"), research_plan_gen_rubrics=rubrics, research_plan_gen_goal=F.col("Goal"))


def arena_hard_cw(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Creative questions ``uid, category, prompt`` that have a recorded answer ``uid, answer``; no search instructions."""
    asked = df.where("category = 'creative_writing'").join(baseline.select("uid", "answer"), "uid")
    return _rows(asked, "arena_hard_cw", F.array(message("user", strip(F.col("prompt")))), F.col("prompt"), arena_hard_uid=F.col("uid"), arena_hard_prompt=F.col("prompt"), arena_hard_baseline_answer=F.col("answer"), arena_hard_baseline_model=F.lit(BASELINE_MODEL))


def wildbench(df: DataFrame, preamble: str) -> DataFrame:
    """``conversation_input`` (messages), ``checklist`` and ``primary_tag``."""
    talk = F.col("conversation_input")
    return _rows(df, "wildbench", _introduced(talk, preamble), _last(talk), wildbench_conversation=talk, wildbench_checklist=F.col("checklist"), wildbench_primary_tag=F.coalesce("primary_tag", F.lit("")))


def unite(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out
