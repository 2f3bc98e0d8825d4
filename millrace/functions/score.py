"""Difficulty, reward and judge scores, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

# The grades a grader may give.
GRADES = (0.0, 0.5, 1.0)
# Labels of pairwise verdicts, from the judge's first answer's point of view.
VERDICTS = {"A>>B": (1.0, 3), "A>B": (1.0, 1), "A=B": (0.5, 1), "B>A": (0.0, 1), "B>>A": (0.0, 3)}
# Coverage labels and their marks.
COVERAGE = {"not at all": 1, "barely": 2, "moderately": 3, "mostly": 4, "completely": 5}


def continuous_difficulty(s: Column, n: Column) -> Column:
    """Harder is better; 0 for a trivial or hopeless task."""
    return F.when((n <= 1) | (s <= 0) | (s >= n), 0.0).otherwise(F.least((n - s) / F.greatest(n - 1, F.lit(1)), F.lit(1.0)))


def tent_difficulty(s: Column, n: Column, target: float = 0.5) -> Column:
    """Best at the target share, falling to both ends."""
    if not 0 < target < 1:
        return F.lit(0.0)
    x = s / F.greatest(n, F.lit(1))
    return F.when((n <= 0) | (s <= 0) | (s >= n), 0.0).when(x <= target, x / target).otherwise((1.0 - x) / (1.0 - target))


def normalized_difficulty(s: Column, n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.least(s / F.greatest(n, F.lit(1)), F.lit(1.0)), F.lit(0.0)))


def difficulty(s: Column, n: Column, kind: str = "continuous", target: float = 0.5) -> Column:
    if kind == "continuous":
        return continuous_difficulty(s, n)
    if kind == "tent":
        return tent_difficulty(s, n, target)
    if kind == "normalized":
        return normalized_difficulty(s, n)
    raise ValueError(f"unknown difficulty {kind!r}")


def em_difficulty(correct: Column, n: Column) -> Column:
    """Of exact-match tasks: all or none right is 0."""
    return F.when((n <= 1) | (correct <= 0) | (correct >= n), 0.0).otherwise((n - correct) / F.greatest(n - 1, F.lit(1)))


def recovered_sum(scores: Column, n: Column, coverage: float = 0.5, pad: float = 0.0) -> Column:
    """Sum of the grades: exact, padded if enough are there, cut if too many; null if unusable."""
    k = F.size(scores)
    total = F.aggregate(F.slice(scores, F.lit(1), F.greatest(F.least(k, n), F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return F.when(k <= 0, None).when(n == 0, 0.0).when(k >= n, total).when(k / F.greatest(n, F.lit(1)) >= coverage, total + (n - k) * pad)


def length_penalty(tokens: Column, soft: int, hard: int, floor: float) -> Column:
    """1 to the soft limit, a cosine down to the floor at the hard one."""
    t = (tokens - soft) / float(hard - soft)
    return F.when(tokens <= soft, 1.0).when(tokens >= hard, floor).otherwise(floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(math.pi * t)))


def overlong_penalty(length: Column, expected: int, buffer: int, factor: float = 1.0) -> Column:
    return F.least(-(length - expected) / float(buffer) * factor, F.lit(0.0))


def short_form_reward(response: Column, conversation: Column) -> Column:
    """Last answer, if the last information block has it: 1 up to five words, a half up to ten; yes and no need no support."""
    plain = lambda x: T.squeeze(T.drop_punctuation(F.lower(x)))
    answer = T.strip(T.last(T.blocks(response, "answer")))
    ground = T.last(T.blocks(conversation, "information"))
    a, n = plain(answer), F.size(T.words(plain(answer)))
    bad = answer.isNull() | (answer == "") | ground.isNull() | (ground == "")
    loose = ~a.isin("yes", "no") & ~plain(ground).contains(a)
    return F.when(F.coalesce(bad | loose, F.lit(True)), 0.0).when(n.between(1, 5), 1.0).when(n.between(6, 10), 0.5).otherwise(0.0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(part / F.greatest(whole, F.lit(1)), F.lit(1.0))).otherwise(0.0)


def _calls(turn: Column, markup: str) -> Column:
    """Valid search calls of a text in one markup."""
    if markup == "search_tags":
        return F.size(T.stripped_blocks(turn, "search"))
    if markup == "function_calls":
        return F.size(F.regexp_extract_all(turn, F.lit(T.FC_SEARCH), F.lit(1)))
    if markup == "tool_call":
        return T.valid_tool_calls(turn).cast("int")
    raise ValueError(f"unknown markup {markup!r}")


def thinking_share(turns: Column, budget: int | None = None) -> Column:
    """Share of the turns that begin with a thought, of at most ``budget`` tokens where one is given; 0 without turns."""
    within = lambda t: T.leading_thought(t).isNotNull() if budget is None else F.coalesce(T.token_count(T.leading_thought(t)) <= budget, F.lit(False))
    return _ratio(F.size(F.filter(turns, within)), F.size(turns))


def final_task(turn: Column) -> Column:
    """The task that a final turn gives: in the last task tag, else by a submit call; null if none."""
    return F.coalesce(F.nullif(T.strip(T.last(T.blocks(turn, "task"))), F.lit("")), T.submitted_task(turn))


def task_format(x: Column, searches: Column | int | None = None, markup: str = "search_tags") -> Column:
    """``(think, tool, structure, format)`` of a task writer's conversation; format is the mean of the three.

    Tool: with ``searches`` expected, turns with a search less those with a
    broken one, over that number; else calls over the turns before the last.
    """

    def parts(turns):
        if searches is None:
            calls, wanted = _calls(F.array_join(turns, "\n"), markup), F.greatest(F.size(turns) - 1, F.lit(0))
            tool = F.when(wanted == 0, (calls == 0).cast("double")).otherwise(_ratio(calls, wanted))
        else:
            wanted = F.lit(searches) if isinstance(searches, int) else searches
            first = lambda t: T.strip(F.get(T.blocks(t, "search"), F.lit(0)))
            good = F.size(F.filter(turns, lambda t: F.coalesce(first(t) != "", F.lit(False))))
            broken = F.size(F.filter(turns, lambda t: ~F.coalesce(first(t) != "", F.lit(False)) & t.contains("<search>")))
            tool = F.when(wanted == 0, 1.0).otherwise(_ratio(F.greatest(good - broken, F.lit(0)), wanted))
        think, structure = thinking_share(turns), final_task(T.last(turns)).isNotNull().cast("double")
        return F.struct(think.alias("think"), tool.alias("tool"), structure.alias("structure"), ((think + tool + structure) / 3.0).alias("format"))

    return T.let(T.assistant_turns(x), parts)


def answer_format(x: Column, markup: str = "search_tags", think_budget: int | None = None) -> Column:
    """``(think, tool, answer, format)`` of a solver's conversation: searches are due in every turn but the last."""

    def parts(turns):
        rest = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))
        calls = F.aggregate(rest, F.lit(0), lambda n, t: n + _calls(t, markup))
        think, tool = thinking_share(turns, think_budget), _ratio(calls, F.size(rest))
        answer = F.coalesce(T.solver_answer(x).isNotNull() & (F.size(T.solver_errors(x)) == 0), F.lit(False)).cast("double")
        return F.struct(think.alias("think"), tool.alias("tool"), answer.alias("answer"), ((think + tool + answer) / 3.0).alias("format"))

    return T.let(T.assistant_turns(x), parts)


def challenger_total(fmt: Column, diff: Column, quality: Column, mode: str = "additive", weights: tuple[float, float, float] = (0.3, 0.6, 0.1)) -> Column:
    """Weighted sum, or difficulty behind gates on format and quality."""
    if mode == "additive":
        return weights[0] * fmt + weights[1] * diff + weights[2] * quality
    if mode == "gated":
        return F.when((fmt != 1.0) | (quality != 1.0), 0.0).otherwise(diff)
    raise ValueError(f"unknown mode {mode!r}")


def short_form_format(fmt: Column, answer: Column) -> Column:
    return F.when(answer == 0.0, 0.0).otherwise((3.0 * fmt + answer) / 4.0)


def solver_total(fmt: Column, acc: Column, penalty: Column, copied: Column, search: Column, has_answer: Column, weights: tuple[float, float, float] = (0.1, 0.8, 0.1), zero_without_answer: bool = True) -> Column:
    total = weights[0] * fmt + weights[1] * acc * penalty - copied + weights[2] * search
    return F.when(has_answer, total).otherwise(0.0) if zero_without_answer else total


def search_reward(count: Column, most: int) -> Column:
    return F.least(count, F.lit(most)) / float(most)


def copy_deduction(overlap: Column, allowed: float = 0.5, scale: float = 1.0) -> Column:
    return F.greatest(overlap - allowed, F.lit(0.0)) * scale


# -- judge texts


def quality_score(x: Column) -> Column:
    """First ``<score>`` of 0 or 1; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"<score>\s*([01])\s*</score>", 1), F.lit("")).cast("int")


def quality_gate(scores: Column, required: int = -1) -> Column:
    """Every score known and enough of them passed; all, where required is negative."""
    need = F.size(scores) if required < 0 else F.lit(required)
    total = F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    return (F.size(scores) > 0) & F.forall(scores, lambda s: s.isNotNull()) & (F.coalesce(total, F.lit(0)) >= need)


def comma_grades(x: Column) -> Column:
    """Grades of ``<scores>a, b, ..</scores>`` or of a bare list after the thoughts; invalid ones are null."""
    inside = F.regexp_extract(x, r"(?s)<scores>(.*?)</scores>", 1)
    bare = T.strip(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))
    listed = F.when(x.rlike(r"(?s)<scores>.*?</scores>"), T.strip(inside)).when(bare.rlike(r"^\s*[0-9.]+(\s*,\s*[0-9.]+)*\s*$"), bare)
    parts = F.transform(F.split(listed, ","), lambda p: T.strip(p).try_cast("double"))
    return F.transform(parts, lambda v: F.when(v.isin(*GRADES), v))


def single_grade(x: Column) -> Column:
    """The grade of a per-rubric verdict; null unless 0, 0.5 or 1."""
    v = F.nullif(F.regexp_extract(x, r"(?s)<score>\s*([0-9.]+)\s*</score>", 1), F.lit("")).try_cast("double")
    return F.when(v.isin(*GRADES), v)


def grade_errors(x: Column) -> Column:
    """Why a verdict list is not valid; empty if it is."""
    grades = comma_grades(x)
    bad = F.filter(F.transform(grades, lambda g, i: F.when(g.isNull(), F.concat(F.lit("Score "), (i + 1).cast("string"), F.lit(": invalid")))), lambda e: e.isNotNull())
    missing = F.when(x.contains("<scores>"), F.lit("Unclosed <scores> tag")).otherwise(F.lit("Missing <scores> tags"))
    return F.when(grades.isNull(), F.array(missing)).otherwise(bad)


# The error messages of graders' output.
_INVALID = ", must be 0, 0.5, or 1"


def _assessment(i: Column, text: str) -> Column:
    return F.concat(F.lit("Assessment "), (i + 1).cast("string"), F.lit(f": {text}"))


def xml_grades(x: Column) -> Column:
    """``(scores, errors)`` of ``<evaluation>`` with its assessments; an assessment without a valid score has none."""
    body = F.get(T.blocks(x, "evaluation"), F.lit(0))
    first = lambda a, tag: F.get(T.blocks(a, tag), F.lit(0))

    def read(a, i):
        raw = F.nullif(F.regexp_extract(a, r"<score>\s*([0-9.]+)\s*</score>", 1), F.lit(""))
        value = raw.try_cast("double")
        wrong = F.when(raw.isNull(), _assessment(i, "Missing <score> tag")).when(value.isNull(), F.concat(_assessment(i, "Non-numeric score: "), raw)).when(~value.isin(*GRADES), F.concat(_assessment(i, "Invalid score "), value.cast("string"), F.lit(_INVALID)))
        errors = F.array_compact(F.array(F.when(first(a, "rubric").isNull(), _assessment(i, "Missing <rubric> tag")), F.when(first(a, "reasoning").isNull(), _assessment(i, "Missing <reasoning> tag")), wrong))
        return F.struct(F.when(wrong.isNull(), value).alias("score"), errors.alias("errors"))

    def collected(cells):
        none = F.when(body.isNull() & x.contains("<evaluation>"), F.lit("Unclosed <evaluation> tag")).when(body.isNull(), F.lit("Missing <evaluation> tags")).when(F.size(cells) == 0, F.lit("No <rubric_assessment> blocks found"))
        return _graded(cells, none)

    return T.let(F.transform(T.blocks(body, "rubric_assessment"), read), collected)


def json_grades(x: Column) -> Column:
    """``(scores, errors)`` of the JSON array from the first bracket to the last; objects have rubric, reasoning and score."""
    body = F.nullif(F.regexp_extract(x, r"(?s)(\[.*\])", 1), F.lit(""))
    items = F.from_json(body, "array<string>")

    def read(item, i):
        raw = F.get_json_object(item, "$.score")
        value = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
        wrong = F.when(~F.coalesce(item.startswith("{"), F.lit(False)), _assessment(i, "Expected object")).when(raw.isNull(), _assessment(i, "Missing 'score' field")).when(value.isNull(), F.concat(_assessment(i, "Invalid score type: "), raw)).when(~value.isin(*GRADES), F.concat(_assessment(i, "Invalid score "), value.cast("string"), F.lit(_INVALID)))
        return F.struct(F.when(wrong.isNull(), value).alias("score"), F.array_compact(F.array(wrong)).alias("errors"))

    def collected(cells):
        return _graded(cells, F.when(body.isNull(), F.lit("No JSON array found in response")).when(items.isNull(), F.lit("JSON parse error")))

    return T.let(F.transform(items, read), collected)


def _graded(cells: Column, none: Column) -> Column:
    """Scores and errors of parsed assessments; ``none`` is the error of the whole text, if it has one."""
    scores = F.filter(F.transform(cells, lambda c: c["score"]), lambda v: v.isNotNull())
    errors = F.when(none.isNotNull(), F.array(none)).otherwise(F.flatten(F.transform(cells, lambda c: c["errors"])))
    return F.struct(F.coalesce(scores, F.array().cast("array<double>")).alias("scores"), errors.alias("errors"))


RUBRIC = r"(?s)<rubric(?:\s+priority=\"([^\"]*)\")?\s*>(.*?)</rubric>"


def rubrics(x: Column) -> Column:
    """``(text, priority)`` of non-empty rubric tags."""
    found = F.arrays_zip(F.regexp_extract_all(x, F.lit(RUBRIC), F.lit(2)).alias("text"), F.regexp_extract_all(x, F.lit(RUBRIC), F.lit(1)).alias("priority"))
    cells = F.transform(found, lambda r: F.struct(T.strip(r["text"]).alias("text"), F.nullif(r["priority"], F.lit("")).alias("priority")))
    return F.filter(cells, lambda r: r["text"] != "")


def json_rubrics(x: Column) -> Column:
    """Rubrics of the JSON object in a text."""
    parsed = F.from_json(T.lenient_json(x), "rubrics array<struct<rubric:string,priority:string>>")
    return F.transform(parsed["rubrics"], lambda r: F.struct(T.strip(r["rubric"]).alias("text"), r["priority"].alias("priority")))


def points_score(met: Column, points: Column) -> Column:
    """Aggregate over criteria: met points over positive points, within 0 and 1."""
    top = F.sum(F.when(points > 0, points).otherwise(0.0))
    return F.when(top > 0, F.greatest(F.least(F.sum(F.when(met, points).otherwise(0.0)) / top, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def coverage_score(x: Column) -> Column:
    """Mean of (mark - 1) / 4 over lines that are exactly a known label; 0 without any."""
    marks = F.create_map(*[F.lit(v) for pair in COVERAGE.items() for v in pair])
    known = F.array_compact(F.transform(F.split(F.lower(x), "\n"), lambda line: F.try_element_at(marks, T.strip(line))))
    total = F.aggregate(known, F.lit(0.0), lambda a, m: a + (m - 1) / 4.0)
    return F.when(F.size(known) > 0, total / F.greatest(F.size(known), F.lit(1))).otherwise(0.0)


def dimension_score(x: Column, names: list[str], default: float = 3.0) -> Column:
    """Mean over dimensions of the JSON's marks, a missing one being the default."""
    parsed = F.from_json(T.lenient_json(x), ", ".join(f"{n} double" for n in names))
    total = F.lit(0.0)
    for n in names:
        total = total + F.coalesce(parsed[n], F.lit(default))
    return total / len(names)


def scale_score(x: Column, low: float = 1.0, high: float = 10.0) -> Column:
    """A mark on a scale, clipped to it; missing is the lowest."""
    v = F.coalesce(F.nullif(F.regexp_extract(x, r"[Ss]core\"?\s*:\s*\"?(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double"), F.lit(low))
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def verdict(x: Column) -> Column:
    """The last ``[[label]]`` of a pairwise judgement."""
    found = F.filter(F.regexp_extract_all(x, F.lit(r"\[\[\s*([AB<>=]+)\s*\]\]"), F.lit(1)), lambda v: v.isin(*VERDICTS))
    return T.last(found)


def pairwise_score(first: Column, second: Column) -> Column:
    """Two rounds, the candidate being B in the first and A in the second; strong verdicts count three times, none at all a half."""
    b = F.create_map(*[F.lit(v) for k, (s, n) in VERDICTS.items() for v in (k, 1.0 - s)])
    a = F.create_map(*[F.lit(v) for k, (s, n) in VERDICTS.items() for v in (k, s)])
    times = F.create_map(*[F.lit(v) for k, (s, n) in VERDICTS.items() for v in (k, n)])
    marks = F.flatten(F.array_compact(F.array(F.when(first.isNotNull(), F.array_repeat(F.try_element_at(b, first), F.try_element_at(times, first))), F.when(second.isNotNull(), F.array_repeat(F.try_element_at(a, second), F.try_element_at(times, second))))))
    return F.when(F.size(marks) > 0, F.aggregate(marks, F.lit(0.0), lambda s, m: s + m) / F.greatest(F.size(marks), F.lit(1))).otherwise(0.5)


def route(source: Column, scorers: dict[str, Column]) -> Column:
    """The scorer registered for a data source (by prefix); unknown sources are -1."""
    out = F.lit(-1.0)
    for prefix, s in scorers.items():
        out = F.when(source.startswith(prefix), s).otherwise(out)
    return out
