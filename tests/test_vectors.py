"""Unit vectors worked out by hand, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import advantage as adv
from millrace.functions import loss, score, text
from millrace.operators import batch, curate, metrics, render


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rolls(spark, rows):
    return spark.createDataFrame([(i, u, "s", float(x), n) for i, (u, x, n) in enumerate(rows)], "row_id long, uid string, data_source string, score double, len long")


def values(df):
    return [r["advantage"] for r in df.orderBy("row_id").collect()]


def test_group_advantages(spark):
    df = rolls(spark, [("a", 1, 3), ("a", 0, 1), ("b", 3, 2)])
    assert values(adv.rloo(df)) == [1.0, -1.0, 3.0]
    g = values(adv.grpo(df))
    assert g[:2] == pytest.approx([0.707106, -0.707106], abs=1e-6) and g[2] == pytest.approx(2.999997, abs=1e-6)
    assert values(adv.opo(df))[:2] == [0.25, -0.75]
    assert values(adv.grpo_passk(rolls(spark, [("a", 1, 1), ("a", 0.4, 1), ("a", 0, 1)]), by_std=False)) == pytest.approx([0.6, 0, 0])
    with pytest.raises(Exception, match="two samples"):
        values(adv.grpo_passk(df))
    with pytest.raises(ValueError, match="unknown"):
        adv.advantages(df, "nothing")


def test_difficulties(spark):
    tent = lambda s: score.tent_difficulty(F.lit(float(s)), F.lit(4))
    assert list(one(spark, *[tent(s).alias(f"c{s}") for s in range(5)])) == [0.0, 0.5, 1.0, 0.5, 0.0]
    cont = lambda s: score.continuous_difficulty(F.lit(s), F.lit(4))
    assert list(one(spark, cont(1.0), cont(3.5), cont(0.5))) == pytest.approx([1.0, 0.1667, 1.0], abs=1e-4)
    em = lambda c: score.em_difficulty(F.lit(c), F.lit(4))
    assert list(one(spark, em(1), em(0), em(4))) == [1.0, 0.0, 0.0]
    pen = lambda n: score.length_penalty(F.lit(n), 1024, 2048, 0.05)
    assert list(one(spark, pen(1024), pen(1536), pen(2048))) == pytest.approx([1.0, 0.525, 0.05])


def test_rubric_recovery(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(spark, score.recovered_sum(arr(1, 1), F.lit(4)).alias("a"), score.recovered_sum(arr(1), F.lit(4)).alias("b"), score.recovered_sum(arr(1, 1, 1, 1, 1), F.lit(4)).alias("c"))
    assert list(r) == [2.0, None, 4.0]


def test_quality_gate(spark):
    gate = lambda *x: score.quality_gate(F.array(*[F.lit(v).cast("int") for v in x]), 2)
    assert list(one(spark, gate(1, 1).alias("a"), gate(1, 0).alias("b"), gate(1, None).alias("c"))) == [True, False, False]


def test_text(spark):
    assert one(spark, text.normalize_answer(F.lit("The  Cat, a dog!")))[0] == "cat dog"
    x = "<|im_start|>user\n<answer>no</answer><|im_end|>first <answer>A</answer>\nuser\n<answer>env</answer>\nassistant\nthen <answer>B\nuser\nq\nassistant\nend"
    assert one(spark, text.solver_answer(F.lit(x)))[0] == "B"
    assert one(spark, text.solver_answer(F.lit("so \\boxed{7} and \\boxed{8}")))[0] == "8"
    assert one(spark, text.solver_answer(F.lit("<answer>open")))[0] is None
    assert one(spark, text.strip_env_turns(F.lit("a\nuser\nb\nassistant\nc")))[0].split() == ["a", "assistant", "c"]


def test_pairwise_and_majority(spark):
    assert one(spark, score.pairwise_score(F.lit("A>>B"), F.lit(None).cast("string")))[0] == 0.0
    df = spark.createDataFrame([("k", "x", 0.0, 0), ("k", "y", 1.0, 1), ("k", "y", 0.0, 2)], "key string, vote string, value double, pos int")
    assert metrics.majority_value(df, ["key"]).first()["value"] == 1.0


def test_schedule(spark):
    rows = render.turns_schedule(spark, 9, render.parse_turns("4:3:2"), 1).collect()
    assert sorted(r["turns"] for r in rows) == [1] * 4 + [2] * 3 + [3] * 2
    for bad in ("", "a", "0:0", "1:-1"):
        with pytest.raises(ValueError):
            render.parse_turns(bad)


def test_balancing_covers_every_item():
    rng = random.Random(2)
    for equal in (False, True):
        for method in (batch.differencing, batch.greedy):
            lengths = [rng.randint(1, 900) for _ in range(64)]
            parts = method(lengths, 8, equal)
            assert sorted(i for p in parts for i in p) == list(range(64))
            if equal:
                assert {len(p) for p in parts} == {8}
            loads = [sum(lengths[i] for i in p) for p in parts]
            assert max(loads) <= 1.5 * sum(loads) / 8
    with pytest.raises(ValueError):
        batch.differencing([1], 2)


def test_kl_controller():
    c = loss.kl_controller("adaptive", 0.2, 6.0, 100.0)
    assert c.update(600.0, 10) == pytest.approx(0.2 * 1.02)
    assert loss.kl_controller("fixed", 0.3).update(9, 9) == 0.3
    with pytest.raises(NotImplementedError):
        loss.kl_penalty(F.lit(1.0), F.lit(2.0), "full")


def test_whitening_needs_two_tokens(spark):
    with pytest.raises(Exception, match="two unmasked"):
        adv.reinforce_baseline(rolls(spark, [("a", 1, 1)])).collect()


def test_parsers_refuse():
    for bad in ("", "nope"):
        with pytest.raises(ValueError):
            curate.parse_gates(bad)
    with pytest.raises(ValueError):
        render.select_task_types({"a": "x"}, ["a"], ["a"])
    with pytest.raises(ValueError):
        render.select_task_types({"a": "x"}, exclude=["a"])


def test_bootstrap_between_extremes(spark):
    rows = [("d", "p", "v", i, float(x), "m") for i, x in enumerate([3, 1, 2, 8, 5])]
    df = spark.createDataFrame(rows, "data_source string, prompt string, var string, pos long, value double, pred string")
    got = {r["metric"]: r["value"] for r in metrics.validation_metrics(df, votes=True).collect()}
    assert got["worst@4/mean"] <= got["mean@5"] <= got["best@4/mean"] <= 8
    assert got["best@4/mean"] == pytest.approx(metrics.expected_extreme(df, 4).first()["value"], abs=0.2)
    assert got["maj@5/mean"] == pytest.approx(3.8, abs=0.3)  # all vote alike: the first one drawn counts


def test_resampling_follows_weights(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([1, 0, 3, 6])], "row_id long, weight double")
    got = {r["row_id"]: r["count"] for r in loss.resample(df, 4000, seed=1).groupBy("row_id").count().collect()}
    assert sum(got.values()) == 4000 and 1 not in got
    assert got[3] == pytest.approx(2400, rel=0.1) and got[0] == pytest.approx(400, rel=0.2)


def test_errors_and_caps(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else None) for i in range(10)], "row_id long, src string")
    assert curate.cap_per_prompt(df, 2, "src", "row_id").count() == 7
    with pytest.raises(ValueError):
        batch.shuffled_slice(df, 1, 10)
    with pytest.raises(Exception, match="longer than"):
        spark.range(1).select(render.truncate(F.array(*[F.lit(1).cast("long")] * 4), 3)).collect()


def chat(*turns):
    return "".join(f"<|im_start|>{role}\n{said}<|im_end|>\n" for role, said in turns)


def test_task_format(spark):
    """Two of three turns think; two good searches and a broken one; a task in the last turn."""
    x = chat(("user", "<search>not mine</search>"), ("assistant", "<think>a</think><search>q</search>"), ("user", "<information>i</information>"), ("assistant", "<search>r</search>"), ("assistant", " <think>b</think> <search>open"), ("assistant", "<task>old</task> <task> do </task>"))
    of = lambda *a, **k: one(spark, score.task_format(F.lit(x), *a, **k).alias("f"))["f"]
    assert list(of()) == pytest.approx([0.5, 2 / 3, 1.0, (0.5 + 2 / 3 + 1) / 3])
    assert list(of(2)) == pytest.approx([0.5, 0.5, 1.0, 2 / 3])  # (2 good - 1 broken) of 2
    assert of(0)["tool"] == 1.0 and of(markup="tool_call")["tool"] == 0.0
    submit = chat(("assistant", '<think>t</think><tool_call>{"name": "submit_task", "arguments": {"task_prompt": " p "}}</tool_call>'))
    assert list(one(spark, score.task_format(F.lit(submit)).alias("f"))["f"]) == [1.0, 1.0, 1.0, 1.0]  # nothing to search, nothing searched
    assert list(one(spark, score.task_format(F.lit("")).alias("f"))["f"]) == pytest.approx([0.0, 1.0, 0.0, 1 / 3])
    lone = chat(("assistant", "<search>q</search>"))
    assert one(spark, score.task_format(F.lit(lone)).alias("f"))["f"]["tool"] == 0.0


def test_answer_format(spark):
    """Searches count in all turns but the last, thoughts within their budget."""
    x = chat(("assistant", "<think>one two three</think><search>q</search>"), ("user", "<search>nudge</search>"), ("assistant", "<think>one</think> nothing"), ("assistant", "<search>late</search><answer> A </answer>"))
    of = lambda v, **k: list(one(spark, score.answer_format(F.lit(v), **k).alias("f"))["f"])
    assert of(x) == pytest.approx([2 / 3, 0.5, 1.0, (2 / 3 + 0.5 + 1) / 3])
    assert of(x, think_budget=2) == pytest.approx([1 / 3, 0.5, 1.0, (1 / 3 + 0.5 + 1) / 3])
    many = chat(("assistant", "<search>a</search><search>b</search>"), ("assistant", "<answer></answer>"))
    assert of(many) == pytest.approx([0.0, 1.0, 0.0, 1 / 3])
    assert of(chat(("assistant", "<think>t</think><answer>A</answer>"))) == pytest.approx([1.0, 0.0, 1.0, 2 / 3])
    call = chat(("assistant", '<tool_call>{"name": "search", "arguments": {"query_list": ["a"]}}</tool_call>'), ("assistant", "<answer>A</answer>"))
    assert of(call, markup="tool_call") == pytest.approx([0.0, 1.0, 1.0, 2 / 3])
    fc = chat(("assistant", '<function_calls>search(query="a")</function_calls>'), ("assistant", "<answer>A</answer>"))
    assert of(fc, markup="function_calls") == pytest.approx([0.0, 1.0, 1.0, 2 / 3])
    with pytest.raises(ValueError, match="unknown markup"):
        score.answer_format(F.lit(x), markup="other")


def test_grader_formats(spark):
    xml = "<evaluation><rubric_assessment><rubric>a</rubric><reasoning>b</reasoning><score>0.5</score></rubric_assessment><rubric_assessment><score>7</score></rubric_assessment></evaluation>"
    got = one(spark, score.xml_grades(F.lit(xml)).alias("g"))["g"]
    assert got["scores"] == [0.5] and got["errors"] == ["Assessment 2: Missing <rubric> tag", "Assessment 2: Missing <reasoning> tag", "Assessment 2: Invalid score 7.0, must be 0, 0.5, or 1"]
    got = one(spark, score.json_grades(F.lit('x [{"rubric": "[r]", "score": "1"}, {"score": true}, {"score": null}] y')).alias("g"))["g"]
    assert got["scores"] == [1.0, 1.0] and got["errors"] == ["Assessment 3: Missing 'score' field"]


def test_rows_without_a_number_keep_a_place(spark):
    df = spark.createDataFrame([(5, "a"), (None, "b"), (10**12, "c"), (1, "d"), (None, "e")], "row_id long, x string")
    up = {r["x"]: r["ord"] for r in batch.by_number(df).collect()}
    assert sorted(up.values()) == [0, 1, 2, 3, 4] and {up["b"], up["e"]} == {0, 1} and up["d"] < up["a"] < up["c"]
    down = {r["x"]: r["ord"] for r in batch.by_number(df, descending=True).collect()}
    assert sorted(down.values()) == [0, 1, 2, 3, 4] and {down["b"], down["e"]} == {3, 4} and down["c"] == 0


def test_balanced_loads_are_those_of_a_plain_search(spark):
    """Part by part: greedy against the lightest bin by linear search, differencing against a list that is sorted anew each time."""
    rng = random.Random(12)
    rows = [(i, rng.choice((1, 2, 3, 50, rng.randint(1, 400)))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, len long")

    def greedy(lens, k):
        loads = [0] * k
        for n in lens:
            loads[min(range(k), key=lambda p: (loads[p], p))] += n
        return sorted(loads)

    def differencing(lens, k):
        states = [(t, sorted([n] + [0] * (k - 1), reverse=True)) for t, n in enumerate(sorted(lens))]
        tick = len(states)
        while len(states) > 1:
            states.sort(key=lambda s: (s[1][-1] - s[1][0], s[0]))
            (_, a), (_, b) = states[:2]
            states = [*states[2:], (tick, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))]
            tick += 1
        return sorted(states[0][1])

    for method, plain in ((batch.greedy, greedy), (batch.differencing, differencing)):
        got = {}
        for r in batch.balance(df, 7, batch_size=100, method=method).groupBy("batch", "part").agg(F.sum("len").alias("load")).collect():
            got.setdefault(r["batch"], []).append(r["load"])
        want = {b: plain([n for i, n in rows if i // 100 == b], 7) for b in range(3)}
        assert {b: sorted(v) for b, v in got.items()} == want
