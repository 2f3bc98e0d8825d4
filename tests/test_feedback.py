"""Time limits, stateful tools, overlapping stages, curriculum, logits and maps at their edges."""

import math
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import logits, maps
from millrace.functions.timed import ScorerPool, timed_scorer
from millrace.streaming import monitor
from millrace.streaming.curriculum import Curriculum
from millrace.streaming.overlap import overlapped
from millrace.streaming.tools import run_tools


def made():
    """A scorer that travels by value, since workers cannot import the tests."""

    def scorer(x):
        import os

        if x == "hang":
            while True:
                pass
        if x == "end":
            os._exit(3)
        if x == "raise":
            raise ValueError
        return None if x == "none" else len(x)

    return scorer


def test_a_hanging_or_ending_scorer_costs_its_own_score_only():
    pool = ScorerPool(made(), 0.3, 2)
    began = time.monotonic()
    calls = ["a", "hang", "end", "bbb", "raise", "hang", "none", None, "cc", "end", "d"]
    try:
        assert pool.scores([(c,) for c in calls]) == [1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0]
        assert pool.ended == 4 and pool.scores([("abcd",)]) == [4.0] and pool.scores([]) == []
    finally:
        pool.close()
    assert time.monotonic() - began < 5


def test_timed_scores_of_a_table(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "hang"), (3, "end"), (4, None), (5, "x")], "row_id long, x string").repartition(2)
    got = df.select("row_id", timed_scorer(made(), 0.5)(F.col("x")).alias("s")).collect()
    assert dict(map(tuple, got)) == {1: 3.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}


def test_logits_in_blocks_equal_rows_and_stay_finite(spark):
    rows = [(1, [0.0, 1.0, 2.0, 3.0, 4.0], 2), (2, [1e4, -1e4, 0.0], 0), (3, [-1e4, -1e4], 1), (4, [5.0], 0), (5, [0.0, float("-inf"), 1.0], 2), (6, [1.0, 2.0], 7), (7, [0.0] * 1000, 999)]
    df = spark.createDataFrame(rows, "row_id long, logits array<double>, label int")
    whole = {r["row_id"]: r["m"] for r in df.select("row_id", logits.from_row(F.col("logits"), F.col("label")).alias("m")).collect()}
    blocks = df.select("row_id", "label", F.explode(F.sequence(F.lit(0), F.size("logits") - 1, F.lit(2))).alias("first"), "logits").withColumn("logits", F.slice("logits", F.col("first") + 1, F.lit(2)))
    parts = {r["row_id"]: r for r in logits.from_blocks(blocks.repartition(4)).collect()}
    for row, x, label in rows:
        top = max(x)
        z = sum(math.exp(v - top) for v in x)
        entropy = math.log(z) - sum(math.exp(v - top) * (v - top) for v in x if v > float("-inf")) / z
        for got in (whole[row], parts[row]):
            assert got["entropy"] == pytest.approx(entropy, abs=1e-9)
            assert got["logp"] == (pytest.approx(x[label] - top - math.log(z), abs=1e-9) if label < len(x) else None)


def test_maps_merge_or_refuse(spark):
    df = spark.createDataFrame([({"a": "1", "n": None}, {"b": "2", "a": "1"}), ({}, {"c": "3"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in df.select(maps.merge(F.col("x"), F.col("y"))).collect()] == [{"a": "1", "n": None, "b": "2"}, {"c": "3"}]
    for other in ({"a": "2"}, {"n": "1"}):
        bad = spark.createDataFrame([({"a": "1", "n": None}, other)], "x map<string,string>, y map<string,string>")
        with pytest.raises(Exception, match="two values"):
            bad.select(maps.merge(F.col("x"), F.col("y"))).collect()


def calls(spark, rows):
    df = spark.createDataFrame(rows, "trajectory long, call_id long, hour double, action string, tool string, reward double")
    return df.select("trajectory", "call_id", F.timestamp_millis((F.col("hour") * 3_600_000).cast("long")).alias("at"), "action", "tool", "reward")


def test_tools_go_on_after_a_restart(spark, tmp_path):
    first = [(1, 1, 1.0, "execute", "a", 1.0), (1, 2, 2.0, "execute", "b", 2.0), (2, 3, 1.0, "execute", "a", 1.0), (3, 4, 2.5, "release", "a", 0.0), (4, 5, 1.0, "execute", "a", 4.0)]
    second = [(1, 6, 5.0, "execute", "a", 3.0), (1, 7, 6.0, "release", "", 0.0), (4, 8, 30.0, "execute", "b", 1.0), (5, 9, 60.0, "execute", "b", 1.0)]
    want = {(1, 1, 3, 2, 6.0, "released"), (2, 3, 1, 1, 1.0, "expired"), (4, 5, 1, 1, 4.0, "expired"), (4, 8, 1, 1, 1.0, "expired")}
    for name, cuts in (("once", [first + second]), ("twice", [first, second])):
        src, out, mark = (str(tmp_path / name / x) for x in ("src", "out", "mark"))
        for some in cuts:
            calls(spark, some).coalesce(1).write.mode("append").parquet(src)
            got = run_tools(spark, src, calls(spark, first).schema, out, mark, 10 * 3_600_000).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def saver(spark, folder):
    def save(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return save


def test_stages_overlap_and_keep_order(spark, tmp_path):
    times = {}

    def stage(name):
        def run(df):
            k = df.first()[0] // 10
            begun = time.monotonic()
            time.sleep(0.5)
            times[name, k] = begun, time.monotonic()
            return df.withColumn(name, F.lit(k))

        return run

    batches = [spark.range(10 * k, 10 * k + 5) for k in range(4)]
    out = overlapped(spark, batches, stage("first"), stage("second"), saver(spark, str(tmp_path)))
    assert [r.first()["second"] for r in out] == [0, 1, 2, 3] and sum(r.count() for r in out) == 20
    assert any(times["first", k + 1][0] < times["second", k][1] and times["second", k][0] < times["first", k + 1][1] for k in range(3))


@pytest.mark.parametrize("where", ["first", "second"])
def test_an_error_ends_both_stages(spark, tmp_path, where):
    begun = []

    def fail(df):
        raise RuntimeError(f"no {where}")

    def fine(df):
        begun.append(1)
        return df

    batches = (spark.range(3) for _ in range(50))
    with pytest.raises(RuntimeError, match=f"no {where}"):
        overlapped(spark, batches, fail if where == "first" else fine, fail if where == "second" else fine, saver(spark, str(tmp_path)))
    assert len(begun) < 6


def test_curriculum_draws_by_weight_and_keeps_versions(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("g"))
    c = Curriculum(spark, str(tmp_path / "w"), rate=1.0, floor=0.1)
    c.start(rows, "g")
    c.update(c.sample(rows, "g", 500, 0), "g", F.when(F.col("g") == "easy", 1.0).otherwise(0.2), 0)
    assert {r["grp"]: round(r["weight"], 9) for r in c.weights(1).collect()} == {"easy": 0.1, "hard": 0.8}
    drawn = {r["g"]: r["count"] for r in c.sample(rows, "g", 900, 1).groupBy("g").count().collect()}
    assert sum(drawn.values()) == 900 and 5 < drawn["hard"] / drawn["easy"] < 12
    assert {r["weight"] for r in c.weights(0).collect()} == {1.0}
    c.update(rows.limit(0), "g", F.lit(1.0), 1)
    assert {r["grp"]: round(r["weight"], 9) for r in c.weights(2).collect()} == {"easy": 0.1, "hard": 0.8}


def test_accumulation_stops_at_the_target(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).toDF("row_id").coalesce(1).write.mode("append").parquet(src)
    assert monitor.accumulate(spark, src, "row_id long", sink, mark, lambda b: b, 17, order="row_id") == 17
    assert sorted(r[0] for r in spark.read.schema("row_id long").parquet(f"{sink}/batch=*").collect()) == list(range(17))


def test_chat_rows_against_lists(spark):
    import random

    from millrace.operators.chatrow import chat_rows

    rng = random.Random(5)
    chats = [(k, [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice([None, "", " ".join(rng.choices("abcdef", k=rng.randint(1, 12)))])) for _ in range(rng.randint(0, 6))]) for k in range(80)]
    df = spark.createDataFrame(chats, "conv_id long, turns array<struct<role:string,text:string>>")
    for most_p, most_r, most in ((8, 10, 14), (1, 1, 1), (5, 40, 12), (100, 100, 200)):
        got = {r["conv_id"]: (r["prompt"], r["response"], r["loss_mask"], r["positions"]) for r in chat_rows(df, most_p, most_r, most).collect()}
        for k, turns in chats:
            cells, cut = [], None
            for role, text in turns:
                cells += [("<|im_start|>", 0), (role, 0)]
                if role == "assistant" and cut is None:
                    cut = len(cells)
                mine = int(role == "assistant")
                cells += [(w, mine) for w in (text or "").split()] + [("<|im_end|>", mine)]
            cut = len(cells) if cut is None else cut
            p, r = cells[:cut][-most_p:], cells[cut:][:most_r][-most:]
            p = p[max(0, len(p) + len(r) - most) :]
            assert got[k] == ([t for t, _ in p], [t for t, _ in r], [0] * len(p) + [m for _, m in r], list(range(len(p) + len(r)))), k


def test_greedy_rubric_dedup_against_python(spark):
    import random

    from millrace.functions.text import dedup_rubrics

    rng = random.Random(6)
    rows = [(k, [rng.choice([" ".join(rng.choices(["Be", "be", "clear", "cite", "x", "sources", "short"], k=rng.randint(1, 5))), "", "  "]) for _ in range(rng.randint(0, 8))]) for k in range(200)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k long, r array<string>").select("k", dedup_rubrics(F.col("r"))).collect()}
    for k, texts in rows:
        kept = []
        for i, t in enumerate(texts):
            bag = set(t.lower().split())
            if not any(min(len(bag), len(o)) and len(bag & o) / min(len(bag), len(o)) > 0.6 for o in (set(texts[j].lower().split()) for j in kept)):
                kept.append(i)
        assert got[k] == kept, texts
