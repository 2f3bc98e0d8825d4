"""Preference rows against plain Python."""

from millrace.llm.chat import format_preferences, pairs_from_conversations

TURNS = "array<struct<role:string,text:string>>"


def plain(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    show = lambda ts: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in ts)

    def mask(ts):
        at, out = 0, []
        for a, b in ts:
            start = at + len(f"<|im_start|>{a}\n")
            at += len(show([(a, b)]))
            if a == "assistant":
                out.append(f"{start}:{at}")
        return ",".join(out)

    return n, show(c[:n]), show(c[n:]), show(r[n:]), mask(c[n:]), mask(r[n:])


def test_pairs(spark):
    a = [("system", "s"), ("user", "héllo"), ("assistant", "𝒳 yes"), ("user", ""), ("assistant", "b")]
    cases = [(a, a[:2] + [("assistant", "no")]), (a, a), (a, []), ([], a), ([], []), (a, [("user", "s"), *a[1:]]), (a[:3], a), (a * 300, a * 299 + [("assistant", "z")])]
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(cases)] + [(99, None, None)], f"pair_id long, chosen {TURNS}, rejected {TURNS}")
    got = {r[0]: tuple(r)[1:] for r in format_preferences(df).collect()}
    for i, (c, r) in enumerate(cases):
        assert got[i] == plain(c, r), i
    assert got[99] == plain([], [])


def test_from_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "q2"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "only"), (3, 1, "assistant", "x"), (3, 0, None, None), (4, 0, "assistant", "r"), (4, 0, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r[0]: tuple(r)[1:] for r in format_preferences(pairs_from_conversations(df)).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1] == plain([("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "b")], [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "a")])
    assert got[3] == plain([("user", ""), ("assistant", "x")], [("user", ""), ("assistant", "")])
    assert got[4] == plain([("assistant", "r")] * 2, [("assistant", "r")] * 2)
    assert pairs_from_conversations(df.where("false")).collect() == []
