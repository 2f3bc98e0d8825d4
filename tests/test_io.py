"""Sources, sinks, hooks and streams on small folders."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieve, validate
from millrace.sources import io
from millrace.streaming import monitor


def test_corpus_and_jsonl(spark, tmp_path):
    at = str(tmp_path / "c")
    spark.createDataFrame([(1, "Title\nbody\nmore"), (2, "alone")], "doc_id long, contents string").write.json(at)
    rows = {r["doc_id"]: (r["title"], r["body"]) for r in io.load_corpus(spark, at).collect()}
    assert rows == {1: ("Title", "body\nmore"), 2: ("alone", "")}
    io.write_tasks(spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_tasks(spark.range(2), str(tmp_path / "t"))


def test_encoder_and_generator_hooks(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "row_id long, text string")
    out = io.encode(df, lambda s: s.map(lambda t: [float(len(t)), 0.0])).collect()
    assert all(r["v"] == [1.0, 0.0] for r in out)
    made = validate.generate(df.na.fill("x").withColumnRenamed("text", "prompt"), lambda s: s.map(str.upper), 2).collect()
    assert {r["row_id"]: r["responses"] for r in made} == {1: ["ABC#0", "ABC#1"], 2: ["X#0", "X#1"]}


def test_accumulation_resumes(spark, tmp_path):
    src, sink, mark = (str(tmp_path / n) for n in ("src", "sink", "mark"))
    schema = "row_id long"
    spark.range(10).toDF("row_id").coalesce(1).write.parquet(src)
    keep = lambda b: b.where("row_id % 2 = 0")
    assert monitor.accumulate(spark, src, schema, sink, mark, keep, 8) == 5
    spark.range(10, 20).toDF("row_id").coalesce(1).write.mode("append").parquet(src)
    assert monitor.accumulate(spark, src, schema, sink, mark, keep, 8) == 10
    spark.range(20, 30).toDF("row_id").coalesce(1).write.mode("append").parquet(src)
    assert monitor.accumulate(spark, src, schema, sink, mark, keep, 8) == 10


def test_search_errors_and_fan_in(spark):
    tasks = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "task_id long, queries array<string>")
    answers = spark.createDataFrame([(1, 1, "B"), (1, 0, "A")], "task_id long, pos int, answer string")
    got = {r["task_id"]: (r["answers"], r["error"]) for r in retrieve.fan_in(tasks, answers).collect()}
    assert got == {1: (["A", "B"], None), 2: ([], "count mismatch")}


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_dense_search_is_alike_at_any_number_of_queries(spark, monkeypatch, block):
    """Ties, repeats, nulls, ragged and unusable vectors, against every product."""
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "CORPUS_ROWS", 7)
    vectors = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [float("nan")]), (63, [float("inf"), 1.0]), (64, [9.0]), (65, []), (66, [1.0, 1.0, 1.0, 50.0]), (None, [99.0] * 3), (3, [3.0, 0.0, 1.0])]
    asked = vectors[:5] + vectors[60:] + [(70, [1.0, 0.0, 0.0, 2.0, 5.0]), (2, [2.0, 2.0, 1.0])]
    e = spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, q array<double>")
    fine = lambda v: v is not None and all(x is not None and abs(x) < float("inf") for x in v)
    want = []
    for name, x in asked:
        if name is not None and fine(x):
            scores = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for i, v in vectors if i is not None and fine(v))
            want += [(name, i, -s + 0.0, r) for r, (s, i) in enumerate(scores[:4], 1)]
    got = [(r["query_id"], r["vec_id"], r["score"] + 0.0, r["rank"]) for r in retrieve.dense_top_k(q, e, 4).collect()]
    assert sorted(got) == sorted(want)
    assert retrieve.dense_top_k(q.limit(0), e, 4).collect() == [] == retrieve.dense_top_k(q, e.limit(0), 4).collect()


def test_registry(spark):
    reg = validate.RewardRegistry()
    reg.register_batch("len", lambda x, g: len(x))
    with pytest.raises(ValueError):
        reg.register("len", lambda x, g: x)
    with pytest.raises(ValueError):
        reg.score("other", F.lit("a"), F.lit("b"))
    df = spark.createDataFrame(pd.DataFrame({"x": ["ab", "abc"]}))
    assert sorted(r[0] for r in df.select(reg.score("len", F.col("x"), F.lit(""))).collect()) == [2.0, 3.0]
