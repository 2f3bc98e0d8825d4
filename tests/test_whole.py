"""Registered queries work on whole tables."""

import functools
import os

import numpy as np
import pytest

from millrace import queries as registry
from millrace.operators import batch, metrics, retrieve
from test_queries import plain

SF = "/root/testdata/sf0.01"
TABLES = "events documents benchmark".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@functools.cache
def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture
def duck():
    pytest.importorskip("duckdb")
    return connection()


def same(spark, duck, name, sql):
    """The query's rows, after they were found to be those of ``sql``; sums may differ in their last digit."""
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    texts = lambda r: tuple(repr(v) for v in r if not isinstance(v, float))
    order = lambda r: (texts(r), [v for v in r if isinstance(v, float)])
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(columns).collect()), key=order)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    want = sorted((tuple(plain(v) for v in r) for r in want), key=order)
    assert [texts(r) for r in rows] == [texts(r) for r in want]
    numbers = lambda rs: [v for r in rs for v in r if isinstance(v, float)]
    assert numbers(rows) == pytest.approx(numbers(want), rel=1e-9, abs=2e-6)
    return rows


@needs_tables
@pytest.mark.parametrize("name", ["a5_validation_metrics", "a6_expected_best", "a7_worst_of_n", "a8_majority", "a9_roll_up", "a10_offline_eval"])
def test_metrics_use_all_rollouts(spark, duck, name):
    same(spark, duck, name, SQL[name])


@needs_tables
def test_bootstrap_uses_all_rollouts(spark, duck):
    prompts = duck.execute("SELECT event_type, event_id // 20, count(*) FROM events GROUP BY ALL").fetchall()
    got = {(r["data_source"], r["metric"]) for r in QUERIES["a6_bootstrap"](spark, SF).collect()}
    assert {(s, f"mean@{n}") for s, _, n in prompts} == {x for x in got if x[1].startswith("mean@")}


def test_majority_takes_first_of_the_most_frequent(spark):
    rng = np.random.RandomState(0)
    votes, values = [str(v) for v in rng.randint(0, 3, 9)], rng.rand(9)
    df = spark.createDataFrame([("d", "p", "v", i, float(values[i]), votes[i]) for i in range(9)], "data_source string, prompt string, var string, pos long, value double, pred string")
    got = {r["metric"]: r["value"] for r in metrics.validation_metrics(df, votes=True).collect()}
    for k in (2, 4, 8, 9):
        best = []
        for row in metrics.bootstrap_table(9, k):
            drawn = [votes[i] for i in row]
            vote = max(drawn, key=drawn.count)  # the first drawn of equally frequent ones
            best.append(values[row[drawn.index(vote)]])
        assert got[f"maj@{k}/mean"] == pytest.approx(np.mean(best)) and got[f"maj@{k}/std"] == pytest.approx(np.std(best))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')"


@needs_tables
def test_overlap_covers_whole_documents(spark, duck):
    grams = "SELECT {k} AS k, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {k}, {w} AS w FROM {t}) WHERE len(w) > 3)"
    own, known = grams.format(k="doc_id", w=_TOKENS, t="documents"), grams.format(k="item_id", w=_TOKENS, t="benchmark")
    hits = f"SELECT k, count(*) AS n, count(*) FILTER (g IN (SELECT g FROM ({known}))) AS hits FROM ({own}) GROUP BY k"
    rows = same(spark, duck, "t12_ngram_overlap", f"SELECT doc_id, round(coalesce(hits / n::DOUBLE, 0.0), 6) + 0.0 AS overlap FROM documents LEFT JOIN ({hits}) ON k = doc_id")
    assert len(rows) == 1000


def test_overlap_sees_late_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)) + " a b c d e"), (2, "a b c"), (3, None), (4, "a b c d x a b c d")], "doc_id long, text string")
    evidence = spark.createDataFrame([("A, b c d.",), ("b c d e",)], "text string")
    want = {1: 2 / 402, 2: 0.0, 3: 0.0, 4: 2 / 6}
    for most in (retrieve.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_GRAMS", most)
        assert {r["doc_id"]: r["overlap"] for r in retrieve.ngram_overlap(docs, evidence, 4).collect()} == pytest.approx(want)


@needs_tables
def test_bm25_searches_for_whole_texts(spark, duck):
    same(spark, duck, "j2_bm25", SQL["j2_bm25"])


@needs_tables
def test_short_form_rewards_all_documents(spark, duck):
    assert len(same(spark, duck, "d6_short_form", SQL["d6_short_form"])) == 1000


def test_resampling_draws_as_many_as_rows(spark, tmp_path):
    spark.range(250).selectExpr("id AS event_id", "id AS user_id", "'s' AS event_type", "CAST(id % 7 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    rows = QUERIES["l9_resample"](spark, str(tmp_path)).collect()
    assert sorted(r["draw"] for r in rows) == list(range(250))
    assert all(r["score"] == r["row_id"] % 7 and r["score"] > 0 for r in rows)


@needs_tables
def test_collate_carries_all_rows(spark, duck):
    rows = sorted(QUERIES["b13_collate"](spark, SF).collect(), key=lambda r: r["chunk"])
    got = [x for r in rows for x in zip(r["row_id"], r["uid"], r["data_source"], r["score"], r["len"], strict=True)]
    assert got == duck.execute("SELECT event_id, user_id, event_type, value, 1 + event_id % 16 FROM events ORDER BY 1").fetchall()
    assert [len(r["row_id"]) for r in rows] == [100] * 100


@needs_tables
def test_partition_is_a_fifth_of_all_rows(spark, duck):
    assert len(same(spark, duck, "b4_partition", SQL["b4_partition"])) == 2000


@needs_tables
def test_unpad_returns_the_whole_table(spark, duck):
    assert len(same(spark, duck, "b11_unpad", "SELECT event_id AS row_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id < (SELECT (64 - count(*) % 64) % 64 FROM events)")) == 10_048


def test_small_batches(spark):
    ten = spark.range(10).withColumnRenamed("id", "row_id")
    padded, added = batch.pad_to_divisor(ten, 64)  # more to add than there is
    assert added == 54 and padded.count() == 64
    assert sorted(r["row_id"] for r in batch.unpad(padded).collect()) == list(range(10))
    parts = [sorted(r["row_id"] for r in batch.partition_of(ten.where("row_id < 8"), i, 3).collect()) for i in range(3)]
    assert parts == [[0, 1], [2, 3], [4, 5]]  # the two rows over are in none


@needs_tables
def test_append_keeps_all_rows(spark, duck):
    assert len(same(spark, duck, "r6_append", "SELECT event_id AS row_id FROM events")) == 10_000
