"""The stored index against plain BM25 over all postings, and the blocks that it skips."""

import random

import pytest

from millrace.operators import retrieve
from millrace.operators.inverted import StoredIndex


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(1500)]
    rows += [(2000 + i, "rare words together in one place w1 w2") for i in range(5)] + [(3000, None), (3001, ""), (7, "w5 w6 w7")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_same_rows_with_fewer_blocks(spark, docs, tmp_path):
    queries = spark.createDataFrame([(1, "rare words w1"), (2, "w250 w3"), (3, "w1 w1 w2"), (4, "unknown"), (5, ""), (6, None), (7, "w299 w298 w297 w5")], "query_id long, text string")
    index = StoredIndex.build(docs, str(tmp_path / "index"), docs_per_block=16)
    counts = {}
    for k in (1, 3, 40):
        got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in index.search(queries, k, counts).collect())
        want = retrieve.bm25(queries, retrieve.postings(docs), k, stats=retrieve.lengths(docs)).collect()
        assert got == sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in want)
        assert counts["read"] <= counts["all"]
    index.search(queries, 1, counts)
    assert counts["read"] < 0.5 * counts["all"]
    again = StoredIndex(spark, str(tmp_path / "index"))
    assert again.search(queries, 1).count() == 4


def test_empty(spark, docs, tmp_path):
    index = StoredIndex.build(docs.limit(0), str(tmp_path / "none"))
    assert index.search(spark.createDataFrame([(1, "a")], "query_id long, text string"), 3).collect() == []
