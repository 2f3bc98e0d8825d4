"""The shard store: round trips, atomic versions, tiers and targets."""

import pytest

from millrace.llm._work import scratch
from millrace.llm.sharding import CommitConflict, ShardStore


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip_through_compaction(spark):
    store = ShardStore(spark, scratch(spark, "store"), target_bytes=60_000, fanout=3, base_bytes=2_000)
    rows = [(i, None if i % 7 == 0 else f"text {i} " * (i % 50), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for k in range(6):
        store.append(df.where(f"doc_id % 6 = {k}").repartition(2))
    first = store.version()
    assert first == 6 and content(store.read(df.schema)) == content(df)
    before = store.manifest().count()
    store.compact(df.schema)
    assert store.manifest().count() < before
    assert content(store.read(df.schema)) == content(df)
    assert content(store.read(df.schema, first)) == content(df)
    assert store.runs(store.version()).count() == 0
    assert content(store.read(df.schema, first)) == content(df)
    store.vacuum(keep_versions=1)  # all files are younger than the grace period
    assert content(store.read(df.schema)) == content(df)
    with pytest.raises(ValueError, match="no version"):
        store.read(df.schema, first)
    store.vacuum(keep_versions=1, grace_seconds=0)
    assert content(store.read(df.schema)) == content(df)
    assert len(store._files(f"{store.root}/data")) == store.manifest().count()


def test_one_writer_wins(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    df = spark.range(5).withColumnRenamed("id", "doc_id")
    v = store.append(df)
    same = store.manifest().select("shard", "bytes", "seq", "tier")
    store.commit(same, v)
    with pytest.raises(CommitConflict):
        store.commit(same, v)
    assert store.version() == v + 1 and content(store.read(df.schema)) == content(df)


def test_empty_and_arrivals(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    df = spark.range(0).withColumnRenamed("id", "doc_id")
    assert store.read(df.schema).collect() == []
    store.append(df)
    store.compact(df.schema)
    assert store.read(df.schema).collect() == []
    more = spark.range(20).selectExpr("id AS doc_id", "id % 4 AS arrival")
    assert store.append_each(more, "arrival") == 2
    assert sorted(r[0] for r in store.manifest().select("seq").distinct().collect()) == [1, 2, 3, 4, 5]
    assert content(store.read(df.schema)) == [(i,) for i in range(20)] or len(content(store.read(df.schema))) == 20


def test_vacuum_beside_a_writer_that_has_not_committed(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    df = spark.range(6).withColumnRenamed("id", "doc_id")
    v = store.append(df.where("doc_id < 3"))
    folder = f"{store.root}/data/late"
    df.where("doc_id >= 3").write.parquet(folder)
    store.vacuum(keep_versions=1)
    store.commit(store.manifest(v).select("shard", "bytes", "seq", "tier").unionByName(store._listed([(f, n, v + 1) for f, n in store._files(folder)])), v)
    assert content(store.read(df.schema)) == content(df)


def test_kept_versions_can_be_read(spark):
    store = ShardStore(spark, scratch(spark, "store"), target_bytes=60_000, fanout=2, base_bytes=2_000)
    df = spark.range(40).withColumnRenamed("id", "doc_id")
    for k in range(4):
        store.append(df.where(f"doc_id % 4 = {k}"))
    store.compact(df.schema)
    store.vacuum(keep_versions=3, grace_seconds=0)
    last = store.version()
    assert content(store.read(df.schema)) == content(df) and content(store.read(df.schema, last - 1)) and content(store.read(df.schema, last - 2))
    with pytest.raises(ValueError, match="no version"):
        store.read(df.schema, 1)
    with pytest.raises(ValueError):
        store.vacuum(keep_versions=0)
