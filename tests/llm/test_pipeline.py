"""The pipeline's stages, one after the other, on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(500)]
    prose = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(100, prose[0], "en", "s1", 1), (101, prose[1] + " more", "en", "s2", 1), (102, "short", "en", "s0", 5), (103, None, "en", None, None), (104, prose[2] + " mail joe.doe@mail.example.com", "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    ids = lambda name: {r["doc_id"] for r in kept[name].collect()}
    assert ids("quality") == set(range(40)) | {100, 101, 104}
    assert ids("near_duplicates") == set(range(40))
    assert all(kept[n].columns == corpus_pipeline.COLUMNS for n in list(kept)[:-1])
    mixed = kept["mixing"].groupBy("doc_id").count().collect()
    packed = kept["packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in mixed} == {r[0] for r in packed} <= set(range(40))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, kept["packing"].select("doc_id", "start", "ids_crc32").collect()))


def test_stages_on_empty_tables_and_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(200))
    some = spark.createDataFrame([(1, text, "en", None, 1), (2, text + " x", "en", "", 1), (None, text[::-1], "en", "s", 1)], schema)
    wide = some.selectExpr("*", "'a' AS row", "'b' AS host", "'c' AS copy", "'d' AS nid", "1 AS start", "'e' AS raw", "'f' AS grp")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, some.where("false"), str(tmp_path))
        assert none.collect() == [], name
        got, plain = stage(spark, wide, str(tmp_path)), stage(spark, some, str(tmp_path))
        assert got.columns == plain.columns == none.columns, name
        assert sorted(map(str, got.drop("sequence_id", "offset").collect())) == sorted(map(str, plain.drop("sequence_id", "offset").collect())), name
