"""Capitals letter by letter, and the query that uses them on every row of its table."""

import pytest

from millrace import queries as registry
from millrace.functions import text as T

ROWS = [(1, "Straße ﬁn ŉ ᾳ ɤ ä"), (3, "groß\n𐐨x"), (2, "straße"), (-1, "é"), (-2, "ö"), (None, "ß"), (5, None), (7, "")]


def test_length_stays(spark):
    got = spark.createDataFrame(ROWS, "item_id long, text string").select("text", T.upper("text").alias("u")).collect()
    assert {r["text"]: r["u"] for r in got} == {"Straße ﬁn ŉ ᾳ ɤ ä": "STRAẞE ﬁN ŉ ᾼ ɤ Ä", "groß\n𐐨x": "GROẞ\n𐐀X", "straße": "STRAẞE", "é": "É", "ö": "Ö", "ß": "ẞ", None: None, "": ""}


def test_every_letter_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    letters = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    got = spark.createDataFrame([(c, chr(c)) for c in letters], "c int, s string").select("c", T.upper("s").alias("u")).collect()
    want = dict(duckdb.sql("SELECT i::INT, upper(chr(i::INT)) FROM range(1, 1114112) r(i) WHERE i < 55296 OR i > 57343").fetchall())
    assert [r["c"] for r in got if r["u"] != want[r["c"]]] == []


def test_benchmark_rows_are_all_there(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(ROWS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.queries()["s13_benchmark_rows"](spark, str(tmp_path)).collect()
    sql = registry.oracle_sql()["s13_benchmark_rows"]
    want = duckdb.sql(f"WITH benchmark AS (SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet') {sql}").fetchall()
    assert len(got) == len(ROWS) and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
