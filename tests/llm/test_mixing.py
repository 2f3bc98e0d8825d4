"""Copies per source follow the target weights and the Poisson distribution."""

import hashlib
import math
from collections import Counter

from millrace.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def drawn(doc, rate, seed=17):
    u = int(hashlib.md5(f"{seed}|{doc}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while u >= c and k < 1000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts(spark):
    rows = [(i, "x" * (1 + i % 7), "en", "big" if i % 3 else "small", 0) for i in range(3000)] + [(9000, None, "en", None, 0), (9001, "", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix_sources(df, weights={"big": 1.0, "small": 1.0, "absent": 0.0}, epochs=2.0).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += max(1, len(t or ""))
    total = sum(size.values())
    rate = {s: 2.0 * (0.5 if s else 0) / (size[s] / total) for s in size}
    want = Counter({d: drawn(d, rate[s]) for d, _, _, s, _ in rows if rate[s] and drawn(d, rate[s])})
    got = Counter(r["doc_id"] for r in out)
    assert got == want
    assert all(sorted(r["copy"] for r in out if r["doc_id"] == d) == list(range(got[d])) for d in list(got)[:50])
    for s in ("big", "small"):
        share = sum(len(r["text"]) for r in out if r["source"] == s) / total
        assert abs(share - 1.0) < 0.15
    ids = [r["doc_id"] for r in out]
    assert ids != sorted(ids)


def test_edges(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", "en", "s", 0, 7, "x", "y"), (1, "a", "en", "s", 0, 7, "x", "y"), (None, "b", "en", "s", 0, 7, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", copy int, rate string, cdf string")
    assert mix_sources(df).columns == [*[c for c in df.columns if c != "copy"], "copy"]
    clash = df.selectExpr("*", "'a' AS row", "'b' AS ident", "1 AS u", "2 AS n", "'c' AS at", "'d' AS __source", "3 AS __u")
    out = mix_sources(clash, epochs=3.0)
    assert out.columns == [*[c for c in clash.columns if c != "copy"], "copy"] and {tuple(r[c] for c in ("row", "ident", "u", "n", "at", "__source", "__u")) for r in out.collect()} == {("a", "b", 1, 2, "c", "d", 3)}
    n = Counter(r["doc_id"] for r in mix_sources(df, epochs=300.0).collect())
    assert n[1] % 2 == 0 and n[1] > 300


def test_null_and_empty_sources_are_two(spark):
    rows = [(i, "x" * 10, "en", None if i < 100 else "", 0) for i in range(1000)]
    rate = {None: 1 / (1 + 3) / 0.1, "": 3 / (1 + 3) / 0.9}
    got = Counter(r["doc_id"] for r in mix_sources(spark.createDataFrame(rows, SCHEMA), temperature=0.5).collect())
    assert got == Counter({i: n for i, _, _, s, _ in rows if (n := drawn(i, rate[s]))})


def test_rows_without_an_id_draw_by_text(spark):
    df = spark.createDataFrame([(None, f"text {i}", "en", "s", 0) for i in range(400)], SCHEMA)
    n = Counter(r["text"] for r in mix_sources(df).collect())
    assert 3 <= len(set(n.values())) and 200 < len(n) < 300  # about 1 - 1/e of them come at least once
