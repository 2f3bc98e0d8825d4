"""Exact top-k against all products."""

import math
import random

from millrace.llm import topk
from millrace.llm.topk import top_k


def brute(rows, k, every):
    ok = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, p)), j) for m, (j, p) in enumerate(ok) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    rng = random.Random(3)
    for shape in ("unit", "skewed", "aligned"):
        rows = []
        for i in range(1500):
            v = [rng.gauss(0, 1) for _ in range(8)]
            if shape == "aligned":
                v = [x * 0.05 for x in v]
                v[i % 3] += 1
            n = math.sqrt(sum(x * x for x in v)) * (1 if shape == "unit" else rng.paretovariate(1.2))
            rows.append((i, [x / n for x in v]))
        rows += [(2000 + i, rows[5][1]) for i in range(40)] + [rows[7], rows[7], rows[50], (50, rows[7][1]), (3000, None), (3100, [float("nan")] * 8), (3200, [None] * 8), (None, [1.0] * 8), (3300, [0.0] * 8)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        real = [(r[0], r[1]) for r in df.collect()]
        assert sorted(map(tuple, top_k(df, k=10, every=50).collect())) == brute(real, 10, 50), shape
    few = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (5, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(few).collect())) == brute([(r[0], r[1]) for r in few.collect()], 10, 100)
    assert top_k(few.where("false")).collect() == []


def test_short_buckets_are_not_sent(spark, monkeypatch):
    """Lengths of several magnitudes: query blocks go to a part of the groups only, and the rows stay the same."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10 ** -(i % 3) for _ in range(4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BUCKET_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "GROUP_BUCKETS", 1)
    sent, targets = [], topk._targets

    def counted(q, classes):
        out = targets(q, classes)
        sent.append((out.count(), q.count() * classes.agg({"subs": "sum"}).first()[0]))
        return out

    monkeypatch.setattr(topk, "_targets", counted)
    assert sorted(map(tuple, top_k(df, k=3, every=50).collect())) == brute(rows, 3, 50)
    assert sent[0][0] < 0.5 * sent[0][1]


def test_pruning_keeps_every_winner():
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.normal(size=(400, 6)) * rng.pareto(1.5, size=(400, 1))
    p = np.floor(1024 * p[np.argsort(-np.linalg.norm(p, axis=1))]).astype("<i8")
    q = np.floor(1024 * (p[:40] / 1024 + rng.normal(size=(40, 6)) * 0.01)).astype("<i8")
    exact = q @ p.T
    floor = np.sort(exact, axis=1)[:, -3].astype("<i8")
    import pyarrow as pa

    most = float(np.linalg.norm(p, axis=1).max())
    batch = pa.RecordBatch.from_arrays([pa.array([6]), pa.array([np.arange(1000, 1040, dtype="<i8").tobytes()]), pa.array([q.tobytes()]), pa.array([floor.tobytes()]), pa.array([6]), pa.array([np.arange(400, dtype="<i8").tobytes()]), pa.array([np.arange(400, dtype="<i8").tobytes()]), pa.array([p.tobytes()]), pa.array([most])], names=list("abcdefghi"))
    got = {(a, b) for t in topk._search(3)(iter([batch])) for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist())}
    want = {(1000 + i, int(j)) for i in range(40) for j in np.flatnonzero(exact[i] > floor[i])}
    assert want <= got
