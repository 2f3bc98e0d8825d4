"""Fill-in-middle against plain slicing of strings."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm.infill import fill_in_middle, fill_in_middle_digest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(doc, text, units=list):
    text = text or ""
    h = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = units(text)
    n = len(u)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(u[:p]), "".join(u[p:q]), "".join(u[q:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(8)
    parts = ["a", "é", "漢", "🙂", "\n", " ", "<", ">", "S>", "<M", "P", "́", "word "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    return out + [None, "", "x", "<P> here", "a<S>b", "<M>", "🙂" * 48, "y" * 96, "z" * 97, "long é " * 40000]


def test_against_slices(spark):
    rows = [*enumerate(texts()), (3, "other"), (3, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, row string").repartition(3)
    got = sorted((tuple(r) for r in fill_in_middle_digest(df).collect()), key=repr)
    want = [(*b[:5], sha(b[5]), sha(t or "")) for b, t in ((brute(d, t), t) for d, t in rows)]
    assert got == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_units_of_a_pattern(spark):
    rows = [(i, t) for i, t in enumerate(texts()[:200])] + [(900, "one two  three\nfour " * 60)]
    got = sorted((r["doc_id"], r["n"], r["form"], r["output"]) for r in fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"\S+\s*").collect())
    units = lambda t: re.findall(r"[^ \n]+[ \n]*|[ \n]", t)
    assert got == sorted((b[0], b[1], b[2], b[5]) for b in (brute(d, t, units) for d, t in rows))


def test_one_exchange(spark):
    """Runs, requests and offsets meet a document's text where it is."""
    df = fill_in_middle_digest(spark.createDataFrame([(i, f"text {i} " * 50) for i in range(50)], "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.select(*[F.col(c) for c in df.columns])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", re.sub(r"ReusedExchange \[[^\]]*\], Exchange", "Reused", plan))) == 1


def test_empty(spark):
    assert fill_in_middle_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
