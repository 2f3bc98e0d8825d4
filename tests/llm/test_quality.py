"""Quality measures and the cross-document line rule against plain Python."""

import random
import re
from collections import defaultdict

from millrace.llm import quality
from millrace.llm.quality import keep_good, quality_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def norm(line):
    return " ".join(words(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def brute(rows, max_docs, min_words=50, share=50, left=25):
    where = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if words(line):
                where[(s, norm(line))].add(t or "")
    out = []
    for doc, t, _, s, _ in rows:
        w = words(t)
        grams = list(zip(w, w[1:], w[2:]))
        rep = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        gone = sum(len(words(x)) for x in lines if len(where[(s, norm(x))]) > max_docs)
        failed = len(w) < min_words or 100 * len(rep) > 50 * len(w)
        depleted = gone > 0 and (100 * gone > share * len(w) or len(w) - gone < left)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), gone, failed, not failed and not depleted))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    vocab = ["alpha", "Béta", "#x", "12", "34", "<b>", "é", "\x1cq", "gamma"] + [f"v{i}" for i in range(80)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 20)))
    boiler = [line() for _ in range(6)]
    rows = []
    for i in range(80):
        lines = [line() for _ in range(rng.randint(0, 9))] + [rng.choice(boiler) for _ in range(rng.randint(0, 5))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", rng.choice(["h1", "h2", None, ""]), 0))
    rows += [(200, None, "en", "h1", 0), (201, "", "en", "h1", 0), (202, "a b c " * 40, "en", "h2", 0), (203, "\n \n\t", "en", "h2", 0), rows[3], (204, rows[3][1], "en", rows[3][3], 0)]
    return rows


def test_against_python(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, quality_verdicts(df, max_docs=6).collect())) == brute(rows, 6)


def test_filter_removes_lines_and_documents(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = keep_good(df, max_docs=6)
    assert kept.columns == df.columns
    want = sorted(d for d, *_, ok in brute(rows, 6) if ok)
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == want
    gone = {d: n for d, _, _, _, _, _, n, _, _ in brute(rows, 6)}
    size = {r[0]: len(words(r[1])) for r in rows}
    for r in got:
        assert len(words(r["text"])) == size[r["doc_id"]] - gone[r["doc_id"]]
        assert r["n_chars"] == (len(r["text"]) if gone[r["doc_id"]] else 0)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "doc_id AS row", "'a' AS host", "'b' AS content", "'c' AS kept", "'d' AS drop", "'e' AS left", "'f' AS __host")
    kept = keep_good(df, max_docs=6)
    assert kept.columns == df.columns
    got = kept.collect()
    assert {tuple(r[c] for c in ("host", "content", "kept", "drop", "left", "__host")) for r in got} == {("a", "b", "c", "d", "e", "f")} and all(r["row"] == r["doc_id"] for r in got)


def test_null_and_empty_hosts_are_two(spark):
    rows = [(i, "same line here\n" + f"w{i} " * 60, "en", None if i % 2 else "", 0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["removed_words"] for r in quality_verdicts(df, max_docs=6).collect()} == {0}
    assert {r["removed_words"] for r in quality_verdicts(df, max_docs=5).collect()} == {3}


def test_windows_across_slices(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        raw = b"".join(rng.choice([b"a", b"b", b"c", b" ", b"\n", b"dd "]) for _ in range(rng.randint(0, 60)))
        monkeypatch.setattr(quality, "SLICE_BYTES", rng.randint(1, 30))
        w = raw.split()
        grams = list(zip(w, w[1:], w[2:], strict=False))
        want = len({k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)})
        numbers = quality.numbered_words(raw)
        assert len(numbers) == len(w) and quality.repeated_window_words(numbers) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA + ", host string, content int")
    assert quality_verdicts(df).collect() == [] and keep_good(df).collect() == []
