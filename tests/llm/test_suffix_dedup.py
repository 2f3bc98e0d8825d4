"""Removed bytes against a direct count of every 200-byte string."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup
from millrace.llm.suffix_dedup import remove_repeats


def brute(rows, length=200):
    raws = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, raw in raws:
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    shared = [prose(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = [(i, prose(rng.randint(0, 500)) + (rng.choice(shared) if rng.random() < 0.6 else "") + prose(rng.randint(0, 300))) for i in range(60)]
    near = prose(900)
    rows += [(100 + i, near[: 100 * i] + "#" + near[100 * i :]) for i in range(6)]
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "ab" * 300), (204, "\0" * 450), (205, rows[3][1]), (3, rows[3][1]), (206, "b" * 199), (207, "b" * 199), (208, prose(5000) * 2)]
    return rows


def check(spark, rows, length=200, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(map(tuple, remove_repeats(df, length=length).collect()), key=str) == brute(rows, length)


def test_against_all_strings(spark):
    check(spark, corpus(3))


def test_one_passage_in_every_text(spark):
    """One bucket of many members, whose spans differ at both ends of the passage, beside copies and near copies of it."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ij\n") for _ in range(n))
    passage, long = prose(330), prose(700)
    rows = [(i, prose(rng.randint(0, 250)) + passage + prose(rng.randint(0, 250))) for i in range(120)]
    rows += [(200 + i, passage) for i in range(30)] + [(300 + i, long[:300] + chr(65 + i % 26) * (i % 3) + long[300:]) for i in range(60)]
    rows += [(400 + i, "x" * (200 + i)) for i in range(5)] + [(None, passage), (None, None)]
    check(spark, rows, parts=7)


@pytest.mark.parametrize("length", [64, 75, 131])
def test_other_lengths(spark, length):
    check(spark, corpus(6)[:70], length)


def test_slices_of_a_long_text():
    """Cutting a text into slices changes neither which windows there are nor their sample positions."""
    rng = random.Random(5)
    raw = "".join(rng.choice("ab ") for _ in range(40_000)).encode()

    def windows(part, at):
        h, pos, first, last = suffix_dedup.sample(part, np.array([0, len(part)]), 200)
        return {(w + at, p + at, k) for k, p, a, b in zip(h.tolist(), pos.tolist(), first.tolist(), last.tolist(), strict=True) for w in range(a, b + 1)}

    step = 1000 - 199
    cut = [windows(raw[k : k + 1000], k) for k in range(0, len(raw) - 199, step)]
    assert set().union(*cut) == windows(raw, 0)
    assert sum(map(len, cut)) == len(raw) - 199


def test_long_texts(spark):
    check(spark, corpus(4) + [(900, "".join(f"{i:05d}" for i in range(30000))), (901, "".join(f"{i:05d}" for i in range(20000, 34000)))])


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, h string, nid int")).collect() == []
