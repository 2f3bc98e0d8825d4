"""Ranked search against a score of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import wavelet
from millrace.llm.wavelet import LexicalIndex, Shard, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Sorted ``(item_id, rank, doc_id, score)``; ids may be None."""
    bags = [(doc, terms(t)) for doc, t in docs]
    total, count = sum(len(b) for _, b in bags), sum(bool(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for doc, b in bags:
            score = 0
            for t in set(terms(text)):
                if tf := b.count(t):
                    m = 50 + (50 * len(b) * count) // total
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=repr)


def corpus(rng):
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "naïve", "x1", "ÀB", "zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=n))
    docs = [(i * 3 % 1000, text(rng.randint(0, 30))) for i in range(900)]
    docs += [(5000 + i, docs[7][1]) for i in range(80)] + [(None, docs[7][1]), (None, "zz zz"), (21, "zz W1"), (21, "zz W1"), (6001, None), (6002, ""), (6003, " ,;"), (6004, text(20000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(40, docs[7][1]), (41, None), (42, ""), (43, "nowhere"), (None, "zz w3"), (2, "zz"), (44, text(3000))]
    return docs, items


@pytest.mark.parametrize("postings", [1 << 19, 500])
def test_equals_scoring_every_document(spark, monkeypatch, postings):
    monkeypatch.setattr(wavelet, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(wavelet, "ITEM_BLOCK", 16)
    docs, items = corpus(random.Random(4))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int").repartition(3)
    i = spark.createDataFrame([(*x, "a") for x in items], "item_id long, text string, terms string")
    got = sorted(map(tuple, ranked_search(d, i, 20).collect()), key=repr)
    assert got == brute(docs, items, 20)


def test_full_index_gives_the_same(spark, monkeypatch):
    docs, items = corpus(random.Random(6))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(wavelet, "MAX_TERMS", 3)
    got = sorted(map(tuple, ranked_search(d, i, 7).collect()), key=repr)
    assert got == brute(docs, items, 7)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(none, items).collect() == []
    assert ranked_search(some, items.where("false")).collect() == []
    assert ranked_search(some.withColumn("text", some["text"].substr(0, 0)), items).collect() == []


def test_tree_ranges_are_the_postings_of_a_node(spark):
    rng = np.random.default_rng(2)
    docs = 3000
    pairs = np.unique(rng.integers(0, 12, 9000) * docs + rng.integers(0, docs, 9000))
    term, local, worth = pairs // docs, pairs % docs, rng.integers(1, 50, len(pairs))
    order = rng.permutation(len(pairs))
    s = Shard.build(np.arange(docs), pa.array([f"t{i:02}" for i in range(12)]), term[order], local[order], worth[order])
    assert s.depth == 4
    ranges = {(0, 0): (s.starts[:-1], s.starts[1:])}
    for level in range(s.depth):
        for node in range(1 << level):
            if (level, node) in ranges:
                for child, a, b in s.children(level, node, *ranges[level, node]):
                    ranges[level + 1, child] = a, b
    for (level, node), (a, b) in ranges.items():
        inside = local >> (8 + s.depth - level) == node
        for t in range(12):
            want = np.sort(worth[inside & (term == t)])[::-1]
            assert np.array_equal(s.worth[level, a[t] : b[t]], want)  # in order of impact at every node


def test_search_does_not_open_every_leaf(spark):
    rng = np.random.default_rng(3)
    docs = 1 << 14
    local = np.r_[np.arange(docs), rng.choice(docs, 200, replace=False)]
    term, worth = np.r_[np.zeros(docs, int), np.ones(200, int)], np.r_[rng.integers(1, 10, docs), rng.integers(500, 1000, 200)]
    s = Shard.build(np.arange(docs), pa.array(["a", "b"]), term, local, worth)
    opened, leaf = [], s.leaf
    s.leaf = lambda node, *rest: opened.append(node) or leaf(node, *rest)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores, ids = s.search(np.array([0, 1]), np.array([1, 1]), 5, none)
    every = np.bincount(local, worth).astype(np.int64)
    want = np.lexsort((np.arange(docs), -every))[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert len(opened) <= 12 < docs >> 8
