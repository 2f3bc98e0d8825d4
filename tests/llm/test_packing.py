"""Packing against direct tokenisation and the best-fit rule."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm.packing import best_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array([rng.randint(1, 64) for _ in range(200)])
        window, offset = best_fit_decreasing(lengths, 64)
        room, want = [], np.zeros(len(lengths), int)
        for k in np.argsort(-lengths, kind="stable"):
            fits = [(r, i) for i, r in enumerate(room) if r >= lengths[k]]
            tight = min((r for r, _ in fits), default=None)
            if tight is None:
                room.append(64 - lengths[k])
            else:
                want[k] = 64 - tight
                room[next(i for r, i in fits if r == tight)] -= lengths[k]
        assert len(room) == window.max() + 1
        assert np.array_equal(np.sort(want), np.sort(offset))
        for w in range(len(room)):
            at = 0
            for o, n in sorted((offset[k], lengths[k]) for k in np.flatnonzero(window == w)):
                assert o == at
                at += n
            assert at <= 64


def test_pieces_cover_every_id(spark):
    rng = random.Random(2)
    words = ["the", "The,", "naïve", "İstanbul", "café", "café", "יִ", "don't", "a1b2", "<|endoftext|>", "<|ENDOFTEXT|>", "x" * 300, "1,234.5", "...", " ", "ſ", "Å", "漢字", "🙂", "ΑΣ", "word;", "ab.cd", "e.g.", "\x1c", "　z", "ﬁ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " \n", "tok " * 9000, "\t".join(words), "no space" * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = [r.asDict() for r in pack_documents(df, PATH).collect()]
    tok = Tokenizer.from_file(PATH)
    for doc, text in set(rows):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        times = rows.count((doc, text))
        mine = sorted((p for p in got if p["doc_id"] == doc), key=lambda p: p["start"])
        assert {p["doc_tokens"] for p in mine} == {len(ids)}, repr(text)[:200]
        assert sum(p["length"] for p in mine) == times * len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()), repr(text)[:200]
    by_seq = {}
    for p in got:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
