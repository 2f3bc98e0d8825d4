"""Packing by minimum bin slack against direct tokenisation and a search of all sums."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bin_slack
from millrace.llm.bin_slack import fullest, minimum_bin_slack, pack_tightly

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fullest_is_the_greatest_feasible_sum():
    rng = random.Random(1)
    for _ in range(300):
        room = rng.randint(1, 40)
        pieces = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        counts = [0] * 41
        for n in pieces:
            counts[n] += 1
        taken = fullest(sorted(set(pieces), reverse=True), counts, room)
        sums = {sum(x) for k in range(len(pieces) + 1) for x in itertools.combinations(pieces, k)}
        assert sum(n * some for n, some in taken) == max(s for s in sums if s <= room)
        for n in {n for n, _ in taken}:
            assert sum(some for m, some in taken if m == n) <= counts[n]


def test_windows_hold_every_piece_once():
    rng = np.random.default_rng(2)
    for capacity, most in ((64, 64), (100, 40), (2048, 2048), (7, 3)):
        lengths = rng.integers(1, most + 1, 500)
        window, offset = minimum_bin_slack(lengths, capacity)
        for w in range(window.max() + 1):
            mine = sorted(zip(offset[window == w].tolist(), lengths[window == w].tolist(), strict=True))
            ends = np.cumsum([n for _, n in mine])
            assert [o for o, _ in mine] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    # No window has more slack than the best use of what was left then.
    assert minimum_bin_slack(np.array([6, 6, 4, 4, 3, 3, 2, 2]), 10)[0].max() + 1 == 3


def test_few_windows():
    rng = np.random.default_rng(5)
    lengths = np.minimum(2048, rng.lognormal(6.3, 0.9, 3000).astype(int) + 1)
    assert minimum_bin_slack(lengths, 2048)[0].max() + 1 <= -(-lengths.sum() // 2048) + 1


def hostile(rng):
    parts = ["the", " the", "  ", "\n", " \n ", " ", "é", " é", "漢字", " 🙂", "<|endoftext|>", "<|", "'s", " 'll", "123", " 45", "...", ",", "\t", "　", "\x1c", " \x85", "  ", "\x00", "a" * 100, "İ", "don't", "a_b.c", "O'Re"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, "", " ", "tok en, " * 3000, "x" * 9000, "\n" * 5000]


def test_pieces_cover_every_id(spark, monkeypatch):
    monkeypatch.setattr(bin_slack, "GROUP_PIECES", 60)
    texts = hostile(random.Random(3))
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id"), (7, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("x"))
    got = [r.asDict() for r in pack_tightly(df, PATH).collect()]
    tok = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        bounds = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(bounds))]
    assert sorted((tuple(p[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for p in got), key=repr) == sorted(want, key=repr)
    by_seq = {}
    for p in got:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for pieces in by_seq.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_words_leave_the_cache(monkeypatch):
    monkeypatch.setattr(bin_slack, "CACHE_WORDS", 20)
    import pyarrow as pa

    tok, mine = Tokenizer.from_file(PATH), bin_slack.ByteTokenizer(PATH)
    for seed in range(6):
        texts = [t or "" for t in hostile(random.Random(seed))]
        ids, at = mine.encode(pa.array(texts), 0)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at.tolist())] == [[*e.ids, 0] for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_empty(spark):
    assert pack_tightly(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
