"""Removal of every byte covered by a repeated string of ``length`` bytes.

Blockwise comparison of suffixes over a cover sample, arranged so that no
task ever holds an unbounded bucket and no suffix is shipped:

1. Every position's ``GRAM``-byte string gets a name by doubling names of 8
   and 16 bytes.  The leftmost smallest name in a window of ``length`` bytes
   is the window's *sample position*.  It depends on the window's bytes only,
   so equal windows have it at equal offsets: the sample covers every pair of
   equal windows, as a difference cover does, but at one known difference
   instead of one that depends on the pair.
2. The windows with one sample position are consecutive, an *entry*.  Its
   bucket is the name of its gram, its span the bytes that its windows cover.
   A bucket met once holds no repeated window and goes.  Where all members of
   a bucket have one span, all their windows are repeated.  Otherwise members
   with equal spans are settled, and one of them goes on for all.
3. Members that go on are cut into classes of ``WIDTH`` windows.  A class's
   bucket is the name of the bytes common to its windows, its span the few
   bytes around them.  Step 2 is applied again.
4. What is left are single windows, told apart by their bucket and
   ``WIDTH - 1`` further bytes, and counted.

All three rounds are counts with partial sums followed by joins, for buckets
of every size alike: a passage in a third of all texts is merged where its
rows are.  Names are 64-bit hashes, compared only within a bucket of another
64-bit name, texts by one 64-bit hash; see the README for why no suffix array
is kept.

Copies of a whole text are one text with a count.  Null is an empty text;
texts under ``length`` bytes lose nothing; long texts are read in slices.
Rows repeated under one ``doc_id``, or without one, count as further
occurrences and get one result row each.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import bucketed, flat_bytes, materialize, slices, text_rows

GRAM = 32
#: Bytes of text that are named together; arrays of eight times this size stay in a core's cache.
SLICE = 1 << 16
#: Windows of a class in the second round.
WIDTH = 13

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def gram_names(raw: bytes) -> np.ndarray:
    """A 64-bit name of the ``GRAM`` bytes at each position, by doubling names of 8 and of 16 bytes."""
    name = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()
    for size, mix in ((8, _ODD[0]), (16, _ODD[1])):
        name *= mix
        name ^= name >> np.uint64(32)
        pair = name[:-size] * _ODD[2]
        pair += name[size:]
        name = pair
    name ^= name >> np.uint64(29)
    name *= _ODD[3]
    name ^= name >> np.uint64(32)
    return name


def sample(raw: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket name, sample position, first and last window start of every entry.

    ``bounds`` divides ``raw`` into texts; windows lie inside one text.
    """
    names, span = gram_names(raw), length - GRAM + 1
    low = np.uint64(SLICE * 256 - 1)
    least = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    done = 1
    while done < span:  # least of the next `done` positions, doubled until it is `span`
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    starts = np.arange(len(least))
    starts = starts[starts + length <= np.repeat(bounds[1:], np.diff(bounds))[: len(least)]]
    at = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    return names[at[new]], at[new], starts[new], starts[np.r_[new[1:], len(at)] - 1] if len(at) else starts


_ENTRIES = "h long, span long, nid long, start long, off int, n int"


def _enter(length: int):
    """Entries of all texts: the first window's start, its distance to the sample position, the number of windows."""
    names = ["h", "span", "nid", "start", "off", "n"]

    def flush(parts: list[tuple[int, int, bytes]]):
        raw = b"".join(p[2] for p in parts)
        bounds = np.r_[0, np.cumsum([len(p[2]) for p in parts])]
        h, at, first, last = sample(raw, bounds, length)
        off = at - first
        hashed = xxhash.xxh3_64_intdigest
        span = np.fromiter((hashed(raw[a:b], o) for a, b, o in zip(first.tolist(), (last + length).tolist(), off.tolist(), strict=True)), np.uint64, len(first))
        which = np.searchsorted(bounds, first, side="right") - 1
        nid = np.array([p[0] for p in parts], np.int64)[which]
        start = first - bounds[which] + np.array([p[1] for p in parts], np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), span.view(np.int64), nid, start, off.astype(np.int32), (last - first + 1).astype(np.int32))], names=names)

    def run(batches):
        parts: list[tuple[int, int, bytes]] = []
        held, step = 0, SLICE - length + 1
        for b in batches:
            out = []
            for nid, cell in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = cell.as_buffer().to_pybytes()
                for k in range(0, len(raw) - length + 1, step):
                    part = raw[k : k + SLICE]
                    if held and held + len(part) > SLICE:
                        out.append(flush(parts))
                        parts, held = [], 0
                    parts.append((nid, k, part))
                    held += len(part)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if parts:
            yield flush(parts)

    return run


_CLASSES = "h long, core long, around binary, lo int, hi int, nid long, start long, n int"


def _divide(length: int):
    """Classes of the entries that go on: windows at distances ``lo`` to ``hi`` before the class's first common byte."""
    names = ["h", "core", "around", "lo", "hi", "nid", "start", "n"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for nid, cell, entries in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = cell.as_buffer().to_pybytes()
                for e in entries:
                    at, far = e["start"] + e["off"], e["off"]
                    near = far - e["n"] + 1
                    for k in range(near // WIDTH, far // WIDTH + 1):
                        base = at - k * WIDTH
                        lo, hi = max(near - k * WIDTH, 0), min(far - k * WIDTH, WIDTH - 1)
                        end = base - WIDTH + 1 + length
                        core = xxhash.xxh3_64_intdigest(raw[base:end], k)
                        around = raw[base - hi : base] + raw[end : end + WIDTH - 1 - lo]
                        for o, v in zip(out, (e["h"], core, around, lo, hi, nid, base - hi, hi - lo + 1), strict=True):
                            o.append(v)
            out[1] = np.array(out[1], np.uint64).view(np.int64)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=names)

    return run


def _settle(entries: DataFrame, bucket: list[str], span: list[str], name: str) -> DataFrame:
    """Entries of buckets with several members; ``twice``: another has this span, ``on``: it goes on for all with its span."""
    ref, whole = F.xxhash64("nid", "start"), F.xxhash64(*span) if len(span) > 1 else F.col(span[0])
    met = entries.groupBy(bucket).agg(F.min(ref).alias("a"), F.max(ref).alias("b"), F.min(whole).alias("c"), F.max(whole).alias("d"))
    met = materialize(met.where("a <> b").select(*bucket, (F.col("c") != F.col("d")).alias("mixed")), f"{name}-met")
    rows = materialize(entries.join(met, bucket).withColumn("ref", ref), name)
    mixed = rows.where("mixed")
    spans = materialize(mixed.groupBy(bucket + span).agg(F.min("ref").alias("one"), F.max("ref").alias("other")), f"{name}-spans")
    mixed = mixed.join(spans, bucket + span)
    told = mixed.withColumn("twice", F.col("one") != F.col("other")).withColumn("on", F.col("ref") == F.col("one"))
    alike = rows.where("NOT mixed").withColumn("twice", F.lit(True)).withColumn("on", F.lit(False))
    columns = [*entries.columns, "twice", "on"]
    return materialize(told.select(columns).union(alike.select(columns)), f"{name}-told")


def _cut(length: int):
    """What is left of texts of which some windows, given as runs of starts, are repeated."""

    def run(batches):
        names = ["nid", "n_removed", "n_spans", "kept_sha256"]
        for b in batches:
            for first, count in slices(b.column(1), 1 << 23):
                part = b.slice(first, count)
                texts, runs = part.column(1), part.column(2)
                raw, at = flat_bytes(texts)
                flat = runs.flatten()
                base = np.repeat(at[:-1], np.diff(runs.offsets.to_numpy()))
                begin = flat.field("start").to_numpy() + base
                size = len(raw) + 1
                change = np.bincount(begin, minlength=size) - np.bincount(begin + flat.field("n").to_numpy() + (length - 1), minlength=size)
                gone = np.cumsum(change[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = at[:-1][1:]
                opens[inner] = gone[inner]
                removed, spans = np.add.reduceat(gone, at[:-1], dtype=np.int64), np.add.reduceat(opens, at[:-1], dtype=np.int64)
                kept, left = raw[~gone].tobytes(), np.r_[0, np.cumsum(np.diff(at) - removed)].tolist()
                sums = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(left, left[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed), pa.array(spans), pa.array(sums)], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row per input row."""
    if length < GRAM + WIDTH:
        raise ValueError(f"length must be at least {GRAM + WIDTH}")
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    rows = rows.withColumn("nid", F.xxhash64("raw"))
    texts = bucketed(rows.where(F.length("raw") >= length).groupBy("nid").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies")), "texts", "nid")

    entries = materialize(texts.select("nid", "raw").mapInArrow(_enter(length), _ENTRIES), "entries")
    first = _settle(entries, ["h"], ["span"], "first")
    by_text = first.where("on").groupBy("nid").agg(F.collect_list(F.struct("h", "start", "off", "n")).alias("entries"))
    classes = texts.select("nid", "raw").join(by_text, "nid").select("nid", "raw", "entries").mapInArrow(_divide(length), _CLASSES)
    second = _settle(materialize(classes, "classes"), ["h", "core"], ["around", "lo", "hi"], "second")

    window = second.where("on").select("h", "core", "around", "hi", "nid", "start", F.explode(F.expr("sequence(lo, hi)")).alias("j"))
    window = window.select("h", "core", "j", F.expr(f"substring(around, hi - j + 1, {WIDTH - 1})").alias("more"), "nid", (F.col("start") + F.col("hi") - F.col("j")).alias("start"), F.lit(1).alias("n"))
    third = _repeated(window, ["h", "core", "j", "more"])

    runs = first.where("twice").select("nid", "start", "n").union(second.where("twice").select("nid", "start", "n")).union(third)
    runs = runs.groupBy("nid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    cut = texts.where("copies = 1").select("nid", "raw").join(runs, "nid").select("nid", "raw", "runs").mapInArrow(_cut(length), "nid long, n_removed long, n_spans long, kept_sha256 string")
    whole = texts.where("copies > 1").select("nid", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    found = materialize(cut.union(whole).withColumnsRenamed({"kept_sha256": "rest"}), "found")

    every = rows.select("doc_id", "nid", F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("all_sha256")).join(found, "nid", "left")
    removed = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes"))
    return every.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("rest", "all_sha256").alias("kept_sha256"))


def _repeated(windows: DataFrame, bucket: list[str]) -> DataFrame:
    """Runs of windows whose bucket has several members."""
    ref = F.xxhash64("nid", "start")
    windows = materialize(windows, "windows")
    met = windows.groupBy(bucket).agg(F.min(ref).alias("a"), F.max(ref).alias("b")).where("a <> b").select(bucket)
    met = materialize(met, "windows-met")  # so that both sides of the join are plain shuffles, whose large partitions are split
    return windows.join(met, bucket, "left_semi").select("nid", "start", "n")
