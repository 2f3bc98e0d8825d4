"""Exact n-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct word n-grams.  All n-grams get one
global order, rarest first; a document of ``n`` n-grams shares at least one
of its first ``n - ceil(t*n) + 1`` with every partner, so only those are
joined.  Steps:

1. One pass hashes n-grams, gives every distinct set its 64-bit node id, and
   counts n-grams in a two-row count sketch of fixed size (``SKETCH_BITS``).
   The order needs to be the same everywhere, not exact, so a fixed sketch
   keeps what is broadcast at a few MB however large the corpus is.
2. A second pass emits each set's prefix as postings (n-gram, node, size,
   position).  Equal sets are one node, so copies are never expanded.  The
   prefix is longer by ``k - 1``: partners share at least ``k`` n-grams of it,
   so a node of which fewer than ``k`` occur in any set of a fitting length
   has no partner and leaves before any pair is formed.
3. Each node is paired with the one set of each of its n-grams that has it
   earliest in its order, and the partner that most n-grams agree on is
   verified on whole texts.  Links give components.
4. Only postings whose n-gram still spans several components are then joined
   pairwise, through the same filters, and each pair is verified once.  So no
   link between different components can be lost, and a large group of near
   copies, which is one component by now, is never expanded into its pairs.

The suffix filter bounds the overlap by the sum over ``BINS`` hash ranges of
the smaller of the two sets' counts there.

Sets are named by 128 bits.  Null and empty texts are empty sets: component is
the document itself.  Rows repeated under one ``doc_id`` get one result row
each.  Rows without an id link others like any row, and their component is the
smallest id that they reach, null if there is none.  An empty table gives no
rows; a very long text is one set, which a task holds as eight bytes a word;
other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import fits, flat_bytes, materialize, slices, text_rows

SKETCH_BITS = 20
SLICE = 1 << 16
BINS = 128
#: The prefix is extended by one n-gram for so many n-grams of a set.
EXTEND = 25
#: Bytes of text whose words are named together.
SLICE_BYTES = 1 << 17
LONG_WORD = 32
#: An n-gram that may occur in more sets is dealt to so many more groups.
HOT_ROWS = 20_000
#: Pairs of one centre, and sets of one n-gram in the last join, that go to one group; more are dealt to so many more.
HOT_PAIRS = 256
#: Components are broadcast for the final lookup only up to this many rows.
BROADCAST_ROWS = 1_000_000

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POSTINGS = "h long, salt int, nid long, sp long"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words of the texts that ``bounds`` divides ``raw`` into, A-Z lowered, and each text's first word.

    Words of up to ``LONG_WORD`` bytes are named eight bytes at a time, all at
    once; longer ones by xxh3.
    """
    x = _LOWER[raw]
    inside = ~_SPACE[x]
    edge = np.ones(len(x) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1 : len(x)])
    edge[bounds] = True
    cut = np.flatnonzero(edge)
    begin, end = cut[:-1], cut[1:]
    word = inside[begin]
    begin, end = begin[word], end[word]
    size = end - begin
    padded = np.zeros(len(x) + LONG_WORD + 7, np.uint8)
    padded[: len(x)] = x
    eights = np.ndarray((len(x) + LONG_WORD,), "<u8", padded, strides=(1,))
    name = _mix(size.astype(np.uint64))
    for at in range(0, LONG_WORD, 8):
        some = np.flatnonzero(size > at)
        part = eights[begin[some] + at] & _FIRST_BYTES[np.minimum(size[some] - at, 8)]
        name[some] = _mix(name[some] * _STEP[0] + part)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        name[k] = xxhash.xxh3_64_intdigest(x[begin[k] : end[k]].tobytes())
    return name, np.searchsorted(begin, bounds)


def _grams(names: np.ndarray, w: int) -> np.ndarray:
    """Names of all runs of ``w`` words."""
    m = len(names) - w + 1
    out = np.full(m, w, np.uint64)
    for k in range(w):
        out += _mix(names[k : m + k] + _STEP[k % 8 : k % 8 + 1] * np.uint64(k + 1))
        out *= _STEP[(k + 3) % 8]
    return _mix(out)


def shingle_sets(texts: pa.BinaryArray, n: int):
    """Sorted distinct 64-bit names of the word n-grams of each text, in order of the texts."""
    for first, count in slices(texts, SLICE_BYTES):
        raw, at = flat_bytes(texts.slice(first, count))
        names, word = word_names(raw, at)
        every = _grams(names, n) if len(names) >= n else names[:0]
        for a, b in zip(word[:-1].tolist(), word[1:].tolist(), strict=True):
            s = np.sort(every[a : b - n + 1] if b - a >= n else _grams(names[a:b], b - a) if b > a else names[:0])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def node_id(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers; the first alone is the node's id once no two sets share it."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes(), seed))


def _cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << SKETCH_BITS) - 1)
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), (s & low).astype(np.int64)


_SETS = "doc_id long, nid long, check long, n long, hist binary, slice int, counts binary"


def _profile(n: int, seed: int):
    def run(batches):
        total = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        used = False
        for b in batches:
            ids, names, ns, hists, pend, held = [], [], [], [], [], 0
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), n), strict=True):
                ids.append(doc)
                ns.append(len(s))
                names.append(node_id(s, seed) if len(s) else (None, None))
                hists.append(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BINS).astype("<u4").tobytes() if len(s) else None)
                pend.append(s)
                held += len(s)
                if held > 1_000_000:
                    for row, cell in enumerate(_cells(np.concatenate(pend))):
                        total[row] += np.bincount(cell, minlength=1 << SKETCH_BITS)
                    pend, held, used = [], 0, True
            if held:
                for row, cell in enumerate(_cells(np.concatenate(pend))):
                    total[row] += np.bincount(cell, minlength=1 << SKETCH_BITS)
                used = True
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)], pa.array(ns, pa.int64()), pa.array(hists, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "nid", "check", "n", "hist", "slice", "counts"],
            )
        if used:
            flat = total.reshape(-1, SLICE)
            k = len(flat)
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array([zlib.compress(x.astype("<u8").tobytes(), 1) for x in flat], pa.binary())],
                names=["doc_id", "nid", "check", "n", "hist", "slice", "counts"],
            )

    return run


def _sum_slices(batches):
    """Adds up sketch slices; holds one counter per slice however many rows come."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(blob), "<u8")
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])


def _sketch(sets: DataFrame) -> np.ndarray:
    """The corpus-wide count sketch: 2 x 2**SKETCH_BITS counters, a fixed size."""
    parts = sets.where(F.col("slice").isNotNull()).select("slice", "counts").coalesce(256)
    rows = parts.mapInArrow(_sum_slices, "slice int, counts binary").repartition("slice").mapInArrow(_sum_slices, "slice int, counts binary").collect()
    flat = np.zeros((2 << SKETCH_BITS) // SLICE * SLICE, np.uint64)
    for r in rows:
        flat[r[0] * SLICE : (r[0] + 1) * SLICE] = np.frombuffer(zlib.decompress(r[1]), "<u8")
    return np.minimum(flat, 2**32 - 1).astype(np.uint32).reshape(2, -1)


def _prefixes(n: int, percent: int, shared, seed: int):
    """Postings of each set's prefix; ``salt`` deals an n-gram that may be very frequent to several groups."""
    names = ["h", "salt", "nid", "sp"]

    def run(batches):
        one, two = shared.value
        seen: set[int] = set()
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for s in shingle_sets(b.column(0), n):
                if not len(s) or (nid := node_id(s, seed)[0]) in seen:
                    continue
                seen.add(nid)
                m = len(s)
                p = min(m, m - -(-percent * m // 100) + 1 + m // EXTEND)
                i, j = _cells(s)
                count = np.minimum(one[i], two[j]).astype(np.uint64)
                first = np.argsort((count << np.uint64(32)) | (s >> np.uint64(32)), kind="stable")[:p]
                groups = count[first] // np.uint64(HOT_ROWS)
                salt = np.where(groups, 1 + np.uint64(nid & 0xFFFFFFFF) % np.maximum(groups, 1), 0).astype(np.int32)
                for o, v in zip(out, (s[first].view(np.int64), salt, np.full(p, nid, np.int64), (np.int64(m) << np.int64(32)) | np.arange(p, dtype=np.int64)), strict=True):
                    o.append(v)
                held += p
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return run


def _partnered(percent: int):
    """Of postings by n-gram and size: those of which a neighbour's size fits, each node once.

    Holds a row of the group at a time.  Salted groups are kept whole, since
    a partner may be in another one.
    """
    names, kinds = ["h", "salt", "nid", "sp"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        held = [np.empty(0, np.int64)] * 4  # the last row decided on, and the one after it
        decided = 0
        for b in chain(batches, [None]):
            rows = held if b is None else [np.r_[x, b.column(k).to_numpy()] for k, x in enumerate(held)]
            h, salt, nid, sp = rows
            new = np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (nid[1:] != nid[:-1])][: len(h)]
            rows = h, salt, nid, sp = [x[new] for x in rows]
            size = sp >> 32
            fits = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1]) & (100 * size[:-1] >= percent * size[1:])
            ok = (salt > 0) | np.r_[False, fits][: len(h)] | np.r_[fits, False][: len(h)]
            now = np.arange(decided, len(h) - (b is not None))
            now = now[ok[now]]
            yield pa.RecordBatch.from_arrays([pa.array(x[now], t) for x, t in zip(rows, kinds, strict=True)], names=names)
            held, decided = [x[-2:] for x in rows], int(len(h) > 1)

    return run


def _with_first(batches):
    """Postings by n-gram and position, each with the first of its group, the only row that is held."""
    group, a, sa = None, 0, 0
    for b in batches:
        h, salt, nid, sp = (b.column(k).to_numpy() for k in range(4))
        if not len(h):
            continue
        new = np.r_[(h[0], salt[0]) != group, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first, size = np.where(at < 0, a, nid[at]), np.where(at < 0, sa, sp[at])
        group, a, sa = (h[-1], salt[-1]), first[-1], size[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, nid, sp, first, size)], names=["h", "nid", "sp", "a", "sa"])


def _may_link(sa, sb, percent: int):
    """Length and positional filter on packed (size, position) of the smaller and the larger set."""
    size_a, size_b = F.shiftright(sa, 32), F.shiftright(sb, 32)
    left_a, left_b = size_a - sa.bitwiseAND(0xFFFFFFFF), size_b - sb.bitwiseAND(0xFFFFFFFF)
    need = percent * (size_a + size_b)
    return (100 * size_a >= percent * size_b) & ((100 + percent) * F.least(left_a, left_b) >= need)


def _suffix_filter(percent: int):
    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            ha, hb = (np.frombuffer(b"".join(t[c].to_pylist()), "<u4").reshape(-1, BINS).astype(np.int64) for c in ("ha", "hb"))
            ok = (100 + percent) * np.minimum(ha, hb).sum(1) >= percent * (ha.sum(1) + hb.sum(1))
            yield from t.select(["a", "b", "c"]).filter(pa.array(ok)).to_batches()

    return run


def _filtered(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    a = reps.select(F.col("nid").alias("a"), F.col("hist").alias("ha"))
    b = reps.select(F.col("nid").alias("b"), F.col("hist").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "c", "ha", "hb").mapInArrow(_suffix_filter(percent), "a long, b long, c long")


def _verify(n: int, percent: int):
    def run(batches):
        for b in batches:
            ends: list[list[int]] = [[], []]
            keys, last = b.column(0).to_numpy(), None
            new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
            firsts = shingle_sets(b.column(2).filter(pa.array(new)), n)
            for a, c, fresh, y in zip(keys.tolist(), b.column(1).to_pylist(), new.tolist(), shingle_sets(b.column(3), n), strict=True):
                last = next(firsts) if fresh else last
                both = len(np.intersect1d(last, y, assume_unique=True))
                if 100 * both >= percent * (len(last) + len(y) - both):
                    ends[0].append(a)
                    ends[1].append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return run


def _named(n: int, seed: int):
    """Node ids of texts, null for those without words."""

    def run(batches):
        for b in batches:
            ids = [node_id(s, seed)[0] if len(s) else None for s in shingle_sets(b["raw"], n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b["raw"]], names=["nid", "raw"])

    return run


def _renamed(n: int, seed: int):
    """As ``_named``, with the node that each text was looked up for."""

    def run(batches):
        for b in batches:
            for named in _named(n, seed)([b.select(["raw"])]):
                yield pa.RecordBatch.from_arrays([b["of"], *named.columns], names=["of", "nid", "raw"])

    return run


def _centre_salts(pairs: DataFrame) -> DataFrame | None:
    """``(a, salts)`` of the centres with more than ``HOT_PAIRS`` pairs, if there are any."""
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_PAIRS).select("a", F.ceil(F.col("c") / HOT_PAIRS).cast("int").alias("salts"))
    hot = materialize(hot, "centres")
    if not hot.limit(1).count():
        return None
    return F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot


def _links(pairs: DataFrame, reps: DataFrame, raw: DataFrame, n: int, percent: int, seed: int, unique_ids: bool) -> DataFrame:
    """Pairs whose whole texts reach the similarity; each text is shipped once per pair, and a centre's once per ``HOT_PAIRS`` of its pairs more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    named = reps.join(ends, "nid", "left_semi").select("nid", "doc_id")
    named = materialize(named, "named")
    lost = named.where("doc_id IS NULL").select("nid")
    known = F.broadcast(named) if fits(named, BROADCAST_ROWS) else named
    texts = raw.join(known, "doc_id").select("nid", "raw")
    if not unique_ids:  # one id may then stand for several texts; keep the one that was meant
        meant = texts.select(F.col("nid").alias("of"), "raw").mapInArrow(_renamed(n, seed), "of long, nid long, raw binary")
        texts = meant.where("of = nid").select("nid", "raw").dropDuplicates(["nid"])
    if lost.limit(1).count():  # sets that only rows without an id have
        own = raw.where("doc_id IS NULL").select("raw").mapInArrow(_named(n, seed), "nid long, raw binary")
        texts = texts.union(own.join(lost, "nid", "left_semi").dropDuplicates(["nid"]))
    texts = materialize(texts, "texts")
    centre, other = texts.select(F.col("nid").alias("a"), F.col("raw").alias("ra")), texts.select(F.col("nid").alias("b"), F.col("raw").alias("rb"))
    salts = _centre_salts(pairs)
    if salts is None:
        joined = pairs.join(centre, "a")
    else:
        pairs = pairs.join(salts, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)))
        centre = centre.join(salts, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1)))
        joined = pairs.drop("salts").join(centre.drop("salts"), ["a", "salt"])
    joined = joined.join(other, "b")
    return materialize(joined.select("a", "b", "ra", "rb").mapInArrow(_verify(n, percent), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``(nid, label)``: smallest node id of each connected component.

    Every round takes the smallest label among neighbours and then jumps to
    the label's own label, so paths shorten geometrically.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    labels = both.select(F.col("a").alias("nid")).distinct().withColumn("label", F.col("nid"))
    while True:
        near = both.join(labels.select(F.col("nid").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("nid")).agg(F.min("other").alias("other"))
        step = labels.join(near, "nid").select("nid", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        far = labels.select(F.col("nid").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(far, "label").select("nid", "old", F.least("label", "up").alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("nid", "label")
        if not moved:
            return labels


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` reachable over links of
    Jaccard similarity of at least ``percent`` %.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    spark = docs.sparkSession
    raw = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    for seed in count():  # the first one but for an accident of one in some billion runs over as many sets
        sets = materialize(raw.mapInArrow(_profile(n, seed), _SETS), "sets")
        shared_ids = sets.where("nid IS NOT NULL").groupBy("nid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
        if not shared_ids.limit(1).count():
            break
    members = sets.where(F.col("slice").isNull()).select("doc_id", "nid", "n", "hist")
    reps = members.where(F.col("nid").isNotNull()).groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.first("hist").alias("hist"))
    unique_ids = not members.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count()
    shared = spark.sparkContext.broadcast(_sketch(sets))

    postings = raw.select("raw").mapInArrow(_prefixes(n, percent, shared, seed), _POSTINGS)
    postings = postings.repartition("h", "salt").sortWithinPartitions("h", "salt", "sp", "nid")
    groups = materialize(postings.mapInArrow(_partnered(percent), _POSTINGS), "groups")
    size, pos = F.shiftright("sp", 32), F.col("sp").bitwiseAND(0xFFFFFFFF)
    active = groups.groupBy("nid").agg(F.count(F.lit(1)).alias("c"), F.first(size).alias("n")).where(F.col("c") >= F.floor(F.lit(1) + F.floor(F.col("n") * percent / 100) / EXTEND)).select("nid")
    active = materialize(active, "active")
    active = F.broadcast(active) if fits(active, BROADCAST_ROWS) else active
    # From here on plain prefixes do: they hold the first n-gram that two partners share.
    plain = groups.where(pos < size - F.ceil(size * percent / 100) + 1).join(active, "nid", "left_semi")
    plain = plain.select("h", "salt", "nid", "sp").repartition("h", "salt").sortWithinPartitions("h", "salt", pos, "sp", "nid")
    groups = materialize(plain.mapInArrow(_with_first, "h long, nid long, sp long, a long, sa long"), "plain")

    near = groups.where("a <> nid").where(_may_link(F.least("sa", "sp"), F.greatest("sa", "sp"), percent)).groupBy("a", F.col("nid").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    near = near.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b", "m.c")
    best = materialize(_filtered(near, reps, percent).select("a", "b"), "best")
    links = _links(best, reps, raw, n, percent, seed, unique_ids)
    labels = components(links)

    # What is left: postings of n-grams that still span several components.
    tagged = groups.select("h", "nid", "sp").join(labels, "nid", "left").select("h", "nid", "sp", F.coalesce("label", "nid").alias("label"))
    tagged = materialize(tagged, "tagged")
    spread = tagged.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / HOT_PAIRS).alias("salts")).where("x <> y").select("h", "salts")
    tagged = materialize(tagged.join(materialize(spread, "spread"), "h"), "spread_out")
    # An n-gram of many sets is dealt to groups of its own for one side, and the other side goes to each of them.
    one = tagged.select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("nid").alias("a"), F.col("sp").alias("sa"), F.col("label").alias("la"))
    two = tagged.select("h", F.pmod(F.xxhash64("nid"), F.col("salts")).alias("salt"), F.col("nid").alias("b"), F.col("sp").alias("sb"), F.col("label").alias("lb"))
    rest = one.join(two, ["h", "salt"]).where((F.col("la") != F.col("lb")) & ((F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))) & _may_link(F.col("sa"), F.col("sb"), percent))
    rest = rest.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).join(best.select("a", "b").union(best.select("b", "a")), ["a", "b"], "left_anti")
    rest = materialize(_filtered(rest, reps, percent).select("a", "b"), "rest")
    if rest.limit(1).count():
        more = _links(rest, reps, raw, n, percent, seed, unique_ids)
        if more.limit(1).count():
            labels = components(links.union(more))

    lowest = labels.join(reps.select("nid", "doc_id").join(labels, "nid").groupBy("label").agg(F.min("doc_id").alias("low")), "label").select("nid", "low")
    alone = reps.select("nid", F.col("doc_id").alias("rep"))
    found = materialize(alone.join(lowest, "nid", "left").select("nid", F.coalesce("low", "rep").alias("low")), "found")
    return members.select("doc_id", "nid", "n").join(found, "nid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the rows whose component has a smaller ``doc_id``; all columns stay.

    Of rows repeated under one ``doc_id`` with one text, one stays.  Rows
    without a ``doc_id`` stay.
    """
    found = materialize(jaccard_components(docs, n, percent), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if fits(gone, BROADCAST_ROWS) else gone
    kept = docs.join(gone, "doc_id", "left_anti")
    if found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id IS NULL"))
    return kept
