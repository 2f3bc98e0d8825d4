"""Ranked lexical search over dual-sorted wavelet trees.

Documents are cut into shards of about ``SHARD_POSTINGS`` postings.  A shard
holds the postings of all its terms in one sequence, term by term, each list
from the highest impact to the lowest.  A wavelet tree over the documents'
local numbers gives the same sequence a second order: at every node, which is
an interval of documents, a term has one range, still in order of impact, so
that the first element of the range bounds the term's share of any score below
that node.  Leaves are blocks of ``LEAF_DOCS`` documents.

A search keeps the nodes of a shard in a heap by the sum of those bounds, takes
the best, intersects the ranges of the item's terms with both children, and
scores whole leaves exactly; it ends when the best bound cannot enter the
result.  Results that a task has found in earlier shards count as well.

Scores are integers: impacts are 64-bit quotients, and sums stay below 2**53.
Terms are compared as strings.

Null and empty texts have no terms, so they neither count as documents nor
are found, and items without terms get no rows.  Documents without an id
take part and come after equal scores with one (inside, the greatest 64-bit
number stands for no id); rows repeated under one id
each count and are each ranked, as is every row of the items.  Empty tables
give no rows.  A very long text is one document of a shard, read in one piece.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._work import flat_bytes, materialize, slices, text_rows

SHARD_POSTINGS = 1 << 19
LEAF_BITS = 8
#: Bytes of text whose terms are counted together.
SLICE = 1 << 21
#: Items that are searched in one pass over the index.
ITEM_BLOCK = 4096
#: Up to so many distinct terms of the items are broadcast, and others left out of the index; beyond it all terms are indexed.
MAX_TERMS = 500_000
#: Groups in which results of an item from many tasks first meet.
SALTS = 64
#: Writer options for rows of many MB: look at the size of a row group after each.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}
_LAST = np.iinfo(np.int64).max

_TERM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of all texts one after the other, and how many each text has."""
    raw, at = flat_bytes(texts)
    inside = _TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[at[:-1][at[:-1] < at[1:]]] = inside[at[:-1][at[:-1] < at[1:]]]
    kept = np.cumsum(inside) - inside  # place of each byte among those kept
    begin = np.flatnonzero(first)
    offsets = np.r_[kept[begin], np.count_nonzero(inside)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    return terms.dictionary_encode(), np.diff(np.searchsorted(begin, at))


_COUNTS = "doc_id long, n long, terms array<string>, counts array<int>"


def _count(wanted):
    def run(batches):
        only = pa.array(wanted.value, pa.string()) if wanted else None
        for b in batches:
            for first, size in slices(b.column(1), SLICE):
                coded, n = terms_of(b.column(1).slice(first, size))
                names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(size), n)
                if only is not None:
                    keep = pc.is_in(names, value_set=only).to_numpy(zero_copy_only=False)[code]
                    doc, code = doc[keep], code[keep]
                key, tf = np.unique(doc * max(1, len(names)) + code, return_counts=True)
                doc, code = np.divmod(key, max(1, len(names)))
                offsets = pa.array(np.searchsorted(doc, np.arange(size + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, names.take(pa.array(code))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, size), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each occurrence count is worth before the term's weight."""
    m = 50 + 50 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard:
    """Postings of some documents, and the wavelet tree over them."""

    COLUMNS = {"ids": np.int64, "starts": np.int64, "below": np.int64, "bits": np.uint64, "ones": np.uint32, "worth": np.uint32, "local": np.uint32}
    SCHEMA = "terms array<string>, ids binary, starts binary, below binary, bits binary, ones binary, worth binary, local binary"

    def __init__(self, terms: pa.StringArray, **arrays: np.ndarray):
        self.terms = terms
        for name in self.COLUMNS:
            setattr(self, name, arrays[name])
        self.docs = len(self.ids)
        self.depth = max(0, (self.docs - 1).bit_length() - LEAF_BITS)
        size = int(self.starts[-1])
        self.bits, self.ones = (x.reshape(self.depth, size // 64 + 1) for x in (self.bits, self.ones))
        self.worth = self.worth.reshape(self.depth + 1, size)

    @classmethod
    def build(cls, ids: np.ndarray, names: pa.StringArray, term: np.ndarray, local: np.ndarray, worth: np.ndarray) -> Shard:
        """From postings in any order, as numbers of their term and document."""
        order = np.lexsort((local, -worth, term))
        term, local, worth = term[order], local[order], worth[order]
        size, depth = len(order), max(0, (len(ids) - 1).bit_length() - LEAF_BITS)
        bits, ones = np.zeros((depth, size // 64 + 1), np.uint64), np.zeros((depth, size // 64 + 1), np.uint32)
        worths = np.empty((depth + 1, size), np.uint32)
        for level in range(depth + 1):
            # Nodes of a level in order of their documents, each with its elements in the order of the root.
            shift = LEAF_BITS + depth - level
            at = np.argsort(local >> shift, kind="stable")
            worths[level] = worth[at]
            if level < depth:
                padded = np.zeros((size // 64 + 1) * 64, np.uint8)
                padded[:size] = local[at] >> (shift - 1) & 1
                bits[level] = np.packbits(padded, bitorder="little").view("<u8")
                count = np.bitwise_count(bits[level]).astype(np.uint32)
                ones[level] = np.cumsum(count) - count
        below = np.r_[0, np.cumsum(np.bincount(local, minlength=len(ids)))]
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        return cls(names, ids=ids, starts=starts, below=below, bits=bits.ravel(), ones=ones.ravel(), worth=worths.ravel(), local=local[at].astype(np.uint32))

    def row(self) -> list[pa.Array]:
        whole = pa.ListArray.from_arrays(pa.array([0, len(self.terms)], pa.int32()), self.terms)
        return [whole, *[pa.array([np.ascontiguousarray(getattr(self, k), t).tobytes()], pa.binary()) for k, t in self.COLUMNS.items()]]

    @classmethod
    def read(cls, batch: pa.RecordBatch, k: int) -> Shard:
        terms = batch.column("terms").slice(k, 1).flatten()
        return cls(terms, **{c: np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in cls.COLUMNS.items()})

    def rank(self, level: int, x: np.ndarray) -> np.ndarray:
        """Ones among the first ``x`` bits of a level."""
        word = x >> 6
        part = self.bits[level, word] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[level, word] + np.bitwise_count(part).astype(np.int64)

    def children(self, level: int, node: int, s: np.ndarray, e: np.ndarray):
        """``(node, s, e)`` of both children of a node with ranges ``[s, e)`` of the terms."""
        shift = LEAF_BITS + self.depth - level - 1
        begin, middle = (int(self.below[min(x << shift, self.docs)]) for x in (2 * node, 2 * node + 1))
        one = self.rank(level, np.r_[begin, s, e])
        one -= one[0]
        one_s, one_e = one[1 : len(s) + 1], one[len(s) + 1 :]
        yield 2 * node, s - one_s, e - one_e
        yield 2 * node + 1, middle + one_s, middle + one_e

    def leaf(self, node: int, s: np.ndarray, e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local numbers and scores of a leaf's documents with any of the terms."""
        size = e - s
        stop = np.cumsum(size)
        at = np.repeat(s - stop + size, size) + np.arange(stop[-1])
        base = node << LEAF_BITS
        score = np.bincount(self.local[at] - base, np.repeat(w, size) * self.worth[self.depth, at].astype(np.float64)).astype(np.int64)
        found = np.flatnonzero(score)
        return found + base, score[found]

    def search(self, term: np.ndarray, w: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores and ids, highest first, then by id) with the shard's documents merged in, ``k`` at most."""
        s, e = self.starts[term], self.starts[term + 1]
        heap = [(-int((w * self.worth[0, s]).sum()), 0, 0, s, e, w)] if len(term) else []
        scores, ids = best
        while heap:
            bound, node, level, s, e, w = heapq.heappop(heap)
            begin = node << (LEAF_BITS + self.depth - level)
            if len(scores) == k and (-bound, -int(self.ids[begin])) <= (int(scores[-1]), -int(ids[-1])):
                if -bound < scores[-1]:
                    break
                continue
            if level == self.depth:
                local, score = self.leaf(node, s, e, w)
                scores, ids = np.r_[scores, score], np.r_[ids, self.ids[local]]
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                continue
            for child, a, b in self.children(level, node, s, e):
                some = a < b
                if some.any():
                    a, b, v = a[some], b[some], w[some]
                    heapq.heappush(heap, (-int((v * self.worth[level + 1, a]).sum()), child, level + 1, a, b, v))
        return scores, ids


def _build(documents: int, total: int):
    """Shards of runs of ``(doc_id, n, terms, counts)``; documents without terms are in none."""

    def shard(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("doc_id").combine_chunks()  # nulls last
        lists, counts = rows["terms"].chunk(0), rows["counts"].chunk(0)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        order = pc.sort_indices(names).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        size = pc.list_value_length(lists).to_numpy()
        local = np.repeat(np.arange(len(size)), size)
        n = np.repeat(rows["n"].to_numpy(), size)
        worth = impacts(counts.flatten().to_numpy().astype(np.int64), n, documents, total)
        ids = pc.fill_null(rows["doc_id"], int(_LAST)).to_numpy()
        made = Shard.build(ids, names.take(pa.array(order)), number[coded.indices.to_numpy()], local, worth)
        return pa.RecordBatch.from_arrays(made.row(), names=["terms", *Shard.COLUMNS])

    def run(batches):
        held, postings = [], 0
        for b in batches:
            size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            b, size = b.filter(pa.array(size > 0)), size[size > 0]
            while b.num_rows:
                take = max(1, int(np.searchsorted(np.cumsum(size), SHARD_POSTINGS - postings, side="right")))
                held.append(b.slice(0, take))
                postings += int(size[:take].sum())
                b, size = b.slice(take), size[take:]
                if postings >= SHARD_POSTINGS or b.num_rows:
                    yield shard(pa.Table.from_batches(held))
                    held, postings = [], 0
        if held:
            yield shard(pa.Table.from_batches(held))

    return run


class LexicalIndex:
    """Shards of wavelet trees with the corpus-wide counts that scores need; all but two numbers are tables."""

    def __init__(self, shards: DataFrame, frequencies: DataFrame, documents: int, total: int):
        self.shards, self.frequencies, self.documents, self.total = shards, frequencies, documents, total

    @classmethod
    def build(cls, docs: DataFrame, wanted: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        """Index of whole texts; postings of terms not ``wanted`` are left out, which changes no score of wanted ones."""
        spark = docs.sparkSession
        only = spark.sparkContext.broadcast(wanted) if wanted is not None else None
        raw = text_rows(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
        counts = materialize(raw.mapInArrow(_count(only), _COUNTS), "term_counts")
        documents, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = materialize(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        shards = materialize(counts.mapInArrow(_build(documents, max(1, total)), Shard.SCHEMA), "shards", **LONG_ROWS)
        return cls(shards, frequencies, documents, total)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def search(self, items: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item, equal scores by ascending id."""
        spark = items.sparkSession
        asked = _items(items, id_col, text_col).withColumn("no", F.monotonically_increasing_id()).select("no", "item_id", F.explode("terms").alias("term"))
        asked = materialize(asked.join(self.frequencies, "term").groupBy("no", "item_id").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "asked")
        rows, found, before = asked.toLocalIterator(), None, 0
        while block := list(islice(rows, ITEM_BLOCK)):
            terms = sorted({t["term"] for r in block for t in r["terms"]})
            number = {t: i for i, t in enumerate(terms)}
            each = [(before + i, r["item_id"], np.array([number[t["term"]] for t in r["terms"]]), np.array([self.weight(t["df"]) for t in r["terms"]], np.int64)) for i, r in enumerate(block)]
            some = self.shards.mapInArrow(_search(spark.sparkContext.broadcast((terms, each)), k), "no long, item_id long, doc_id long, score long")
            some = materialize(some, "found")
            found, before = some if found is None else found.union(some), before + len(block)
        if found is None:
            found = spark.createDataFrame([], "no long, item_id long, doc_id long, score long")
        for key in (["no", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["no"]):
            order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return found.select("item_id", "rank", "doc_id", "score")


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = text_rows(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return raw.mapInArrow(_count(None), _COUNTS).select(F.col("doc_id").alias("item_id"), "terms")


def _search(shared, k: int):
    def run(batches):
        terms, items = shared.value
        terms = pa.array(terms, pa.string())
        best = {no: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for no, *_ in items}
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard.read(b, i)
                there = pc.fill_null(pc.index_in(terms, value_set=shard.terms), -1).to_numpy()
                for no, _, term, w in items:
                    at = there[term]
                    best[no] = shard.search(at[at >= 0], w[at >= 0], k, best[no])
        for no, item, *_ in items:
            scores, ids = best[no]
            if size := len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([no] * size, pa.int64()), pa.array([item] * size, pa.int64()), pa.array(ids, mask=ids == _LAST), pa.array(scores)], names=["no", "item_id", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for all items over all documents."""
    terms = _items(items, "item_id", "text").select(F.explode("terms").alias("term")).distinct().limit(MAX_TERMS + 1).collect()
    wanted = [r["term"] for r in terms] if len(terms) <= MAX_TERMS else None
    return LexicalIndex.build(docs, wanted).search(items, k)
