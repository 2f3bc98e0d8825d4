"""A stored inverted index in blocks, and term search that skips blocks.

A block holds the postings of one term in one range of documents, with the
greatest impact among them.  A search first reads only these heads: for each
query and range, the sum of weighted greatest impacts bounds every score
there.  The most promising ranges are scored, which gives each query a bound
on its ``k``-th best score, and of the others only those that can reach it.

Texts are dealt by range of documents, not their postings by term: a text is
far smaller than its postings, a frequent term is no hot group, and a task
writes the blocks of its ranges where they are made.  Where a batch of texts
ends inside a range, a term has two blocks there, and both count towards the
bound, which stays one.  Files are sorted by
bucket of the term, so a search skips the pages of buckets that have none of
its terms.
"""

from __future__ import annotations

import contextlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.retrieve import BROADCAST_TERMS, lengths
from millrace.sources.io import shared_folder

BUCKETS = 64
#: Ranges of each query that are scored first.
SEEDS = 2
#: What rounding of a bound may be off by.
SLACK = 1e-8
_HEADS = "term string, chunk long, n long, top double"
_BLOCKS = _HEADS + ", docs array<bigint>, parts array<double>"

_WHILE_WRITING = {
    # Shuffle files go when the table that they were for is written.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Long texts make large batches: they are bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


@contextlib.contextmanager
def _bounded(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(df: DataFrame, path: str) -> DataFrame:
    with _bounded(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(k1: float, b: float, avgdl: float):
    """Blocks of the documents of a batch ``(id, chunk, words)``."""

    def run(batches):
        for rows in batches:
            ids, words = rows.column(0), rows.column(2)
            dl = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = rows.column(1).dictionary_encode("encode").indices.to_numpy()
            terms = words.flatten().dictionary_encode()
            if not len(terms):
                continue
            order = np.argsort(chunk, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            # A term's documents are next to each other, range by range.
            found, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(place, dl), return_counts=True)
            term, doc = found // len(dl), order[found % len(dl)]
            part = tf / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[doc[1:]] != chunk[doc[:-1]])])
            ends = pa.array(np.r_[first, len(doc)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    terms.dictionary.take(pa.array(term[first])),
                    rows.column(1).take(pa.array(doc[first])),
                    pa.array(np.diff(np.r_[first, len(doc)]), pa.int64()),
                    pa.array(np.maximum.reduceat(part, first)),
                    pa.ListArray.from_arrays(ends, ids.take(pa.array(doc))),
                    pa.ListArray.from_arrays(ends, pa.array(part)),
                ],
                names=["term", "chunk", "n", "top", "docs", "parts"],
            )

    return run


class StoredIndex:
    """An index in ``path``: blocks in order of the term's bucket, document frequencies, and one row of corpus counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str, k1: float = 0.9, b: float = 0.4, docs_per_block: int = 64, id_col: str = "doc_id", text_col: str = "text") -> StoredIndex:
        """The index of all documents, written once; ids that are close to each other share blocks."""
        avgdl = _write(lengths(docs, text_col), f"{path}/stats").first()["avgdl"]
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.floor(F.col(id_col) / docs_per_block).alias("chunk"), F.col(text_col).alias("text"))
        rows = rows.repartition("chunk").sortWithinPartitions("chunk").select("id", "chunk", T.tokens(F.col("text")).alias("words"))
        blocks = rows.mapInArrow(_blocks(k1, b, avgdl or 1.0), _BLOCKS).withColumn("bucket", F.pmod(F.hash("term"), F.lit(BUCKETS)))
        _write(blocks.sortWithinPartitions("bucket", "term", "chunk"), f"{path}/blocks")
        out = cls(docs.sparkSession, path)
        _write(out.blocks().groupBy("term").agg(F.sum("n").alias("df")), f"{path}/terms")
        return out

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS + ", bucket int").parquet(f"{self.path}/blocks")

    def _saved(self, df: DataFrame) -> DataFrame:
        return _write(df, shared_folder(self.spark, "search"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, w)``: what a term's impact counts for each query."""
        asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        stats = self.spark.read.schema("n_docs long, avgdl double").parquet(f"{self.path}/stats")
        terms = self.spark.read.schema("term string, df long").parquet(f"{self.path}/terms")
        idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(terms, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (idf * F.col("qtf")).alias("w"))

    def _asked_blocks(self, w: DataFrame) -> DataFrame:
        """Blocks in the buckets of the queries' terms, of which there are ``BUCKETS`` at most."""
        buckets = [r[0] for r in w.select(F.pmod(F.hash("term"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
        # Equalities, as a long list is compared with a page's bounds by its ends only.
        return self.blocks().where(reduce(lambda x, y: x | y, [F.col("bucket") == i for i in sorted(buckets)], F.lit(False))).drop("bucket")

    def _scored(self, pairs: DataFrame, w: DataFrame, blocks: DataFrame) -> DataFrame:
        """Scores of all documents in the ranges ``pairs (query_id, chunk)``, summed where a range's blocks are."""
        asked = pairs.groupBy("chunk").agg(F.collect_list("query_id").alias("asked"))
        known = blocks.select("term", "chunk", "docs", "parts").join(w.select("term").distinct(), "term", "left_semi")
        hits = known.repartition("chunk").join(asked, "chunk").join(w, "term").where(F.array_contains("asked", F.col("query_id")))
        hits = hits.select("chunk", "query_id", "w", "parts", F.posexplode("docs").alias("at", "doc_id"))
        scores = hits.groupBy("chunk", "query_id", "doc_id").agg(F.sum(F.col("w") * F.get("parts", F.col("at"))).alias("score"))
        return scores.select("query_id", "doc_id", "score")

    def search(self, queries: DataFrame, k: int, counts: dict | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score)``: the ``k`` best by BM25, ties to the smaller id; ``queries (query_id, text)``.

        ``counts`` receives how many blocks the queries' terms have in all
        ranges, and how many of them were read.
        """
        w = self._saved(self.weights(queries))
        w = F.broadcast(w) if w.count() <= BROADCAST_TERMS else w
        blocks = self._asked_blocks(w)
        heads = self._saved(blocks.select("term", "chunk", "top").join(w, "term").groupBy("query_id", "chunk").agg(F.sum(F.col("w") * F.col("top")).alias("bound"), F.count(F.lit(1)).alias("blocks")))
        best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "chunk")
        seeds = self._saved(heads.withColumn("r", F.row_number().over(best)).where(F.col("r") <= SEEDS).drop("r"))
        first = self._saved(self._scored(seeds, w, blocks))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        least = first.withColumn("r", place).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        rest = heads.join(seeds.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
        rest = self._saved(rest.select("query_id", "chunk", "blocks"))
        if counts is not None:
            total = lambda df: df.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
            counts |= {"all": total(heads), "read": reduce(lambda a, b: a + b, map(total, (seeds, rest)))}
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
        return first.unionByName(self._scored(rest, w, blocks)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
