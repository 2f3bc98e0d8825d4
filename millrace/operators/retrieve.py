"""Retrieval and correlation: exact dense search, term search, fan-out and fan-in."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.io import shared_folder

#: Queries that are scored in one pass over the corpus.
QUERY_BLOCK = 4096

#: Terms of all queries of a term search are broadcast up to this many.
BROADCAST_TERMS = 200_000

#: Distinct n-grams of evidence are broadcast up to this many.
BROADCAST_GRAMS = 200_000


def fetch(corpus: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents at ``(request, ids)`` in the order asked, repeats included."""
    flat = wanted.select("request", F.posexplode("ids").alias("pos", id_col))
    return flat.join(corpus, id_col)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Corpus rows that are scored against a block of queries at once.
CORPUS_ROWS = 1024


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vector of doubles)`` of the rows that take part in a search."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias(id_col), v.alias(vec_col)).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & whole)


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """A row per vector; those of fewer components than ``width`` (by default the most) end in zeros, others are cut."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < width], at[at < width]] = vectors.flatten().to_numpy()[at < width]
    return out


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` best, highest first, then by id."""
    order = np.lexsort((ids, -scores, row))
    first = np.r_[0, np.flatnonzero(np.diff(row[order])) + 1] if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _scored(shared, k: int):
    """The ``k`` best vectors of a task for each query of a block."""

    def run(batches):
        numbers, names, q = shared.value
        row, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(q), -np.inf)
        for b in batches:
            for first in range(0, b.num_rows, CORPUS_ROWS):
                some = b.slice(first, CORPUS_ROWS)
                p = _matrix(some.column(1), q.shape[1])
                s = np.zeros((len(q), len(p)))
                # Components are added in order, as a fold does, so that equal vectors get equal scores wherever they are.
                for d in range(q.shape[1]):
                    s += q[:, d : d + 1] * p[:, d]
                floor = np.maximum(least, np.partition(s, -k, axis=1)[:, -k]) if len(p) > k else least
                i, j = np.nonzero(s >= floor[:, None])
                row, ids, scores = np.r_[row, i], np.r_[ids, some.column(0).to_numpy()[j]], np.r_[scores, s[i, j]]
                keep = _best(row, ids, scores, k)
                row, ids, scores = row[keep], ids[keep], scores[keep]
                full = np.bincount(row, minlength=len(q)) == k
                last = np.r_[row[1:] != row[:-1], True][: len(row)]
                least[full] = scores[last & full[row]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers[row], names[row], ids, scores)], names=["no", "query_id", "vec_id", "score"])

    return run


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``k`` best inner products of each query; ties to the smaller id.

    ``queries (query_id, q)``, ``corpus (vec_id, v)``.  Queries are taken in
    blocks of ``QUERY_BLOCK``, and each block is scored against batches of the
    corpus where they are, without a shuffle of either: a task holds the ``k``
    best so far of each query of the block.  All blocks go the same way.

    Rows without an id or a vector, or with a component that is null or not
    finite, take no part; vectors of different dimension are compared as if
    padded with zeros; repeated rows each count and each ask.
    """
    spark = corpus.sparkSession
    v = _valid(corpus, "vec_id", "v")
    rows, found, before = _valid(queries, "query_id", "q").toLocalIterator(), None, 0
    block = list(islice(rows, QUERY_BLOCK))
    while block:
        shared = spark.sparkContext.broadcast((before + np.arange(len(block)), np.array([r[0] for r in block], np.int64), _matrix(pa.array([r[1] for r in block], pa.list_(pa.float64())))))
        some, before = v.mapInArrow(_scored(shared, k), "no long, query_id long, vec_id long, score double"), before + len(block)
        block = list(islice(rows, QUERY_BLOCK))
        if block or found is not None:  # of many blocks the driver holds one at a time
            path = shared_folder(spark, "dense")
            some.write.parquet(path)
            shared.destroy()
            some = spark.read.schema(some.schema).parquet(path)
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "no long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("no")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, term, tf, dl)``: term counts and document lengths, counted inside each document by runs of its sorted words."""

    def runs(ws):
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
        return T.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ws, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - i).cast("long").alias("tf"), F.size(ws).alias("dl"))))

    terms = T.let(F.sort_array(T.tokens(F.col(text_col))), runs)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(terms).alias("x")).select("doc_id", "x.term", "x.tf", "x.dl")


def lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: number and mean length of the documents that have terms, from one scan."""
    return docs.select(F.size(T.tokens(F.col(text_col))).alias("dl")).where("dl > 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(queries: DataFrame, index: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, stats: DataFrame | None = None) -> DataFrame:
    """``k`` best documents of each query by BM25; fewer hits return all.  ``queries (query_id, text)``.

    ``stats`` are the ``lengths`` of the indexed documents; without them they
    are counted from the index, which shuffles it once more.

    Postings of query terms are dealt by document, so that a document's scores
    are summed where it is, and each task ranks before the rest is shuffled.
    """
    if stats is None:
        stats = index.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    terms = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    hit = index.join(small(terms.select("term").distinct()), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query_id", "term", (idf * F.col("qtf")).alias("w"), "avgdl")
    rows = hit.repartition("doc_id").join(small(weights), "term")
    part = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def ngram_overlap(docs: DataFrame, evidence: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, overlap)``: share of each document's n-grams, repeats counted, that any evidence text has; 0 without any.

    N-grams are exploded and looked up by hash, so the work grows with the
    length of the texts; counts are summed where a document is.
    """
    grams = lambda c: T.let(T.tokens(F.col(c)), lambda ws: T.ngrams(ws, n))
    known = evidence.select(F.explode(grams(text_col)).alias("g")).distinct().withColumn("hit", F.lit(1))
    if known.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    rows = docs.select(id_col, F.explode_outer(grams(text_col)).alias("g")).join(known, "g", "left")
    share = F.count("hit") / F.greatest(F.count("g"), F.lit(1))
    return rows.groupBy(id_col).agg(share.alias("overlap"))


def fan_out(tasks: DataFrame) -> DataFrame:
    """A row per query of ``(task_id, queries)``."""
    return tasks.select("task_id", F.posexplode("queries").alias("pos", "query"))


def fan_in(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers ``(task_id, pos, answer)`` back in order; a task with any missing is an error row."""
    got = answers.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]).alias("answers"))
    rows = tasks.join(got, "task_id", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
    return rows.withColumn("error", F.when(F.size("answers") != F.size("queries"), F.lit("count mismatch")))


def grades_to_items(items: DataFrame, grades: DataFrame) -> DataFrame:
    """Flat verdicts ``(item_id, rubric_idx, grade)`` joined to each item's rubrics; missing ones stay null."""
    slots = items.select("item_id", "n_rubrics", F.explode(F.sequence(F.lit(0), F.col("n_rubrics") - 1)).alias("rubric_idx"))
    return slots.join(grades, ["item_id", "rubric_idx"], "left")


def regroup(tasks: DataFrame, k: int) -> DataFrame:
    """``k`` solver attempts of each task as rows."""
    return tasks.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def only(items: DataFrame, handled: DataFrame, key: str) -> DataFrame:
    return items.join(handled.select(key), key, "left_semi")


def without(items: DataFrame, handled: DataFrame, key: str) -> DataFrame:
    return items.join(handled.select(key), key, "left_anti")


def search_status(n_results: Column, error: Column) -> Column:
    """Outcome of a search request."""
    return F.when(error == "api", "api_error").when(error.isNotNull(), "processing_error").when(n_results == 0, "no_results").otherwise("success")
