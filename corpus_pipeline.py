"""From raw documents to packed training sequences, a stage at a time.

Every stage takes what its predecessor kept and returns the columns of
``documents``, all but the last, which returns packed pieces.  ``run`` writes
each stage's result as Parquet to the shared folder and hands it on.

All stages take whole texts, however long, give no rows for an empty table,
and read the columns of ``documents`` only, so further ones, whatever their
names, neither clash nor pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._work import materialize
from millrace.llm.jaccard import keep_one_per_component
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.pii import pseudonymise
from millrace.llm.quality import keep_good
from millrace.llm.queries import EXAMPLE_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are too frequent on their host.

    Null and empty texts have no words and go; a null source is a host of its
    own, apart from the empty one; repeated rows are judged alike and all stay or all go.
    """
    return keep_good(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows with a null id, and texts without words, stay; of equal rows under
    one id, one stays.
    """
    return keep_one_per_component(docs.select(COLUMNS), n=5, percent=75)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal numbers, dates and addresses under pseudonyms; null and empty texts, and repeated rows, stay as they are."""
    return pseudonymise(docs.select(COLUMNS), EXAMPLE_KEY).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come in proportion to the root of their size, shuffled.

    A null source is a source of its own, apart from the empty one; a row without an id draws by its
    text; repeated rows draw alike.
    """
    return mix_sources(docs.select(COLUMNS), temperature=0.5).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their place in sequences of 4096; null and empty texts are just the end id, repeated rows are packed each."""
    return pack_documents(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Keyed permutations and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
