"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import oracles
from millrace.llm._work import scratch
from millrace.llm.bin_slack import pack_tightly
from millrace.llm.chat import format_preferences, pairs_from_conversations
from millrace.llm.infill import fill_in_middle_digest
from millrace.llm.jaccard import jaccard_components
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.pii import pseudonymise
from millrace.llm.quality import quality_verdicts
from millrace.llm.secrets import secret_digest
from millrace.llm.sharding import ShardStore
from millrace.llm.suffix_dedup import remove_repeats
from millrace.llm.topk import top_k
from millrace.llm.wavelet import ranked_search

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
ARRIVALS = 8
#: Of these queries over invented data only; real keys come from a secret store.
EXAMPLE_KEY = "millrace-pseudonyms-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonymise(_table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    return rows.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join(F.array_sort("pii_kinds"), ",").alias("kinds"))


def op3_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"), target_bytes=32 << 20)
    store.append_each(docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "arrival")
    store.compact(docs.schema)
    store.vacuum(keep_versions=1, grace_seconds=0)  # nobody else writes to this store
    return store.read(docs.schema).select("doc_id", "text", "lang", "source", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op6_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(pairs_from_conversations(_table(spark, sf_dir, "conversations")))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), temperature=0.5).select("doc_id", "copy", "text", "lang", "source", "n_chars")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op11_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tightly(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), capacity=2048, end_id=0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_secret_scan, op2_pii_pseudonyms, op3_tiered_shards, op4_quality_rules, op5_ngram_jaccard, op6_preference_chat, op7_exact_topk, op8_poisson_mix, op9_packing, op10_suffix_dedup, op11_min_bin_slack, op12_fill_in_middle, op13_ranked_search]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
