"""What building and searching a stored index writes, against the size of its texts."""

import os
import random

from millrace.operators import retrieve
from millrace.operators.inverted import StoredIndex


def shuffled(spark):
    """Bytes of all shuffles so far."""
    known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))


def stored(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet"))


def words(rng, n):
    vocab = ["".join(rng.choices("bcdfglmnrst", k=2)) + rng.choice("aeiou") + str(i) for i in range(n)]
    return lambda k: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(n)], k=k))


def test_disk_is_a_small_multiple_of_the_texts(spark, tmp_path):
    some = words(random.Random(5), 20_000)
    spark.createDataFrame([(i, some(400)) for i in range(2000)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents"))
    size, before = stored(tmp_path / "documents"), shuffled(spark)
    index = StoredIndex.build(spark.read.parquet(str(tmp_path / "documents")), str(tmp_path / "index"))
    built = shuffled(spark)
    assert built - before < 2 * size
    assert stored(tmp_path / "index") < 2 * size
    index.search(spark.createDataFrame([(i, some(30)) for i in range(40)], "query_id long, text string"), 3).collect()
    assert shuffled(spark) - built < 3 * size


def test_ids_of_any_sign_repeated_and_far_apart(spark, tmp_path):
    rng = random.Random(6)
    some = words(rng, 200)
    ids = [-5, -1, 0, 63, 64, 64, 2**40, -(2**40)] + [rng.randint(-300, 300) for _ in range(200)]
    docs = spark.createDataFrame([(i, some(rng.randint(0, 30))) for i in ids], "doc_id long, text string")
    queries = spark.createDataFrame([(i, some(5)) for i in range(6)], "query_id long, text string")
    got = StoredIndex.build(docs, str(tmp_path / "index"), docs_per_block=8).search(queries, 4).collect()
    want = retrieve.bm25(queries, retrieve.postings(docs), 4, stats=retrieve.lengths(docs)).collect()
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in rows)
    assert key(got) == key(want) != []
