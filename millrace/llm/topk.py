"""Exact top-k by inner product with norm-bucketed pruning.

Vectors are sorted by length and cut into buckets.  Queries are scored
against the longest buckets first, which gives every query a lower bound on
its k-th best score.  For each other bucket the bound over (query length x
bucket's greatest length) is the local cosine threshold: above 1 the whole
bucket is skipped; where it is high, only vectors whose coordinate at the
query's largest one lies in the feasible interval are scored (coordinate
pruning), else those long enough (length pruning).  Scores of what is left
are exact integers.

Buckets are grouped by a coarse class of their greatest length, and query
blocks meet groups by an equi-join: a block is sent only to the classes long
enough for one of its queries, and a task holds one block and one bucket at a
time.  Rows with a null id, a null vector or a component that is null or not
finite take no part; repeated rows, under one id or several, each count, and
each asks if its id is one of the queries'; vectors of different dimension are
compared as if padded with zeros.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._work import materialize

BUCKET_ROWS = 2048
QUERY_ROWS = 512
#: Buckets that give the first bounds, and buckets of one join group.
SEED_BUCKETS = 2
GROUP_BUCKETS = 8
COORDINATE_FROM = 0.9
_BLOCK = "no long, dim int, ids binary, rows binary, mat binary, most double, least double"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(vec_id, v, row, len)`` with ``v = floor(scale * x)`` and a number of its own, for each valid row."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)))


def _blocks(rows_a_block: int):
    def packed(no: int, rows: list) -> tuple:
        dim = max((len(v) for _, v, *_ in rows), default=0)
        mat = np.zeros((len(rows), dim), "<i8")
        for m, (_, v, *_) in zip(mat, rows, strict=True):
            m[: len(v)] = v
        lens = [r[2] for r in rows]
        return no, dim, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[3] for r in rows], "<i8").tobytes(), mat.tobytes(), max(lens), min(lens)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["no", "dim", "ids", "rows", "mat", "most", "least"])

    def run(batches):
        from pyspark import TaskContext

        base, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            while len(held) >= rows_a_block:
                yield batch([packed(base, held[:rows_a_block])])
                base, held = base + 1, held[rows_a_block:]
        if held:
            yield batch([packed(base, held)])

    return run


def _product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    dim = min(q.shape[1], p.shape[1])
    q, p = q[:, :dim], p[:, :dim]
    if dim and float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * dim < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def _best(k: int, q_rows, p_rows, p_ids, scores, floor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of the k best of each row over its floor, ties to the smaller id, the query's own row left out."""
    low = np.iinfo(np.int64).min
    scores = np.where(q_rows[:, None] == p_rows[None, :], low, scores)
    if scores.shape[1] > k:
        floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
    row, col = np.nonzero((scores >= floor[:, None]) & (scores > low))
    s, ids = scores[row, col], p_ids[col]
    order = np.lexsort((ids, -s, row))
    row, s, ids = row[order], s[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return q_rows[row[place < k]], ids[place < k], s[place < k]


def _search(k: int):
    low = np.iinfo(np.int64).min

    def run(batches):
        for b in batches:
            for q_dim, q_raw, q_mat, q_floor, dim, ids, rows, mat, most in zip(*(b.column(c).to_pylist() for c in range(9)), strict=True):
                q_rows, p_ids, p_rows = (np.frombuffer(x, "<i8") for x in (q_raw, ids, rows))
                q, p = np.frombuffer(q_mat, "<i8").reshape(len(q_rows), q_dim), np.frombuffer(mat, "<i8").reshape(len(p_ids), dim)
                floor = np.frombuffer(q_floor, "<i8") if q_floor is not None else np.full(len(q_rows), low)
                q_len, p_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((p.astype(float) ** 2).sum(1))
                bound = np.where(floor > 0, floor.astype(float), -math.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    local = np.where(floor > 0, bound / (q_len * most) - 1e-9, -1.0)
                local = np.nan_to_num(local, nan=2.0, posinf=2.0)
                found = []
                wide = np.flatnonzero((local <= 1) & (local < COORDINATE_FROM))
                if len(wide):  # length pruning: the bucket is sorted, longest first
                    need = float(np.where(floor[wide] > 0, bound[wide] / np.maximum(q_len[wide], 1e-300), 0).min())
                    n = int((p_len >= need * (1 - 1e-9)).sum()) if need > 0 else len(p_ids)
                    if n:
                        found.append(_best(k, q_rows[wide], p_rows[:n], p_ids[:n], _product(q[wide], p[:n]), floor[wide]))
                for i in np.flatnonzero((local <= 1) & (local >= COORDINATE_FROM)):
                    f = int(np.abs(q[i]).argmax())
                    cos, x = local[i], q[i, f] / q_len[i]
                    y = p[:, f] / np.maximum(p_len, 1e-300) if f < dim else np.zeros(len(p_ids))
                    half = math.sqrt(max(0.0, (1 - cos * cos) * (1 - x * x))) + 1e-9
                    # Within the angle of the threshold of the query, so within these values there.
                    upper = 1.0 if x >= cos else x * cos + half
                    lower = -1.0 if -x >= cos else x * cos - half
                    near = np.flatnonzero((y >= lower - 1e-9) & (y <= upper + 1e-9))
                    if len(near):
                        found.append(_best(k, q_rows[i : i + 1], p_rows[near], p_ids[near], _product(q[i : i + 1], p[near]), floor[i : i + 1]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[j] for x in found])) for j in range(3)], names=["query", "vec_id", "score"])

    return run


def _length_class(x):
    """Lengths on a scale of eight steps for each doubling, of which there are 17,000 at most."""
    return F.floor(F.log2(F.greatest(x, F.lit(1e-300))) * 8).cast("int")


def _with_floors(batches):
    """Query blocks with each member's bound, the least number where none is known yet, and the least length that a vector needs for any of them."""
    low = np.iinfo(np.int64).min
    for b in batches:
        t = pa.Table.from_batches([b])
        out, needs = [], []
        for dim, rows, mat, bounds in zip(*(t[c].to_pylist() for c in ("q_dim", "q_rows", "q_mat", "bounds")), strict=True):
            known = {x["query"]: x["floor"] for x in bounds or []}
            floor = np.array([known.get(i, low) for i in np.frombuffer(rows, "<i8").tolist()], "<i8")
            length = np.sqrt((np.frombuffer(mat, "<i8").reshape(len(floor), dim).astype(float) ** 2).sum(1))
            out.append(floor.tobytes())
            needs.append(float(np.where(floor > 0, floor / np.maximum(length, 1e-300), 0.0).min()))
        yield from t.drop_columns(["bounds"]).append_column("floor", pa.array(out, pa.binary())).append_column("need", pa.array(needs, pa.float64())).to_batches()


def _targets(q: DataFrame, classes: DataFrame) -> DataFrame:
    """Query blocks once for each group of buckets that may hold a vector long enough; ``classes (c, subs)`` is the bounded table of length classes."""
    reach = q.withColumn("need", _length_class(F.col("need") * (1 - 1e-9)))
    return reach.join(F.broadcast(classes), F.col("c") >= F.col("need")).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1))).drop("need", "subs")


def _members(batches):
    """A row for each query of a block."""
    for b in batches:
        for no, rows, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(rows, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), no, np.int64)), pa.array(x), pa.array(np.frombuffer(ids, "<i8"))], names=["q_no", "query", "query_id"])


_FOUND = "query long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best of each row whose id is divisible by ``every``."""
    rows = materialize(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    n = rows.count()
    parts = max(1, -(-n // (8 * BUCKET_ROWS)))
    ordered = rows.repartitionByRange(parts, F.col("len").desc(), "vec_id").sortWithinPartitions(F.col("len").desc(), "vec_id")
    buckets = materialize(ordered.select("vec_id", "v", "len", "row").mapInArrow(_blocks(BUCKET_ROWS), _BLOCK), "buckets")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    q_parts = max(1, -(-(n // every + 1) // (4 * QUERY_ROWS)))
    blocks = materialize(asked.repartitionByRange(q_parts, F.col("len").desc(), "row").sortWithinPartitions(F.col("len").desc(), "row").select("vec_id", "v", "len", "row").mapInArrow(_blocks(QUERY_ROWS), _BLOCK), "queries")
    q = blocks.select(F.col("no").alias("q_no"), F.col("dim").alias("q_dim"), F.col("rows").alias("q_rows"), F.col("mat").alias("q_mat"))
    seeds = [r["no"] for r in buckets.orderBy(F.col("most").desc(), "no").limit(SEED_BUCKETS).select("no").collect()]

    def scored(met: DataFrame) -> DataFrame:
        return met.select("q_dim", "q_rows", "q_mat", "floor", "dim", "ids", "rows", "mat", "most").mapInArrow(_search(k), _FOUND)

    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    # The seeds are two blocks of bounded size, so they go to the queries.
    seed = F.broadcast(buckets.where(F.col("no").isin(seeds)).withColumn("g", F.lit(0)))
    first = materialize(scored(q.withColumn("floor", F.lit(None).cast("binary")).withColumn("g", F.lit(0)).join(seed, "g")), "first")
    first = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    floors = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    named = materialize(blocks.select("no", "rows", "ids").mapInArrow(_members, "q_no long, query long, query_id long"), "named")
    bounds = named.join(floors, "query").groupBy("q_no").agg(F.collect_list(F.struct("query", "floor")).alias("bounds"))
    bounded = q.join(bounds, "q_no", "left").mapInArrow(_with_floors, "q_no long, q_dim int, q_rows binary, q_mat binary, floor binary, need double")
    side = buckets.where(~F.col("no").isin(seeds)).withColumn("c", _length_class(F.col("most")))
    classes = materialize(side.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / GROUP_BUCKETS).alias("subs")), "classes")
    side = side.join(F.broadcast(classes), "c").withColumn("sub", F.pmod(F.xxhash64("no"), F.col("subs"))).drop("subs")
    rest = scored(_targets(bounded, classes).join(side, ["c", "sub"]))
    both = first.select("query", "vec_id", "score").union(rest)
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(named.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")
