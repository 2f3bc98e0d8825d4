"""Order, limit, set and shape operators over batches of rows.

Rows get their position from ``ordinal``: counts of deterministic buckets
give each bucket's first position and rows are numbered inside their bucket,
so no task ever holds the whole order.  There are as many buckets as
``BUCKET_ROWS`` asks for, so a task's share does not grow with the table.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of positions should have; there are at least ``BUCKETS`` of them.
BUCKET_ROWS = 500_000
BUCKETS = 256


def ordinal(df: DataFrame, bucket: Column, order: list[Column], name: str = "ord") -> DataFrame:
    """Positions from 0 in the order of ``bucket`` and, within it, ``order``; buckets are a bounded number of integers."""
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"))  # one row a bucket
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.join(F.broadcast(starts), "__b").withColumn(name, F.col("__start") + place).drop("__b", "__start")


def by_number(df: DataFrame, id_col: str = "row_id", name: str = "ord", descending: bool = False) -> DataFrame:
    """Positions in the order of an integer column, bucketed by its range; rows without a number come first, last where descending."""
    # Buckets divide the middle of the range, so that a few far numbers do not put all others into one.
    middle = F.percentile_approx(id_col, F.array(F.lit(0.001), F.lit(0.999)), 10_000)
    ends = df.agg(middle.alias("m"), F.greatest(F.lit(BUCKETS), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS)).alias("__k")).select(F.col("m")[0].alias("__lo"), F.col("m")[1].alias("__hi"), "__k")
    rows = df.crossJoin(F.broadcast(ends))
    place = (F.col(id_col).cast("double") - F.col("__lo")) * F.col("__k") / (F.col("__hi").cast("double") - F.col("__lo") + 1)
    at = F.least(F.greatest(F.floor(place), F.lit(0)), F.col("__k")).cast("int")
    at = F.coalesce(-at if descending else at, F.lit(1 if descending else -1))
    out = ordinal(rows, at, [F.col(id_col).desc() if descending else F.col(id_col)], name)
    return out.drop("__lo", "__hi", "__k")


def by_hash(df: DataFrame, seed: int, id_col: str = "row_id", name: str = "ord") -> DataFrame:
    """Positions in a seeded random order: that of an MD5 of seed and id."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col)))
    size = df.agg(F.greatest(F.lit(BUCKETS), F.ceil(F.count(F.lit(1)) / BUCKET_ROWS)).alias("__k"))
    at = F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * F.col("__k") / F.lit(float(1 << 32))).cast("int")
    return ordinal(df.crossJoin(F.broadcast(size)), at, [h, F.col(id_col)], name).drop("__k")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of an order; a bounded heap per task, then of all."""
    return df.orderBy(*order).limit(n)


def concat(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffled_slice(df: DataFrame, seed: int, offset: int = 0, size: int | None = None, id_col: str = "row_id") -> DataFrame:
    """Seeded shuffle, then rows from ``offset``; an offset past the end is an error."""
    n = df.count()
    if offset >= n > 0 or offset < 0:
        raise ValueError(f"offset {offset} is outside {n} rows")
    rows = by_hash(df, seed, id_col).where(F.col("ord") >= offset)
    return rows.where(F.col("ord") < offset + size) if size is not None else rows


def partition_of(df: DataFrame, index: int, parts: int = 5, id_col: str = "row_id") -> DataFrame:
    """Part ``index`` of ``parts`` equal ones; rows over the last full part are in none."""
    size = df.count() // parts
    rows = by_number(df, id_col)
    return rows.where((F.col("ord") >= index * size) & (F.col("ord") < (index + 1) * size))


def select_positions(df: DataFrame, positions: list[int], id_col: str = "row_id") -> DataFrame:
    """Rows at the given positions in the given order, repeats included, as ``at``."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), "at long, ord long")
    return by_number(df, id_col).join(F.broadcast(wanted), "ord").drop("ord")


def slice_rows(df: DataFrame, start: int, stop: int, step: int = 1, id_col: str = "row_id") -> DataFrame:
    o = F.col("ord")
    return by_number(df, id_col).where((o >= start) & (o < stop) & ((o - start) % step == 0))


def split(df: DataFrame, size: int, id_col: str = "row_id") -> DataFrame:
    """``chunk`` numbers of consecutive rows, ``size`` each but for the last."""
    return by_number(df, id_col).withColumn("chunk", F.floor(F.col("ord") / size).cast("long"))


def chunk(df: DataFrame, n: int, id_col: str = "row_id", pad: bool = False) -> DataFrame:
    """``n`` equal chunks; the size must divide unless ``pad`` allows a shorter last one."""
    rows = df.count()
    if rows % n and not pad:
        raise ValueError(f"{rows} rows do not divide into {n} chunks")
    return split(df, max(1, -(-rows // n)), id_col)


mini_batches = split


def repeat(df: DataFrame, n: int, interleave: bool = True, id_col: str = "row_id") -> DataFrame:
    """Every row ``n`` times: each beside its copies, or the whole batch over and over; ``pos`` is the new position."""
    total = df.count()
    rows = by_number(df, id_col).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pos = F.col("ord") * n + F.col("rep") if interleave else F.col("rep") * total + F.col("ord")
    return rows.withColumn("pos", pos)


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own column says."""
    return df.withColumn("rep", F.explode(F.when(F.col(times) > 0, F.sequence(F.lit(0), F.col(times).cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def unfold_chunks(df: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Arrays in ``columns`` cut into ``n`` equal parts, a row for each; the rest is repeated."""
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        size = F.floor(F.size(c) / n).cast("int")
        rows = rows.withColumn(c, F.slice(c, F.col("part") * size + 1, size))
    return rows


def pad_to_divisor(df: DataFrame, divisor: int, id_col: str = "row_id") -> tuple[DataFrame, int]:
    """The batch and leading rows again, as often as needed for its size to divide; and how many were added."""
    n = df.count()
    pad = -n % divisor if n else 0
    rows = by_number(df, id_col)
    if not pad:
        return rows.withColumn("pad", F.lit(False)), 0
    rounds = F.sequence(F.lit(0), F.lit((pad - 1) // n))
    extra = rows.withColumn("round", F.explode(rounds)).withColumn("ord", F.col("ord") + (F.col("round") + 1) * n).drop("round")
    return rows.withColumn("pad", F.lit(False)).unionByName(extra.where(F.col("ord") < n + pad).withColumn("pad", F.lit(True))), pad


def unpad(df: DataFrame) -> DataFrame:
    return df.where("NOT pad")


def collate(df: DataFrame, size: int, id_col: str = "row_id") -> DataFrame:
    """Consecutive batches of ``size`` rows, each a row of ``chunk`` and a list for every column."""
    rows = split(df, size, id_col)
    cells = F.array_sort(F.collect_list(F.struct("ord", *[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])))
    lists = rows.groupBy("chunk").agg(cells.alias("cells"))
    return lists.select("chunk", *[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(df.columns)])


def fold(df: DataFrame, size: int, value: str, id_col: str = "row_id") -> DataFrame:
    """Consecutive rows as arrays of ``size`` values."""
    rows = split(df, size, id_col)
    return rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))), lambda x: x[value]).alias(value))


def unfold(df: DataFrame, size: int, value: str) -> DataFrame:
    """The reverse of ``fold``."""
    return df.select("chunk", F.posexplode(value).alias("i", value)).withColumn("ord", F.col("chunk") * size + F.col("i")).drop("i")


def union_columns(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns of both; where both have one, its values must be equal."""
    common = [c for c in b.columns if c in a.columns and c != key]
    right = b.select(key, *[F.col(c).alias(f"__{c}" if c in common else c) for c in b.columns if c != key])
    rows = a.join(right, key)
    for c in common:
        rows = rows.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType))).drop(f"__{c}")
    return rows


# -- balancing by length


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: merge the two most uneven partial splits, heavy bins onto light ones, until one is left."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} items for {k} parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size and len(order) % k:
        raise ValueError(f"{len(order)} items do not divide by {k}")
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap = []
    for tick, g in enumerate(groups):
        bins = sorted([(lengths[i], [i]) for i in g] + [(0, []) for _ in range(k - len(g))], reverse=True)
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], tick, bins))
    tick = len(groups)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        bins = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], tick, bins))
        tick += 1
    return [sorted(items) for _, items in heap[0][2]]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Items in the order given, each to the lightest part; for equal sizes a large constant is added to every length."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + n + bias, p))
    return parts


def _balanced(method, k: int, equal_size: bool, id_col: str, length: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        part = pd.Series(0, index=pdf.index)
        for p, items in enumerate(method([int(n) for n in pdf[length]], k, equal_size)):
            part.iloc[items] = p
        return pdf.assign(part=part.astype("int64"))[["batch", id_col, length, "part"]]

    return run


def balance(df: DataFrame, k: int, batch_size: int = 512, equal_size: bool = False, method=differencing, id_col: str = "row_id", length: str = "len") -> DataFrame:
    """``part`` of each row inside its batch of ``batch_size``: heaps are sequential, batches run side by side."""
    rows = split(df.select(id_col, F.col(length).cast("long").alias(length)), batch_size, id_col).withColumnRenamed("chunk", "batch")
    whole = rows.join(rows.groupBy("batch").count().where(F.col("count") >= k).select("batch"), "batch", "left_semi")
    if equal_size:
        whole = whole.join(rows.groupBy("batch").count().where(F.col("count") % k == 0).select("batch"), "batch", "left_semi")
    return whole.select("batch", id_col, length).groupBy("batch").applyInPandas(_balanced(method, k, equal_size, id_col, length), f"batch long, {id_col} long, {length} long, part long")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


def _micro(max_tokens: int, id_col: str, length: str, divided_by: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        lens = [int(n) for n in pdf[length]]
        k = round_up(min(len(lens), ceil_div(sum(lens), max_tokens)), divided_by)
        parts = differencing(lens, min(k, len(lens)))
        parts.sort(key=lambda p: (sum(lens[i] ** 2 for i in p), min(p, default=0)), reverse=True)
        micro = pd.Series(0, index=pdf.index)
        for m, items in enumerate(parts):
            micro.iloc[items] = m
        return pdf.assign(micro=micro.astype("int64"))[["batch", id_col, length, "micro"]]

    return run


def micro_batches(df: DataFrame, max_tokens: int, batch_size: int = 512, id_col: str = "row_id", length: str = "len", divided_by: int = 1) -> DataFrame:
    """As many balanced micro-batches per batch as its tokens need, heaviest (by squared lengths) first."""
    rows = split(df.select(id_col, F.col(length).cast("long").alias(length)), batch_size, id_col).withColumnRenamed("chunk", "batch")
    return rows.select("batch", id_col, length).groupBy("batch").applyInPandas(_micro(max_tokens, id_col, length, divided_by), f"batch long, {id_col} long, {length} long, micro long")


def unbalance(parts: DataFrame, part: str = "part", length: str = "len") -> DataFrame:
    """Smallest, largest and mean load of the parts of each batch."""
    loads = parts.groupBy("batch", part).agg(F.sum(length).alias("load"))
    return loads.groupBy("batch").agg(F.min("load").alias("min_load"), F.max("load").alias("max_load"), F.avg("load").alias("mean_load"))


# -- masks and padding


def tail_mask(attention: Column | str, length: int) -> Column:
    """Response mask: the last ``length`` positions of an attention mask."""
    return F.slice(attention, F.size(attention) - length + 1, F.lit(length))


def eos_mask(ids: Column | str, eos: list[int]) -> Column:
    """1 up to and with the first end id, 0 after it."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    ends = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(eos), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(ends, F.lit(0)), F.size(ids))
    return F.transform(ids, lambda x, i: (i <= first).cast("int"))


def pad(ids: Column | str, length: int, value: int, left: bool = False) -> Column:
    """Padded to ``length``; as it is where that long or longer."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    fill = F.array_repeat(F.lit(value).cast("long"), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def fit(ids: Column | str, length: int, value: int, left: bool = False, keep_end: bool = False) -> Column:
    """Padded or cut to exactly ``length``; what is cut off is the end, or the beginning where ``keep_end``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    short = F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, F.lit(length)) if keep_end else F.slice(ids, F.lit(1), F.lit(length))
    return pad(short, length, value, left)


def remove_pad(ids: Column | str, mask: Column | str) -> Column:
    """Values where the mask is set."""
    cells = F.filter(F.arrays_zip(F.col(ids).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1)
    return F.transform(cells, lambda x: x["v"])


def split_turns(conversations: DataFrame) -> DataFrame:
    """A row per assistant turn: the messages before it as prompt, advantage and reward copied, reward on the last token.

    Input: ``(conv_id, turns, advantage, reward)``.  Turns without content and
    conversations without assistant turns give no row.
    """
    rows = conversations.select("conv_id", "turns", "advantage", "reward", F.posexplode("turns").alias("at", "turn"))
    rows = rows.where((F.col("turn.role") == "assistant") & (F.trim("turn.text") != ""))
    words = F.size(F.split(F.trim("turn.text"), r"\s+"))
    scores = F.transform(F.sequence(F.lit(1), words), lambda i: F.when(i == words, F.col("reward")).otherwise(0.0))
    return rows.select("conv_id", F.col("at").cast("int").alias("at"), F.slice("turns", F.lit(1), F.col("at")).alias("prompt"), F.col("turn.text").alias("response"), "advantage", scores.alias("token_scores"))


def stratified(df: DataFrame, bucket: str, quotas: dict[int, int], seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """At most a quota of rows from each bucket, a seeded random choice; the ranks stop at the quota in every task."""
    given = df.sparkSession.createDataFrame(list(quotas.items()), "__bucket int, __quota int")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col)))
    rows = df.join(F.broadcast(given), F.col(bucket) == F.col("__bucket"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(order, id_col))
    return rows.withColumn("__r", rank).where(F.col("__r") <= max(quotas.values(), default=0)).where("__r <= __quota").drop("__r", "__bucket", "__quota")
