"""Validation of generated turns and records, usage records, stage chaining and the plug-in registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.score import overlong_penalty


# The error messages of turns and records.
def tag_errors(x: Column, tag: str, name: str | None = None) -> Column:
    """Missing, unclosed and empty tags told apart."""
    name = name or tag
    opened, closed = x.contains(f"<{tag}>"), F.size(T.blocks(x, tag)) > 0
    empty = closed & (F.size(T.stripped_blocks(x, tag)) == 0)
    return F.array_compact(F.array(F.when(~opened, F.lit(f"Missing <{name}> tag")), F.when(opened & ~closed, F.lit(f"Unclosed <{name}> tag")), F.when(empty, F.lit(f"Empty <{name}> tag"))))


def turn_errors(x: Column, final: Column) -> Column:
    """Every turn must think; the final one must answer, the others must search."""
    return F.concat(tag_errors(x, "think"), F.when(final, tag_errors(x, "answer")).otherwise(tag_errors(x, "search")))


def record_errors(x: Column) -> Column:
    """Errors of all assistant turns of a trajectory, each with its turn; none at all is an error too."""

    def numbered(turns):
        cells = F.transform(turns, lambda t, i: F.transform(turn_errors(t, i == F.size(turns) - 1), lambda e: F.concat(F.lit("turn "), (i + 1).cast("string"), F.lit(": "), e)))
        return F.when(F.size(turns) == 0, F.array(F.lit("no assistant turn"))).otherwise(F.flatten(cells))

    return T.let(T.assistant_turns(x), numbered)


def token_budget(x: Column, think_limit: int, answer_limit: int) -> Column:
    """Thoughts over their limit, mean thought length, answer length and whether it is over its limit."""

    def stats(sizes):
        over = F.size(F.filter(sizes, lambda n: n > think_limit))
        mean = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0.0), lambda s, n: s + n) / F.greatest(F.size(sizes), F.lit(1))).otherwise(0.0)
        return F.struct(over.alias("over"), mean.alias("mean"))

    thoughts = T.let(F.transform(T.stripped_blocks(x, "think"), T.token_count), stats)
    answer = F.coalesce(T.token_count(T.last(T.stripped_blocks(x, "answer"))), F.lit(0))
    return F.struct(thoughts["over"].alias("think_budget_violations"), thoughts["mean"].alias("avg_think_tokens"), answer.alias("answer_tokens"), (answer > answer_limit).alias("answer_over_limit"))


PY_CALL = r"search\s*\(\s*query_list\s*=\s*\[(.*?)\]\s*\)"


def python_style_queries(x: Column) -> Column:
    """Queries of ``search(query_list=["a", 'b'])`` calls."""
    inner = F.array_join(F.regexp_extract_all(x, F.lit("(?s)" + PY_CALL), F.lit(1)), ",")
    return F.regexp_extract_all(inner, F.lit(r"""["']([^"']+)["']"""), F.lit(1))


def usage_records(calls: DataFrame) -> DataFrame:
    """Per item: calls in order, and their tokens."""
    cell = F.struct("rubric_idx", "tokens")
    return calls.groupBy("item_id").agg(F.array_sort(F.collect_list(cell)).alias("calls"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_calls"))


def chain(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stages one after the other."""
    for s in stages:
        df = s(df)
    return df


def generate(prompts: DataFrame, model: Callable[[pd.Series], pd.Series], n: int, prompt_col: str = "prompt", id_col: str = "row_id") -> DataFrame:
    """``n`` replies per prompt by a pluggable batch model, as one array per prompt in order of the sample."""
    rows = prompts.select(id_col, prompt_col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = model(pdf[prompt_col] + "#" + pdf["sample"].astype(str))
            yield pd.DataFrame({id_col: pdf[id_col], "sample": pdf["sample"], "reply": list(replies)})

    out = rows.mapInPandas(run, f"{id_col} long, sample int, reply string")
    return out.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "reply"))), lambda c: c["reply"]).alias("responses"))


class RewardRegistry:
    """Scorers by name: column expressions, or batch functions over text and gold that score 0 where they fail."""

    def __init__(self):
        self._known: dict[str, Callable[[Column, Column], Column]] = {}

    def register(self, name: str, scorer: Callable[[Column, Column], Column]) -> None:
        if name in self._known:
            raise ValueError(f"scorer {name!r} is taken")
        self._known[name] = scorer

    def register_batch(self, name: str, f: Callable[[str, str], float]) -> None:
        def safe(a, b) -> float:
            try:
                return float(f(a, b))
            except Exception:  # a scorer's failure is a score of 0 by definition
                return 0.0

        def build(response: Column, gold: Column) -> Column:
            @F.pandas_udf("double")
            def scored(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series([safe(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

            return scored(response, gold)

        self.register(name, build)

    def score(self, name: str, response: Column, gold: Column) -> Column:
        if name not in self._known:
            raise ValueError(f"unknown scorer {name!r}; known: {sorted(self._known)}")
        return self._known[name](response, gold)


def _safe(scorer: Callable[[str], float]):
    """A scorer over batches of texts whose failures score 0."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return float(scorer(text))
            except Exception:  # a scorer's failure is a score of 0 by definition
                return 0.0

        return pd.Series([one(t) for t in texts], dtype="float64")

    return scored


def _plain(rows: DataFrame, score: Column) -> Column:
    return score


def _overlong(rows: DataFrame, score: Column, expected: int = 12, buffer: int = 4) -> Column:
    return score + overlong_penalty(F.col("len"), expected, buffer)


_MANAGERS: dict[str, Callable[[DataFrame, Column], Column]] = {"naive": _plain, "batch": _plain, "dapo": _overlong, "prime": _plain}


def managers() -> list[str]:
    """Names of the registered reward managers."""
    return list(_MANAGERS)


def register_manager(name: str, manager: Callable[[DataFrame, Column], Column]) -> None:
    """A manager turns rows and their score into a reward; a name can be taken once, or again by the same manager."""
    if _MANAGERS.setdefault(name, manager) is not manager:
        raise ValueError(f"manager {name!r} is taken")


def reward(name: str, rows: DataFrame, scorer: Callable[[str], float], text_col: str = "solution") -> DataFrame:
    """``rows`` with the ``reward`` of a registered manager for the scorer's scores.

    Row by row, in batches and by a pool of workers are one here: scores are
    computed in Arrow batches on all executors, and a failing row scores 0.
    """
    if name not in _MANAGERS:
        raise ValueError(f"unknown manager {name!r}; known: {managers()}")
    return rows.withColumn("reward", _MANAGERS[name](rows, _safe(scorer)(F.col(text_col))))


def rolling_context(lengths: Column, budget: int) -> Column:
    """Index of the first message that a context of ``budget`` tokens, cut on the left, still holds whole."""
    zero = F.struct(F.lit(0).alias("used"), F.size(lengths).alias("first"), F.lit(True).alias("open"))

    def step(s, x):
        fits = s["open"] & (s["used"] + x <= budget)
        return F.struct(F.when(fits, s["used"] + x).otherwise(s["used"]).alias("used"), F.when(fits, s["first"] - 1).otherwise(s["first"]).alias("first"), fits.alias("open"))

    return F.aggregate(F.reverse(lengths), zero, step, lambda s: s["first"])
