"""Projection and rendering: prompts, task rows and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T


def preprocess_document(x: Column, most: int = 256) -> Column:
    """Title line and the line after it, cut to a number of tokens."""
    lines = F.split(x, "\n")
    body = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    return F.concat(F.lit("(Title: "), F.get(lines, F.lit(0)), F.lit(")\n"), T.truncate_tokens(body, most), F.lit("\n"))


def fill(template: str, **values: Column) -> Column:
    """Placeholders ``{name}`` replaced literally, in the order given."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def draw_task_type(id_col: Column, types: list[str], share: float, seed: int, short: str = "short_form_qa") -> Column:
    """``short`` with probability ``share``, else uniform over the others; hashed from seed and id."""
    u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(salt), id_col)), 1, 13), 16, 10).cast("double") / float(2**52)
    others = [t for t in types if t != short]
    pick = F.element_at(F.array(*[F.lit(t) for t in others]), (F.floor(u("other") * len(others)) + 1).cast("int"))
    return F.when(u("short") < share, short).otherwise(pick)


def select_task_types(known: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None) -> dict[str, str]:
    """A subset of descriptions; both lists, unknown names or nothing left are errors."""
    if include and exclude:
        raise ValueError("give names to include or to exclude, not both")
    if unknown := [n for n in (include or exclude or []) if n not in known]:
        raise ValueError(f"unknown task types {unknown}")
    out = {k: v for k, v in known.items() if (k in include if include else k not in (exclude or []))}
    if not out:
        raise ValueError("no task type is left")
    return out


def parse_turns(spec: str) -> list[int]:
    """Weights of ``"4:3:2"``; not all zero, none negative."""
    try:
        weights = [int(p) for p in spec.strip().split(":")]
    except ValueError:
        raise ValueError(f"bad turns {spec!r}") from None
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError(f"bad turns {spec!r}")
    return weights


def turns_schedule(spark, n: int, weights: list[int], seed: int) -> DataFrame:
    """``(pos, turns)``: quotas by largest remainder, in seeded order; a single weight is a constant."""
    if len(weights) == 1:
        return spark.range(n).select(F.col("id").alias("pos"), F.lit(weights[0]).alias("turns"))
    total = sum(weights)
    quota = [n * w // total for w in weights]
    rest = sorted(range(len(weights)), key=lambda i: (-(n * weights[i] % total), i))
    for i in rest[: n - sum(quota)]:
        quota[i] += 1
    slots = spark.createDataFrame([(i + 1, q) for i, q in enumerate(quota)], "turns int, q int").where("q > 0")
    rows = slots.select("turns", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("k"))
    order = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "turns", "k")), "turns", "k")) - 1
    return rows.select(order.cast("long").alias("pos"), "turns")


def gold_rubric(golds: Column) -> Column:
    """Gold answers in quotes, separated by semicolons."""
    return F.array_join(F.transform(golds, lambda g: F.concat(F.lit('"'), g, F.lit('"'))), "; ")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def task_row(source: Column, prompt: Column, ability: str, style: str, target: Column, index: Column, question: Column, rubrics: Column | None = None) -> list[Column]:
    """The columns of the task schema."""
    none = F.lit(None).cast("array<string>")
    model = F.struct(F.lit(style).alias("style"), F.struct(target.alias("target"), (rubrics if rubrics is not None else none).alias("rubrics")).alias("ground_truth"))
    return [source.alias("data_source"), F.array(message("user", prompt)).alias("prompt"), F.lit(ability).alias("ability"), model.alias("reward_model"), F.struct(index.alias("index"), question.alias("question")).alias("extra_info")]


def numbered(xs: Column) -> Column:
    return F.array_join(F.transform(xs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def passages(docs: Column) -> Column:
    """``Doc i (Title: t)`` and body of each document, stripped."""
    cell = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(d, "\n", 1), F.lit(")\n"), F.regexp_replace(d, r"(?s)\A[^\n]*\n?", ""), F.lit("\n\n"))
    return T.strip(F.array_join(F.transform(docs, cell), ""))


def join_results(results: Column, most: int, raw: bool = False) -> Column:
    text = F.array_join(results, "\n---\n")
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...(truncated)"))).otherwise(text)
    return cut if raw else F.to_json(F.struct(cut.alias("result")))


def flatten_rollouts(items: DataFrame) -> DataFrame:
    """A row per item and attempt of ``(item_id, rollouts array<struct<tool,structure,text>>)`` that passes both checks."""
    rows = items.select("item_id", F.posexplode("rollouts").alias("attempt", "r"))
    return rows.where((F.col("r.tool") == 1) & (F.col("r.structure") == 1)).select("item_id", "attempt", F.col("r.text").alias("text"))


def per_turn_prompts(task: Column, source: Column, turns: Column, everything: Column, initial: str, turn: str, synthesis: str) -> Column:
    """``(stage, prompt)``: the first, one for each turn with documents, and the synthesis."""
    first = F.struct(F.lit("initial").alias("stage"), fill(initial, task_prompt=task, documents=source).alias("prompt"))
    kept = F.filter(F.transform(turns, lambda t, i: F.struct(F.concat(F.lit("turn_"), (i + 1).cast("string")).alias("stage"), t.alias("t"))), lambda x: T.strip(x["t"]["docs"]) != "")
    middle = F.transform(kept, lambda x: F.struct(x["stage"].alias("stage"), fill(turn, task_prompt=task, documents=x["t"]["docs"], search_query=x["t"]["query"]).alias("prompt")))
    end = F.struct(F.lit("synthesis").alias("stage"), fill(synthesis, task_prompt=task, documents=everything).alias("prompt"))
    return F.concat(F.array(first), middle, F.array(end))


def teacher_prompt(prompt: Column, grader: Column, errors: Column) -> Column:
    """The prompt with the grader's thoughts and format errors as feedback; null without any."""
    thought = F.nullif(T.strip(F.regexp_extract(grader, r"(?s)<think>(.*?)</think>", 1)), F.lit(""))
    listed = F.when(F.size(errors) > 0, F.concat(F.lit("Format errors: "), F.array_join(errors, "; ")))
    feedback = F.array_compact(F.array(thought, listed))
    return F.when(F.size(feedback) > 0, F.concat(prompt, F.lit("\n\nFeedback:\n"), F.array_join(feedback, "\n")))


def truncate(ids: Column, most: int, how: str = "error") -> Column:
    """Token ids cut to a length from one side or the middle; ``error`` refuses longer ones."""
    n = F.size(ids)
    if how == "left":
        cut = F.slice(ids, n - most + 1, F.lit(most))
    elif how == "right":
        cut = F.slice(ids, F.lit(1), F.lit(most))
    elif how == "middle":
        head = most // 2
        cut = F.concat(F.slice(ids, F.lit(1), F.lit(head)), F.slice(ids, n - (most - head) + 1, F.lit(most - head)))
    elif how == "error":
        cut = F.raise_error(F.concat(F.lit("prompt of "), n.cast("string"), F.lit(f" tokens is longer than {most}"))).cast("array<bigint>")
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(n > most, cut).otherwise(ids)


def sft_mask(n_prompt: Column, n_response: Column) -> Column:
    """Loss on the prompt's last token and the response, but not on the final token."""
    total = n_prompt + n_response
    return F.transform(F.sequence(F.lit(0), total - 1), lambda i: ((i >= n_prompt - 1) & (i < total - 1)).cast("int"))


def multi_turn_mask(turns: Column) -> Column:
    """1 for each word of an assistant's turn, 0 for the others'."""
    return F.flatten(F.transform(turns, lambda t: F.array_repeat((t["role"] == "assistant").cast("int"), F.size(T.words(t["text"])))))


def tool_runs(turns: DataFrame) -> DataFrame:
    """``run`` numbers of adjacent messages of one role: gaps and islands over each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = (F.col("role") != F.lag("role", 1, "").over(w)).cast("int")
    return turns.withColumn("__c", change).withColumn("run", F.sum("__c").over(w)).drop("__c")


def split_media(x: Column) -> Column:
    """Text pieces and media markers in order, empty pieces dropped."""
    return F.filter(F.split(x, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda p: p != "")
