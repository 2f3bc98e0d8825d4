"""Preference formatting of chosen and rejected conversations.

For each pair the longest common turn prefix is found, rendered once as the
prompt, and what follows is rendered as two completions.  A completion's mask
lists the character spans ``start:end`` that carry loss: the content and the
end mark of assistant turns; headers and other roles carry none.

Turns are rendered as header, content and end mark.  Null content is empty, a
null role is ``user``.  A pair lacking one side gets an empty completion
there; pairs with equal sides have an empty pair of completions.  Turns
repeated under one number stay, in order of role and text.  One conversation
becomes one row, so its turns must fit one row; nothing else is gathered.  An
empty table gives no pairs; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def gather_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(pair_id, turns)``: each conversation's turns in order."""
    cells = turns.select(F.col(id_col).cast("long").alias("pair_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    return cells.groupBy("pair_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("pair_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both."""
    upto = F.least(F.size(a), F.size(b))
    places = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.get(a, i) != F.get(b, i))
    return F.coalesce(F.get(differ, F.lit(0)), upto)


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """``start:end`` of assistant contents in ``render(turns)``, comma-joined; ends are exclusive."""
    head = len(HEAD) + len(MIDDLE)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, t):
        start = s["at"] + head + F.length(t["role"])
        end = start + F.length(t["text"]) + len(END)
        span = F.when(t["role"] == "assistant", F.array(F.concat_ws(":", start, end))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(s["out"], span).alias("out"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["out"]), ",")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """From ``(pair_id, chosen, rejected)`` with arrays of ``(role, text)``: prompt, completions and masks."""
    none = F.array().cast(_TURNS)
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    rows = rows.withColumn("n", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    rows = rows.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    return rows.select("pair_id", "n_prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), loss_spans(F.col("c")).alias("chosen_mask"), loss_spans(F.col("r")).alias("rejected_mask"))


def pairs_from_conversations(turns: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant turn.

    Chosen is the conversation up to its last assistant turn; rejected has,
    in that turn's place, the conversation's first assistant reply, or an
    empty one where the last is the first.
    """
    rows = gather_turns(turns)
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", places).where("size(at) > 0")
    last, first = F.element_at("at", -1), F.element_at("at", 1)
    chosen = F.slice("turns", F.lit(1), last + 1)
    worse = F.when(first < last, F.get(F.col("turns"), first)["text"]).otherwise(F.lit(""))
    rejected = F.concat(F.slice("turns", F.lit(1), last), F.array(F.struct(F.lit("assistant").alias("role"), worse.alias("text"))))
    return rows.select("pair_id", chosen.alias("chosen"), rejected.alias("rejected"))
