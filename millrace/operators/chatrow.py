"""Training rows of multi-turn chats: tokens, loss mask and positions, turn by turn.

A turn is a header (a start mark and its role), its content and an end mark.
The prompt is every turn before the first reply and that reply's header; the
response is the rest.  Content and end mark of the assistant's turns carry
loss, headers and other roles none.  A prompt over its limit loses its oldest
tokens, a response its last ones, and what a row may hold in all is kept from
the left as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, tokens

START, END = "<|im_start|>", "<|im_end|>"


def turn_cells(turns: Column, tokenize: Callable[[Column], Column] = tokens) -> Column:
    """``(token, loss)`` of all turns one after the other; ``tokenize`` gives the tokens of a content as an array of strings."""
    cell = lambda token, loss: F.struct(token.alias("token"), loss.alias("loss"))

    def one(t):
        mine = (t["role"] == "assistant").cast("int")
        head = F.array(cell(F.lit(START), F.lit(0)), cell(t["role"], F.lit(0)))
        body = F.transform(tokenize(F.coalesce(t["text"], F.lit(""))), lambda x: cell(x, mine))
        return F.concat(head, body, F.array(cell(F.lit(END), mine)))

    return F.flatten(F.transform(turns, one))


def _kept(cells: Column, most: int, left: bool) -> Column:
    """At most ``most`` cells: the last ones if cut on the left, else the first."""
    return let(cells, lambda c: F.when(F.size(c) <= most, c).otherwise(F.slice(c, F.size(c) - most + 1, F.lit(most)) if left else F.slice(c, F.lit(1), F.lit(most))))


def chat_rows(chats: DataFrame, max_prompt: int, max_response: int, max_row: int, key: str = "conv_id", turns: str = "turns", tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """``(key, prompt, response, loss_mask, positions)`` from arrays of ``(role, text)`` in order.

    A chat without a reply is all prompt.  Roles must not be null; a null text is empty.
    """
    if min(max_prompt, max_response, max_row) < 1:
        raise ValueError("limits must be positive")
    roles = F.transform(F.col(turns), lambda t: t["role"])
    first = F.array_position(roles, "assistant").cast("int")  # from 1; 0 if there is none
    cells = turn_cells(F.col(turns), tokenize)
    before = F.when(first > 0, F.slice(F.col(turns), F.lit(1), first - 1)).otherwise(F.col(turns))
    rows = chats.select(key, cells.alias("cells"), (F.size(turn_cells(before, tokenize)) + F.when(first > 0, 2).otherwise(0)).alias("n"))
    rows = rows.select(key, _kept(F.slice("cells", F.lit(1), F.col("n")), max_prompt, left=True).alias("p"), _kept(F.slice("cells", F.col("n") + 1, F.size("cells")), max_response, left=False).alias("r"))
    # Of a row that is too long the prompt's oldest tokens go first, then the response's.
    rows = rows.select(key, F.slice("p", F.greatest(F.size("p") + F.least(F.size("r"), F.lit(max_row)) - max_row, F.lit(0)) + 1, F.size("p") + 1).alias("p"), _kept(F.col("r"), max_row, left=True).alias("r"))
    token, loss = (lambda c: F.transform(c, lambda x: x["token"])), (lambda c: F.transform(c, lambda x: x["loss"]))
    size = F.size("p") + F.size("r")
    positions = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(key, token("p").alias("prompt"), token("r").alias("response"), F.concat(F.transform("p", lambda _: F.lit(0)), loss("r")).alias("loss_mask"), positions.alias("positions"))
