"""Parsing and comparing of answer texts, as column expressions.

Patterns use Unicode white space as the original semantics do; only what is
not regular (nested braces) falls back to an Arrow-batched function.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, as the comparison of answers drops it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The tags of the supported markups.
TAGS = {"think": "think", "answer": "answer", "search": "search", "information": "information", "tool_call": "tool_call", "tool_response": "tool_response"}



def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once; a lambda's free expressions are otherwise evaluated for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without leading and trailing (Unicode) white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _capital(c: str) -> str:
    """The one capital of a letter; the letter itself if it has none or several."""
    return "\u1e9e" if c == "\u00df" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c)


@functools.cache
def _capitals() -> dict[str, str]:
    """Made when first asked for, as workers that import this module do not need it."""
    return {c: u for c in map(chr, range(sys.maxunicode + 1)) if not c.isascii() and (u := _capital(c)) != c}


def upper(x: Column) -> Column:
    """Capitals letter by letter, as SQL has them: the length stays, where ``F.upper`` makes SS of a sharp s and FI of a ligature."""
    plain, others = "abcdefghijklmnopqrstuvwxyz", _capitals()
    return F.translate(x, plain + "".join(others), plain.upper() + "".join(others.values()))


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def words(x: Column) -> Column:
    """White-space separated words; none for a blank text."""
    s = squeeze(x)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def drop_punctuation(x: Column) -> Column:
    return F.translate(x, PUNCTUATION, "")


def normalize_answer(x: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    return squeeze(F.regexp_replace(drop_punctuation(F.lower(x)), r"(?U)\b(a|an|the)\b", " "))


def blocks(x: Column, tag: str) -> Column:
    """Contents of all closed ``<tag>`` blocks."""
    return F.regexp_extract_all(x, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def stripped_blocks(x: Column, tag: str) -> Column:
    """As ``blocks``, stripped, without empty ones."""
    return F.filter(F.transform(blocks(x, tag), strip), lambda b: b != "")


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def strip_env_turns(x: Column) -> Column:
    """Without user and environment turns, in chat markup or bare role lines."""
    x = F.regexp_replace(x, r"(?s)<\|im_start\|>user\n.*?<\|im_end\|>", "")
    return F.regexp_replace(x, r"(?s)(?:(?<=\n)|^)user\n.*?(?=\nassistant\n|\z)", "")


def assistant_segments(x: Column) -> Column:
    """``(role, text, is_last)`` of the assistant's turns; text before the first role line is one."""
    x = F.regexp_replace(x, r"(?s)<\|im_start\|>user\n.*?<\|im_end\|>", "")
    parts = F.split(F.regexp_replace(x, r"(?:\n|^)(user|assistant)\n", "\u0000$1\u0001"), "\u0000")
    cells = F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "assistant").otherwise(F.substring_index(p, "\u0001", 1)).alias("role"), F.when(i == 0, p).otherwise(F.regexp_replace(p, "(?s)^[^\u0001]*\u0001", "")).alias("text"), (i == 0).alias("head")))
    cells = F.filter(cells, lambda c: ~c["head"] | (c["text"] != ""))
    tagged = let(cells, lambda cs: F.transform(cs, lambda c, i: F.struct(c["role"].alias("role"), c["text"].alias("text"), (i == F.size(cs) - 1).alias("is_last"))))
    return F.filter(tagged, lambda c: c["role"] == "assistant")


def _orphan(text: Column) -> Column:
    """What follows an ``<answer>`` that opens after the last closing tag, or null."""
    tail = F.regexp_extract(text, r"(?s)\A(?:.*</answer>)?(.*)\z", 1)
    return F.when(tail.contains("<answer>"), F.regexp_extract(tail, r"(?s)\A.*?<answer>(.*)\z", 1))


def assistant_turns(x: Column) -> Column:
    """Contents of the assistant's turns in chat markup."""
    return F.regexp_extract_all(x, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"), F.lit(1))


def leading_thought(turn: Column) -> Column:
    """The thought that a turn begins with; null where it begins with something else."""
    return F.when(turn.rlike(r"(?s)\A\s*<think>.*?</think>"), F.regexp_extract(turn, r"(?s)\A\s*<think>(.*?)</think>", 1))


def tagged_answer(x: Column) -> Column:
    """Last answer over the assistant's segments: a closed tag, or one left open in a segment that is not the last; null if none."""

    def of(s):
        closed = last(blocks(s["text"], "answer"))
        return F.when(~s["is_last"], F.coalesce(_orphan(s["text"]), closed)).otherwise(closed)

    found = F.filter(F.transform(assistant_segments(x), of), lambda a: a.isNotNull())
    return last(found)


_SUBMIT = "name string, arguments struct<answer:string,query_list:array<string>,queries:array<string>,query:string,task:string,task_prompt:string>"


def tool_calls(x: Column) -> Column:
    """Parsed JSON of the tool calls; unreadable ones are null."""
    return F.transform(blocks(x, "tool_call"), lambda c: F.from_json(strip(c), _SUBMIT))


def submitted_answer(x: Column) -> Column:
    calls = F.filter(tool_calls(x), lambda c: (c["name"] == "submit_answer") & (strip(c["arguments"]["answer"]) != ""))
    return strip(F.get(calls, F.lit(0))["arguments"]["answer"])


def submitted_task(x: Column) -> Column:
    """Prompt of the first ``submit_task`` call that has one."""
    calls = F.filter(tool_calls(x), lambda c: (c["name"] == "submit_task") & (strip(c["arguments"]["task_prompt"]) != ""))
    return strip(F.get(calls, F.lit(0))["arguments"]["task_prompt"])


# Markup of the search and answer formats.
FC_ANSWER = r"""(?s)<function_calls>\s*answer\s*\(\s*answer\s*=\s*["'](.+?)["']\s*\)"""
FC_SEARCH = r"""(?s)<function_calls>\s*search\s*\(\s*query\s*=\s*["'](.+?)["']\s*\)"""
BOXED = r"\\boxed\{([^}]*)\}"
CALL_TOOL = r"""(?s)<call_tool\s+[^>]*?>(.*?)(?:</call_tool>|</call>)"""
WEB_QUERY = r"(?s)<\|begin_search_query\|>(.*?)<\|end_search_query\|>"


def solver_answer(x: Column) -> Column:
    """Tag, then submit call, then function call, then boxed; an error in the tag ends the search."""
    tag = tagged_answer(x)
    opened = F.exists(assistant_segments(x), lambda s: s["text"].contains("<answer>"))
    submit = submitted_answer(x)
    called = F.nullif(strip(F.regexp_extract(x, FC_ANSWER, 1)), F.lit(""))
    boxed = F.nullif(strip(last(F.regexp_extract_all(x, F.lit(BOXED), F.lit(1)))), F.lit(""))
    clean = F.when(strip(tag) != "", strip(tag))
    return F.when(tag.isNotNull(), clean).when(submit.isNotNull(), submit).when(~opened, F.coalesce(called, boxed))


def solver_errors(x: Column) -> Column:
    tag = tagged_answer(x)
    opened = F.exists(assistant_segments(x), lambda s: s["text"].contains("<answer>"))
    none = tag.isNull() & submitted_answer(x).isNull()
    return F.array_compact(F.array(F.when(x == "", F.lit("Empty response")), F.when(none & opened, F.lit("Unclosed <answer> tag")), F.when(strip(tag) == "", F.lit("Empty <answer> tag"))))


def search_queries(x: Column) -> Column:
    """Queries of all five markups, in the order of the markups."""
    nonempty = lambda xs: F.filter(F.transform(xs, strip), lambda q: q != "")
    found = lambda p: nonempty(F.regexp_extract_all(x, F.lit(p), F.lit(1)))
    calls = F.filter(tool_calls(x), lambda c: c["name"].isin("search", "browse"))
    web = F.flatten(F.transform(calls, lambda c: F.when(c["name"] == "search", F.filter(F.coalesce(c["arguments"]["queries"], F.array().cast("array<string>")), lambda q: strip(q) != "")).otherwise(nonempty(F.array_compact(F.array(c["arguments"]["query"]))))))
    return F.concat(stripped_blocks(x, "search"), found(FC_SEARCH), found(CALL_TOOL), found(WEB_QUERY), web)


def valid_tool_calls(x: Column) -> Column:
    """Search calls with a non-empty list of queries."""
    return F.size(F.filter(tool_calls(x), lambda c: (c["name"] == "search") & (F.size(c["arguments"]["query_list"]) > 0) & F.forall(c["arguments"]["query_list"], lambda q: q.isNotNull()))).cast("long")


def source_document(x: Column) -> Column:
    """The prompt's source section, stripped; empty if there is none."""
    return strip(F.regexp_extract(x, r"(?s)## Source Document\s*\n(.*?)(?=\n## |\z)", 1))


def all_documents(x: Column) -> Column:
    head = source_document(x)
    parts = F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), stripped_blocks(x, "tool_response"), stripped_blocks(x, "information"))
    return F.array_join(parts, "\n\n---\n\n")


def search_turns(x: Column) -> Column:
    """``(query, docs)`` of each search; what was not answered has empty docs."""
    return let(blocks(x, "information"), lambda ds: F.transform(blocks(x, "search"), lambda q, i: F.struct(strip(q).alias("query"), F.coalesce(strip(F.get(ds, i)), F.lit("")).alias("docs"))))


def search_turn_text(x: Column) -> Column:
    ds = blocks(x, "information")
    cells = F.transform(blocks(x, "search"), lambda q, i: F.concat(F.lit("[Search turn "), (i + 1).cast("string"), F.lit(': "'), strip(q), F.lit('"]\n'), F.coalesce(strip(F.get(ds, i)), F.lit("(no results)"))))
    return F.array_join(cells, "\n\n")


def dedup_docs(turns: Column) -> Column:
    """Documents already seen in an earlier place (first 200 characters of the body) are dropped, over all turns."""
    empty = F.array().cast("array<string>")

    def chunks(raw):
        cut = F.split(raw, r"(?=Doc \d+ \(Title:)")
        return F.filter(F.transform(F.when(F.size(cut) > 1, cut).otherwise(F.split(raw, "\n\n")), strip), lambda c: c != "")

    def fingerprint(c):
        return F.substring(strip(F.regexp_replace(c, r'Doc \d+ \(Title: "[^"]*"\)\s*', "")), 1, 200)

    def step(s, t):
        fresh = F.aggregate(
            chunks(t["docs"]),
            F.struct(s["seen"].alias("seen"), empty.alias("kept")),
            lambda a, c: F.when(F.array_contains(a["seen"], fingerprint(c)), a).otherwise(F.struct(F.concat(a["seen"], F.array(fingerprint(c))).alias("seen"), F.concat(a["kept"], F.array(c)).alias("kept"))),
        )
        turn = F.struct(t["query"].alias("query"), F.array_join(fresh["kept"], "\n").alias("docs"))
        return F.struct(fresh["seen"].alias("seen"), F.concat(s["out"], F.array(turn)).alias("out"))

    zero = F.struct(empty.alias("seen"), F.array().cast("array<struct<query:string,docs:string>>").alias("out"))
    return F.aggregate(turns, zero, step, lambda s: s["out"])


def dedup_rubrics(texts: Column, threshold: float = 0.6) -> Column:
    """Positions kept: a text goes if it shares more than the threshold of the shorter one's words with one kept before."""
    bag = lambda t: F.array_distinct(words(F.lower(t)))

    def step(kept, i):
        mine = bag(F.get(texts, i))

        def same(k):
            other = bag(F.get(texts, k))
            least = F.least(F.size(mine), F.size(other))
            return (least > 0) & (F.size(F.array_intersect(mine, other)) / F.greatest(least, F.lit(1)) > threshold)

        return F.when(F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(i)))

    places = F.when(F.size(texts) > 0, F.sequence(F.lit(0), F.size(texts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.array().cast("array<int>"), step)


def ngrams(ws: Column, n: int) -> Column:
    count = F.size(ws) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def tokens(x: Column) -> Column:
    """Lower-case alphanumeric tokens, with a contraction's tail."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1))


def ngram_overlap(answer: Column, evidence: Column, n: int = 8) -> Column:
    """Share of the answer's n-grams, repeats counted, that the evidence has; 0 without any."""
    grams = lambda x: let(tokens(x), lambda ws: ngrams(ws, n))

    def share(mine, theirs):
        hit = F.size(F.filter(mine, lambda g: F.array_contains(theirs, g)))
        return F.when(F.size(mine) > 0, hit / F.greatest(F.size(mine), F.lit(1))).otherwise(0.0)

    return let(grams(answer), lambda mine: let(F.array_distinct(grams(evidence)), lambda theirs: share(mine, theirs)))


def token_count(x: Column) -> Column:
    """Stand-in for a model tokenizer: words and single marks."""
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1)))


def truncate_tokens(x: Column, n: int) -> Column:
    """Text up to and with its ``n``-th token; white space after it is dropped."""
    return F.array_join(F.slice(F.regexp_extract_all(x, F.lit(r"(?U)(\s*(?:\w+|[^\w\s]))"), F.lit(1)), 1, n), "")


def exact_match(answer: Column, golds: Column) -> Column:
    return F.coalesce(let(normalize_answer(answer), lambda norm: F.exists(golds, lambda g: normalize_answer(g) == norm)), F.lit(False)).cast("double")


def contains_match(answer: Column, golds: Column) -> Column:
    return F.coalesce(let(normalize_answer(answer), lambda norm: F.exists(golds, lambda g: norm.contains(normalize_answer(g)))), F.lit(False)).cast("double")


def qa_answer(x: Column) -> Column:
    """The last of two or more answer blocks (the first is the prompt's example); null with fewer."""
    found = blocks(x, "answer")
    return F.when(F.size(found) > 1, strip(last(found)))


def qa_score(x: Column, golds: Column, part: bool = False, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Score of the extracted answer; a quarter of it where more than ten answer tags open."""
    answer = qa_answer(x)
    hit = (contains_match if part else exact_match)(answer, golds) == 1.0
    many = (F.size(F.split(x, "<answer>")) - 1 > 10) | (F.size(F.split(x, "</answer>")) - 1 > 10)
    return F.when(answer.isNull(), 0.0).when(hit, F.when(many & F.lit(not part), score / 4).otherwise(score)).otherwise(format_score)


def gsm8k_answer(x: Column, strict: bool = True) -> Column:
    """The number after the last ``####``, or (flexible) the last number that is not a lone mark, in the last 300 characters."""
    tail = F.right(x, F.lit(300))
    if strict:
        found = last(F.regexp_extract_all(tail, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1)))
        return F.translate(found, ",$", "")
    numbers = F.filter(F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1)), lambda a: ~a.isin("", "."))
    return last(numbers)


def gsm8k_score(x: Column, gold: Column, strict: bool = True, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Score of an equal answer, ``format_score`` of another one, 0 without any."""
    answer = gsm8k_answer(x, strict)
    return F.when(answer.isNull(), 0.0).when(answer == gold, score).otherwise(format_score)


def boxed_number_answer(x: Column) -> Column:
    """Text after the last ``Answer:`` in the last 300 characters, to the end of its line; ``[INVALID]`` if there is none."""
    found = last(F.regexp_extract_all(F.right(x, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)))
    return F.coalesce(found, F.lit("[INVALID]"))


def lenient_json(x: Column) -> Column:
    """Text of the JSON inside a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(braces, F.lit("")))


def last_assistant(turns: Column) -> Column:
    return last(F.filter(turns, lambda t: t["role"] == "assistant"))["text"]
