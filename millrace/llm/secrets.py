"""Secret scan: fixed patterns plus sliding-window Shannon entropy.

Everything is a column expression.  Positions come from one pass of an
anchored pattern over the whole text: each hit yields the gap before it and
the match, and lengths in code points add up to offsets.

Entropy: candidate strings are runs of token characters with a digit and a
letter.  A window of ``window`` characters slides over each; its character
counts and the sum of ``c*log2(c)`` are updated by one character in and one
out, so every window costs the same.  Runs of hexadecimal digits and other
runs have thresholds of their own.  From the first to the last window over
the threshold is one span, unless an allow-list pattern matches the run or a
fixed-pattern span touches it.

Null is an empty text; a text without hits has empty spans.  Repeated rows
each get a result, and an empty table none; other columns are ignored.  Time
grows in proportion to a text and its hits, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of fewer can hold none of 16, so this equals filtering whole runs

MIN_ASSIGN_VALUE = 12
MIN_ACCESS = 18
ALPHABETS = {"entropy_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "entropy_hex": "0123456789abcdefABCDEF"}
THRESHOLDS = {"entropy_base64": 3.6, "entropy_hex": 2.9}
#: Places that one fold adds up.
BLOCK = 128
KINDS = ["assign", "access", "hex", "entropy_base64", "entropy_hex"]
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0123456789|abcdefgh",
    r"^(/[A-Za-z0-9_-]+)+/?$",  # paths
)


def _let(x: Column, f) -> Column:
    """``f`` of an expression that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(values: Column, op) -> Column:
    """Running results of ``op`` over an array of numbers, of non-negative ones for ``F.greatest`` and ``+``.

    A fold copies what it has so far in every step, so it runs inside blocks
    of ``BLOCK`` and once over the blocks.
    """
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("last"), none.alias("out"))

    def step(acc, x):
        now = op(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    def before(acc, w):
        return F.struct(op(acc["last"], F.get(w, F.size(w) - 1)).alias("last"), F.concat(acc["out"], F.array(acc["last"])).alias("out"))

    def blocks(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), zero, step, lambda acc: acc["out"]))

    def joined(w):
        return F.flatten(F.zip_with(w, F.aggregate(w, zero, before, lambda acc: acc["out"]), lambda part, base: F.transform(part, lambda x: op(base, x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), joined)).otherwise(none))


def _hits(text: Column, pattern: str, keep=None) -> Column:
    """Spans ``(start, end, value)`` of all leftmost non-overlapping matches; ``keep`` filters on the match."""
    full = r"(?s)\G(.*?)(" + pattern + ")"
    group = lambda k: F.regexp_extract_all(text, F.lit(full), F.lit(k))
    value = group(4) if "(" in pattern.replace("(?i:", "") else group(2)
    hits = F.arrays_zip(F.transform(group(1), F.length).alias("gap"), F.transform(group(2), F.length).alias("size"), value.alias("value"))

    def placed(h):
        ends = _running(F.transform(h, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return _let(ends, lambda e: F.transform(h, lambda x, k: F.struct((F.get(e, k) - x["size"]).alias("start"), F.get(e, k).alias("end"), x["value"].alias("value"))))

    spans = _let(hits, placed)
    spans = F.filter(spans, keep) if keep else spans
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _touched(start: Column, end: Column) -> Column:
    """Whether a span of ``base``, which is in order of start, overlaps ``[start, end)``: a binary search for the last that starts before the end."""

    def halve(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        left = F.get(F.col("base"), middle)["start"] < end
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & left, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~left, middle).otherwise(acc["hi"]).alias("hi"))

    steps = F.ceil(F.log2(F.size("base") + 1.0)).cast("int") + 1
    below = F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(0).alias("lo"), F.size("base").alias("hi")), halve, lambda acc: acc["lo"])
    return F.coalesce(_let(below, lambda n: F.get("reach", n - 1) > start), F.lit(False))


def _windows(run: Column, kind: str, window: int) -> Column:
    """``(first, last)`` start of the windows over the threshold; ``first`` is -1 if there is none."""
    alphabet = ALPHABETS[kind]
    sums = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    most = F.lit(window * (math.log2(window) - THRESHOLDS[kind]))  # entropy >= threshold, as a bound on the sum
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    # The codes travel in the state: an expression outside it would be computed again in every step.
    empty = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc, i):
        in_ = F.get(acc["codes"], i)
        out = F.when(i >= window, F.get(acc["codes"], i - window)).otherwise(F.lit(-1))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == in_, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
        a, o = F.get(acc["counts"], in_), F.get(acc["counts"], out)
        moved = F.when(in_ == out, F.lit(0.0)).otherwise(F.get(sums, a + 1) - F.get(sums, a) + F.when(out >= 0, F.get(sums, o - 1) - F.get(sums, o)).otherwise(F.lit(0.0)))
        s = acc["s"] + moved
        hit = (i >= window - 1) & (s <= most + 1e-9)
        start = i - (window - 1)
        return F.struct(
            acc["codes"].alias("codes"),
            counts.alias("counts"),
            s.alias("s"),
            F.when(hit & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"),
            F.when(hit, start).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), empty, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column, kind: str, window: int, allow) -> Column:
    runs = _hits(text, r"[A-Za-z0-9+/_=-]{%d,}" % window)
    is_hex = lambda r: r["value"].rlike("^[0-9a-fA-F]+$")

    def candidate(r):
        ok = r["value"].rlike("[0-9]") & r["value"].rlike("[A-Za-z]") & (is_hex(r) if kind == "entropy_hex" else ~is_hex(r))
        for pattern in allow:
            ok = ok & ~r["value"].rlike(pattern)
        return ok & ~_touched(r["start"], r["end"])

    found = F.transform(F.filter(runs, candidate), lambda r: F.struct(r["start"].alias("at"), _windows(r["value"], kind, window).alias("w")))
    found = F.filter(found, lambda x: x["w"]["first"] >= 0)
    return F.transform(found, lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), (x["at"] + x["w"]["last"] + window).alias("end"), F.lit("").alias("value")))


def _tag(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, window: int = 20, allow: tuple[str, ...] = ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, base, found)``: ``base`` and ``found`` hold ``(start, rank, end, kind)`` in order of start and kind."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", _hits(text, ASSIGN, lambda s: F.length(s["value"]) >= MIN_ASSIGN_VALUE).alias("assign"), _hits(text, ACCESS, lambda s: s["end"] - s["start"] >= MIN_ACCESS).alias("access"), _hits(text, HEX).alias("hex"))
    rows = rows.select("doc_id", "text", F.array_sort(F.concat(*[_tag(F.col(k), k) for k in KINDS[:3]])).alias("base"))
    # How far the spans up to each one reach.
    rows = rows.withColumn("reach", _running(F.transform("base", lambda b: b["end"]), F.greatest))
    likely = text.rlike(r"[A-Za-z0-9+/_=-]{%d,}" % window) & text.rlike("[0-9]")
    added = [F.when(likely, _tag(_entropy_spans(text, k, window, allow), k)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")) for k in KINDS[3:]]
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", *added)).alias("found"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``scan_secrets`` finds."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return scan_secrets(docs).select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
