"""Mathematical answers compared as strings and numbers.

Only brace matching and the algebra of what strings and numbers leave open need
code outside the engine; they run on Arrow batches.
Model text is never evaluated.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from millrace.functions import algebra
from millrace.functions import text as T

# What the comparison of answers removes or rewrites before anything else, in this order.
REWRITES = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
# Rewritten after units are cut off.
LATER = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def boxed_content(text: str | None) -> str | None:
    """Inside of the last ``\\boxed{..}`` (or ``\\fbox{..}``) with balanced braces; ``\\boxed x`` reads to the next dollar sign."""
    if text is None:
        return None
    spaced = text.rpartition("\\boxed ")
    if spaced[1]:
        return spaced[2].partition("$")[0]
    start = max(text.rfind("\\boxed"), -1)
    start = start if start >= 0 else text.rfind("\\fbox")
    if start < 0:
        return None
    depth, opened = 0, None
    for at in range(start, len(text)):
        if text[at] == "{":
            depth += 1
            opened = at if opened is None else opened
        elif text[at] == "}":
            depth -= 1
            if depth == 0 and opened is not None:
                return text[opened + 1 : at]
    return None


@F.pandas_udf(StringType())
def boxed(texts: pd.Series) -> pd.Series:
    return texts.map(boxed_content, na_action="ignore")


def _literal(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def canonical(x: Column) -> Column:
    """One spelling of an answer: units, spaces, short left-hand sides and bare roots and fractions normalised."""
    x = _literal(x, REWRITES)
    x = _literal(F.substring_index(x, "\\text{ ", 1), LATER)
    x = F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x)
    x = F.when(x.rlike(r"(?s)\A[^=]{0,2}=[^=]*\z"), F.substring_index(x, "=", -1)).otherwise(x)
    x = F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{])\{", r"\\frac{$1}{")
    x = F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x)
    return F.regexp_replace(x, r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def equivalent(a: Column, b: Column) -> Column:
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def math_score(response: Column, gold: Column) -> Column:
    """1 if the boxed answer equals the gold one."""
    return F.coalesce(equivalent(boxed(response), gold), F.lit(False)).cast("double")


def number(x: Column) -> Column:
    """A plain number, with thousands separators or a percent sign; null otherwise."""
    plain = F.regexp_replace(F.trim(x), r"(?<=[0-9]),(?=[0-9]{3})|[$%]", "")
    return F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def numerically_equal(x: Column, reference: Column, tolerance: float = 1e-4) -> Column:
    """Equal within a relative tolerance to the reference, a hundredth or a hundredfold of it."""
    a, b = number(x), number(reference)
    close = lambda c: F.abs(a - c) <= tolerance * F.greatest(F.abs(a), F.abs(c))
    return F.coalesce(close(b / 100) | close(b) | close(b * 100), F.lit(False))


def is_whole(x: Column) -> Column:
    """Whether a text is a whole number, with thousands separators or zero decimals."""
    n = F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.abs(n - F.round(n)) <= 1e-7, F.lit(False))


def is_fraction(x: Column) -> Column:
    """Whether a text is a fraction of two whole numbers, in a line or in TeX."""
    return F.coalesce(x.rlike(r"^-?[0-9]+/0*[1-9][0-9]*$|^-?\\[dt]?frac\{-?[0-9]+\}\{0*[1-9][0-9]*\}$"), F.lit(False))


def interval(x: Column) -> Column:
    """Named intervals in brackets: ``Interval.open(1, 2)`` is ``(1, 2)``."""
    for name, left, right in (("Interval", "[", "]"), (r"Interval\.Ropen", "[", ")"), (r"Interval\.Lopen", "(", "]"), (r"Interval\.open", "(", ")")):
        x = F.regexp_replace(x, rf"(?s)^{name}\((.*)\)$", rf"{left}$1{right}")
    return x


def parts_of(x: Column) -> Column:
    """Parts of a tuple or interval, trimmed; any other text is its one part, thousands separators not counting as commas."""
    whole = F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9]{3}($|[^0-9]))", "")
    split = F.transform(F.split(F.substring(whole, 2, 2**31 - 1), ","), lambda p: F.trim(F.regexp_replace(p, r"[\)\]]$", "")))
    return F.when(whole.rlike(r"(?s)^[\(\[][^\(\)\[\]]+[\)\]]$"), split).otherwise(F.array(whole))


_FRACTION = re.compile(r"-?\d+/0*[1-9]\d*|-?\\[dt]?frac\{-?\d+\}\{0*[1-9]\d*\}")
_TUPLE = re.compile(r"[(\[][^()\[\]]+[)\]]", re.S)
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")


def _plain(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None


def _same_part(x: str, y: str, strict: bool) -> bool:
    if x == y or (_FRACTION.fullmatch(x) and _FRACTION.fullmatch(y)):
        return x == y
    u, v = _plain(x), _plain(y)
    if strict:
        whole = [n is not None and abs(n - round(n)) <= 1e-7 if n is None or abs(n) < 1e15 else False for n in (u, v)]
        if all(whole) or whole[0] != whole[1]:
            return all(whole) and round(u) == round(v)
        return len(algebra.names(x) | algebra.names(y)) <= 2 and algebra.equal(x, y)  # text of more letters is not an expression
    if algebra.equal(x, y):
        return True
    u, v = algebra.value(x) if u is None else u, algebra.value(y) if v is None else v
    return u is not None and v is not None and any(math.isclose(u, v * f, rel_tol=1e-4) for f in ((0.01, 1, 100) if _plain(x) is not None and _plain(y) is not None else (1,)))


def _same_parts(x: str, y: str, strict: bool) -> bool:
    """Answers of one shape whose parts, those of tuples and intervals, are each equal."""
    x, y = _THOUSANDS.sub("", x), _THOUSANDS.sub("", y)
    p, q = ([e.strip() for e in v[1:-1].split(",")] if _TUPLE.fullmatch(v) else [v] for v in (x, y))
    if len(p) != len(q) or (len(p) > 1 and (x[0], x[-1]) != (y[0], y[-1])):
        return False
    return all(_same_part(a, b, strict) for a, b in zip(p, q, strict=True))


@F.pandas_udf(BooleanType())
def _parts_equal(a: pd.Series, b: pd.Series, strict: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and _same_parts(x, y, s) for x, y, s in zip(a, b, strict, strict=True)], dtype=bool)


def _by_parts(a: Column, b: Column, settled: Column, strict: bool) -> Column:
    """Whether answers are equal by ``settled``, or else by their parts; the helper sees only what is still open."""
    open_ = ~F.coalesce(settled, F.lit(False))
    return F.coalesce(settled, F.lit(False)) | _parts_equal(F.when(open_, a), F.when(open_, b), F.lit(strict))


def tiered_equal(x: Column, reference: Column) -> Column:
    """Lenient tiers: one spelling, or numbers within a tolerance; then, by parts of tuples and intervals, numbers and expressions; of two fractions only those written alike are equal."""
    a, b = canonical(interval(x)), canonical(interval(reference))
    return _by_parts(a, b, (a == b) | numerically_equal(x, reference), strict=False)


def graded_equal(x: Column, reference: Column) -> Column:
    """Strict tiers: one spelling; then, by parts, fractions as written, whole numbers equal to whole numbers only, and expressions of at most two letters that are exactly equal."""
    a, b = F.lower(canonical(x)), F.lower(canonical(reference))
    return _by_parts(a, b, a == b, strict=True)


def geometry_score(response: Column, gold: Column) -> Column:
    """0.9 for the answer, 0.1 for thinking first and boxing it."""
    shaped = response.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")
    return 0.9 * math_score(response, gold) + 0.1 * shaped.cast("double")


def pass_ratio(flags: Column, most: int = 10) -> Column:
    """Share of recorded test outcomes that passed, over the first ones; code is never run here."""
    first = F.slice(flags, 1, most)
    return F.when(F.size(first) > 0, F.aggregate(first, F.lit(0.0), lambda s, f: s + f.cast("double")) / F.greatest(F.size(first), F.lit(1))).otherwise(0.0)


# What a competition answer loses before comparison, in this order.
DAPO_REWRITES = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
# Units and marks that are removed, in this order.
DAPO_REMOVED = ["square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots"]


def dapo_normal(x: Column) -> Column:
    """One spelling of a competition answer: right-hand side, without units, marks and text macros, short TeX written out, thousands joined."""
    x = _literal(F.substring_index(x, "=", -1), DAPO_REWRITES)
    x = _literal(x, [(w, "") for w in DAPO_REMOVED])
    x = F.regexp_replace(x, r"(?:.*?)\$(.*?)\$(?:.*)", r"\$$1\$")
    for macro in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, r"\\" + macro + r"\{(.*?)\}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, r"frac([^{])(.)", "frac{$1}{$2}")
    x = F.replace(F.regexp_replace(x, r"sqrt([^{])", "sqrt{$1}"), F.lit("$"), F.lit(""))
    whole = F.replace(x, F.lit(","), F.lit(""))
    return T.strip(F.when(whole.rlike(r"\A[0-9]+\z"), whole).otherwise(x))


def dapo_score(x: Column, gold: Column) -> Column:
    """1 if the last answer line of the final 300 characters and the gold answer have one spelling, else -1."""
    return F.when(dapo_normal(T.boxed_number_answer(x)) == dapo_normal(gold), 1.0).otherwise(-1.0)


def strict_box_score(x: Column, gold: Column) -> Column:
    """1 if the last box of the final 100 characters holds exactly the gold answer, else -1."""
    return F.when(F.coalesce(boxed(F.right(x, F.lit(100))) == gold, F.lit(False)), 1.0).otherwise(-1.0)


def mixed_numbers(x: Column) -> Column:
    """A whole number written before a fraction becomes a sum: ``3 1/2`` is ``3+1/2``."""
    return F.regexp_replace(x, r"([0-9]) +([0-9])", "$1+$2")
