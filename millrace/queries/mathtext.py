"""Mathematical answers, and their SQL: cases by row number with their worked-out results."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import mathtext as M
from millrace.functions import text as T
from millrace.sources.views import ROLLOUTS, one_of, pick, picked, r6, rollouts, table

# Response, gold, and whether they match.
CASES = [
    ("so \\boxed{\\frac12}", "\\frac{1}{2}", 1),
    ("\\boxed{1/2} then \\boxed{3}", "3", 1),
    ("\\boxed{\\sqrt{1+\\sqrt2}}", "\\sqrt{1+\\sqrt{2}}", 1),
    ("\\boxed{x=5}", "5", 1),
    ("\\boxed{5 \\text{ cm}}", "5", 1),
    ("\\fbox{0.5}", "1/2", 1),
    ("no box 7", "7", 0),
    ("\\boxed{open", "open", 0),
    ("\\boxed 8$ end", "8", 1),
    ("\\boxed{7}", "8", 0),
]
PAIRS = [("1,000", "1000", 1), ("0.5", "50%", 1), ("(1,2.00001)", "(1,2)", 1), ("(1,2]", "(1,2)", 0), ("\\frac{2}{4}", "\\frac{1}{2}", 0), ("3.14159", "3.1416", 1), ("abc", "abd", 0), ("2", "2.1", 0)]


# Solutions and the spelling that their answers have after normalisation.
SPELLINGS = [
    ("so\nAnswer: x = 5 units", "5"),
    ("Answer: \\frac12", "\\frac{1}{2}"),
    ("Answer: $\\boxed{3}$", "3"),
    ("answer : 1,234 dollars", "1234"),
    ("ANSWER: \\text{yes} ", "yes"),
    ("no final line", "[INVALID]"),
    ("Answer: 9\nAnswer: 90^\\circ", "90"),
    ("Answer: \\sqrt2", "\\sqrt{2}"),
    ("Answer: a dog", "dog"),
    ("Answer: 10\\text{ cm}", "10"),
    ("Answer: 1,2,x", "1,2,x"),
    ("Answer: 4" + " " * 300, "[INVALID]"),
]
# Texts, and the content of the box that the strict rule sees.
BOXES = [("so \\boxed{7}", "7"), ("\\boxed{7}" + "." * 95, None), ("\\boxed{1} or \\boxed{8}", "8"), ("none", None), ("\\boxed{ 7 }", " 7 "), ("\\boxed{\\frac{1}{7}}", "\\frac{1}{7}")]


def _case(cases, i):
    return F.element_at(F.array(*[F.lit(c[i]) for c in cases]), (F.pmod("row_id", F.lit(len(cases))) + 1).cast("int"))


def t16_math_boxed(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", M.math_score(_case(CASES, 0), _case(CASES, 1)).alias("score"))


def t18_tiered_equal(spark, sf_dir):
    return rollouts(spark, sf_dir).select("row_id", M.tiered_equal(_case(PAIRS, 0), _case(PAIRS, 1)).alias("equal"))


def _expressions():
    """An answer and a gold one from a document's numbers; ``d`` decides whether they are equal."""
    k, d, kind = 2 + F.col("n_chars") % 40, pick("doc_id", "off", 2), pick("doc_id", "kind", 8)
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    given = one_of_columns([text("(x+", k, ")^2"), text(k, "+y"), text(r"\frac{", k, "}{4}"), text(r"2\cdot ", k), text(r"\sqrt{", 2 * k * k, "}"), text("(x^2-", k * k, ")/(x-", k, ")"), text("(1,", k, "x)"), text(r"\frac{", k, "}{6}")], kind)
    cents = F.lpad((k % 4 * 25).cast("string"), 2, "0")
    gold = one_of_columns([text("x^2+", 2 * k, "x+", k * k + d), text("y+", k + d), F.concat((F.floor(k / 4) + d).cast("string"), F.lit("."), cents), text(2 * k + d), text(k + d, r"\sqrt2"), text("x+", k + d), text("(1,", "x*", k + d, ")"), text(r"\frac{", 2 * k, "}{", 12 + d, "}")], kind)
    return given, gold


def one_of_columns(values, at):
    return F.get(F.array(*values), at)


def t18_symbolic(spark, sf_dir):
    """Lenient and strict equality of expressions made from a document's numbers."""
    given, gold = _expressions()
    return table(spark, sf_dir, "documents").select("doc_id", given.alias("x"), gold.alias("gold")).select("doc_id", M.tiered_equal(F.col("x"), F.col("gold")).alias("close"), M.graded_equal(F.col("x"), F.col("gold")).alias("strict"))


def x18_answer_tests(spark, sf_dir):
    """Tests of a document's numbers as whole numbers, fractions, intervals and tuples."""
    n, kind = F.col("n_chars"), pick("doc_id", "shape", 5)
    x = one_of_columns([F.format_number(n, 0), F.concat(n, F.lit(".50")), F.concat(F.lit("-"), n, F.lit("/7")), F.concat(F.lit("Interval.Lopen("), n, F.lit(", 9)")), F.concat(F.lit("(a, "), n, F.lit("]"))], kind)
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", M.is_whole(F.col("x")).alias("whole"), M.is_fraction(F.col("x")).alias("fraction"), M.interval(F.col("x")).alias("spelled"), F.array_join(M.parts_of(M.interval(F.col("x"))), "|").alias("parts"))


def t19_geometry(spark, sf_dir):
    x = F.when(F.col("row_id") % 2 == 0, F.lit("<think>t</think> \\boxed{4}")).otherwise(F.lit("\\boxed{4}"))
    return rollouts(spark, sf_dir).select("row_id", r6(M.geometry_score(x, F.when(F.col("row_id") % 3 == 0, "5").otherwise("4"))).alias("score"))


def t20_pass_ratio(spark, sf_dir):
    flags = F.transform(F.sequence(F.lit(1), F.pmod("row_id", F.lit(14)).cast("int") + 1), lambda i: i % 3 == 0)
    return rollouts(spark, sf_dir).select("row_id", r6(M.pass_ratio(flags)).alias("ratio"))


def t17_dapo(spark, sf_dir):
    """Spelling of the answer and its mark beside a gold answer drawn from all spellings."""
    x = one_of([c[0] for c in SPELLINGS], pick("row_id", "says", len(SPELLINGS)))
    gold = one_of([c[1] for c in SPELLINGS], pick("row_id", "gold", len(SPELLINGS)))
    return rollouts(spark, sf_dir).select("row_id", M.dapo_normal(T.boxed_number_answer(x)).alias("spelling"), M.dapo_score(x, gold).alias("score"))


def x17_strict_box(spark, sf_dir):
    x = one_of([c[0] for c in BOXES], pick("row_id", "box", len(BOXES)))
    return rollouts(spark, sf_dir).select("row_id", M.strict_box_score(x, one_of(["7", "8"], pick("row_id", "want", 2))).alias("score"))


def x18_mixed_numbers(spark, sf_dir):
    """Numbers of a document's words written as mixed ones."""
    x = F.concat(F.col("n_chars").cast("string"), F.lit("  "), pick("doc_id", "n", 9).cast("string"), F.lit("/7 and 3 "), one_of(["x", "1/2", "+4", " 5 6"], pick("doc_id", "tail", 4)))
    return table(spark, sf_dir, "documents").select("doc_id", M.mixed_numbers(x).alias("x"))


QUERIES = {k: v for k, v in globals().items() if k[:1] in "tx" and k[1:2].isdigit() and callable(v)}

def _stated(cases, i, salt):
    return "([" + ", ".join("NULL" if c[i] is None else "'" + c[i].replace("'", "''") + "'" for c in cases) + f"])[{picked('row_id', salt, len(cases))} + 1]"


SQL = {
    "t18_symbolic": f"WITH e AS (SELECT doc_id, 2 + n_chars % 40 AS k, {picked('doc_id', 'off', 2)} = 0 AS same, {picked('doc_id', 'kind', 8)} AS kind FROM documents) SELECT doc_id, CASE WHEN kind = 7 THEN same AND false ELSE same END AS close, same AND CASE kind WHEN 2 THEN k % 4 <> 0 WHEN 3 THEN false WHEN 7 THEN false ELSE true END AS strict FROM e",
    "x18_answer_tests": f"WITH e AS (SELECT doc_id, n_chars AS n, {picked('doc_id', 'shape', 5)} AS kind FROM documents) SELECT doc_id, kind = 0 AS whole, kind = 2 AS fraction, CASE kind WHEN 0 THEN format('{{:,}}', n) WHEN 1 THEN n || '.50' WHEN 2 THEN '-' || n || '/7' WHEN 3 THEN '(' || n || ', 9]' ELSE '(a, ' || n || ']' END AS spelled, CASE kind WHEN 0 THEN n::VARCHAR WHEN 1 THEN n || '.50' WHEN 2 THEN '-' || n || '/7' WHEN 3 THEN n || '|9' ELSE 'a|' || n END AS parts FROM e",
    "t17_dapo": f"WITH {ROLLOUTS}, a AS (SELECT row_id, {_stated(SPELLINGS, 1, 'says')} AS spelling, {_stated(SPELLINGS, 1, 'gold')} AS gold FROM r) SELECT row_id, spelling, CASE WHEN spelling = gold THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM a",
    "x17_strict_box": f"WITH {ROLLOUTS} SELECT row_id, CASE WHEN {_stated(BOXES, 1, 'box')} = (['7', '8'])[{picked('row_id', 'want', 2)} + 1] THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM r",
    "x18_mixed_numbers": f"SELECT doc_id, n_chars || '+' || {picked('doc_id', 'n', 9)} || (['/7 and 3 x', '/7 and 3+1/2', '/7 and 3 +4', '/7 and 3+5 6'])[{picked('doc_id', 'tail', 4)} + 1] AS x FROM documents",
    "t16_math_boxed": f"WITH {ROLLOUTS} SELECT row_id, ({[c[2] for c in CASES]})[row_id % {len(CASES)} + 1]::DOUBLE AS score FROM r",
    "t18_tiered_equal": f"WITH {ROLLOUTS} SELECT row_id, ({[c[2] for c in PAIRS]})[row_id % {len(PAIRS)} + 1] = 1 AS equal FROM r",
    "t19_geometry": f"WITH {ROLLOUTS} SELECT row_id, round(CASE WHEN row_id % 3 = 0 THEN 0.0 ELSE 0.9 END + CASE WHEN row_id % 2 = 0 THEN 0.1 ELSE 0.0 END, 6)::DOUBLE AS score FROM r",
    "t20_pass_ratio": f"WITH {ROLLOUTS} SELECT row_id, round((least(row_id % 14 + 1, 10) // 3)::DOUBLE / least(row_id % 14 + 1, 10), 6) + 0.0 AS ratio FROM r",
}
