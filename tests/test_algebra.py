"""Exact equality of expressions: stated pairs, random identities, limits."""

import random
from fractions import Fraction

import pytest

from millrace.functions import algebra as A

EQUAL = [
    ("x+1", "1+x"), ("2^3", "8"), (r"2\cdot 3", "6"), ("(x+1)^2", "x^2+2x+1"), (r"\frac{3}{4}", "0.75"), (r"\frac34", ".75"), (r"\sqrt{8}", r"2\sqrt2"),
    (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}"), (r"\sqrt[3]{16}", r"2\sqrt[3]{2}"), ("(x^2-1)/(x-1)", "x+1"), (r"3\frac{1}{2}", "7/2"), ("-3 1/2", "-3.5"), ("1,000x", "x*10^3"), (r"\sqrt{-4}", "2i"),
    ("2**3", "8"), ("4!", "24"), (r"\pi r^2", r"r^{2}\pi"), ("sin(x+1)", r"\sin(1+x)"), (r"(1+\sqrt2)(1-\sqrt{2})", "-1"), (r"\sqrt{x+1}^2", "1+x"), ("2^{-1}", "1/2"), ("2^x", "2^{x}"), (r"\left(x\right)", "x"), ("-x^2", "-(x^2)"), ("a/b/c", "a/(b*c)"), (r"\frac{1}{x}+\frac{1}{y}", r"\frac{x+y}{xy_1}".replace("xy_1", "x*y")), ("i^2", "-1"), ("8^{2/3}", "4"), ("0x", "0"),
]
UNEQUAL = [("x+1", "x+2"), ("(x+1)^2", "x^2+1"), ("ab", "ba"), ("no", "on"), (r"\sqrt2", "1.41421356"), ("x", "y"), ("1/0", "1/0"), ("", ""), ("2 3", "6"), ("x+", "x"), (r"\pm 1", r"\pm 1"), ("(x", "x"), ("2^1000", "2^1000"), ("__import__('os')", "0"), ("x" * 500, "x" * 500), ("(" * 60 + "1" + ")" * 60, "1"), ("(a+b+c+d+f)^40", "0"), ("sqrt(x^2)", "x")]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal(a, b):
    assert A.equal(a, b) and A.equal(b, a)


@pytest.mark.parametrize(("a", "b"), UNEQUAL)
def test_unequal_or_unreadable(a, b):
    assert not A.equal(a, b)


def test_random_expressions_against_exact_values():
    """Sums, products and quotients of x agree with their value at many points, exactly when they are equal."""
    rng = random.Random(1)

    def make(depth):
        if depth == 0:
            return rng.choice([("x", lambda x: x), *[(str(k), lambda x, k=k: Fraction(k)) for k in range(1, 5)]])
        (a, f), (b, g) = make(depth - 1), make(depth - 1)
        op = rng.choice("+-*/^")
        if op == "^":
            k = rng.randint(0, 3)
            return f"({a})^{{{k}}}", lambda x: f(x) ** k
        text = rf"\frac{{{a}}}{{{b}}}" if op == "/" else f"({a}){rng.choice([op, op + ' '])}({b})" if op != "*" or rng.random() < 0.5 else f"({a})({b})"
        return text, {"+": lambda x: f(x) + g(x), "-": lambda x: f(x) - g(x), "*": lambda x: f(x) * g(x), "/": lambda x: f(x) / g(x)}[op]

    checked = 0
    for _ in range(400):
        (a, f), (b, g) = make(rng.randint(0, 3)), make(rng.randint(0, 3))
        points = [Fraction(k, 7) for k in range(11, 90, 2)]
        try:
            want = all(f(p) == g(p) for p in points)
        except ZeroDivisionError:
            continue
        if A.read(a) and A.read(b):
            assert A.equal(a, b) == want, (a, b)
            checked += 1
    assert checked > 200


def test_values():
    assert A.value(r"2\pi") == pytest.approx(6.2831853)
    assert A.value(r"\frac{\sqrt{3}}{2}") == pytest.approx(0.8660254)
    assert A.value("x+1") is None and A.value("\\") is None


# Answer, gold, and whether the lenient and the strict tiers call them equal.
ANSWERS = [
    (r"\frac{3}{4}", "0.75", 1, 1), ("x+1", "1+x", 1, 1), ("2^3", "8", 1, 0), (r"2\cdot 3", "6", 1, 0), ("(x+1)^2", "x^2+2x+1", 1, 1), (r"\frac{2}{4}", r"\frac{1}{2}", 0, 0), ("0.5", "50%", 1, 0),
    ("(1,2.00001)", "(1,2)", 1, 0), ("(1,2]", "(1,2)", 0, 0), ("3.14159", "3.1416", 1, 0), ("abc", "abd", 0, 0), ("2", "2.1", 0, 0), ("1,000", "1000", 1, 1), ("(1,x+2)", "(1.0, 2+x)", 1, 1), ("Interval.open(1,2)", "(1,2)", 1, 0),
    ("5.0", "5", 1, 1), (r"\sqrt{2}", "1.41421356", 1, 0), ("abcd+x", "x+abcd", 1, 0), (None, "1", 0, 0), ("", "1", 0, 0), ("1", None, 0, 0), (r"\frac{1}{2}", "2/4", 0, 0), ("[1,2,3]", "[1,2]", 0, 0),
]


def test_tiers(spark):
    from pyspark.sql import functions as F

    from millrace.functions import mathtext as M

    df = spark.createDataFrame(ANSWERS, "x string, gold string, close int, strict int")
    got = df.select("x", "gold", M.tiered_equal(F.col("x"), F.col("gold")).cast("int"), M.graded_equal(F.col("x"), F.col("gold")).cast("int")).collect()
    assert list(map(tuple, got)) == ANSWERS
