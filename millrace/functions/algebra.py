"""Exact equality of short mathematical expressions, plain or TeX.

An expression is read into a quotient of two polynomials with rational
coefficients.  Their atoms are letters, primes under a root (``8^{1/2}`` is
``2*2^{1/2}``, so roots of numbers have one form), the imaginary unit, and
opaque values such as roots and functions of something that is not a number.
Two expressions are equal if the cross product of their quotients is zero.

Text is only ever read by the grammar below, never evaluated.  Limits, beyond
which an expression counts as unreadable: ``MAX_CHARS`` characters,
``MAX_DEPTH`` nested parts, ``MAX_TERMS`` terms, powers up to ``MAX_POWER``,
numbers of ``MAX_BITS`` bits.  A run of letters is one name.  Not known:
identities of functions, powers of letters to powers, and cancelling of common
factors inside an opaque value.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import lru_cache

MAX_CHARS, MAX_DEPTH, MAX_TERMS, MAX_POWER, MAX_BITS = 400, 40, 300, 64, 2048
#: Numbers under a root are split into primes up to this size.
MAX_ROOT = 1 << 40
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "ln", "log", "exp")

Poly = dict  # of monomials, sorted tuples of (atom, exponent), to coefficients
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|\\([a-zA-Z]+)|([a-zA-Z]+(?:_(?:\{\w+\}|\w))?)|(.))", re.S)
_SAME = {"cdot": "*", "times": "*", "div": "/", "lbrace": "{", "rbrace": "}", "dfrac": "frac", "tfrac": "frac"}


class Unreadable(ValueError):
    """Not an expression of this grammar, or beyond its limits."""


def _number(c) -> Poly:
    return {(): Fraction(c)} if c else {}


def _add(a: Poly, b: Poly, sign: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, 0) + sign * c
        if not out[m]:
            del out[m]
    return _checked(out)


def _checked(p: Poly) -> Poly:
    if len(p) > MAX_TERMS or any(max(c.numerator.bit_length(), c.denominator.bit_length()) > MAX_BITS for c in p.values()):
        raise Unreadable
    return p


def _monomial(powers: dict) -> Poly:
    """A product of atoms with whole powers of primes, of the imaginary unit and of roots taken out."""
    factor, rest, roots = Fraction(1), {}, []
    for atom, e in powers.items():
        if atom[0] == "prime":
            whole = math.floor(e)
            factor *= Fraction(atom[1]) ** whole
            e -= whole
        elif atom[0] == "i":
            factor *= -1 if e % 4 >= 2 else 1
            e %= 2
        elif atom[0] == "root" and e >= atom[1]:
            roots.append((dict(atom[2]), e // atom[1]))
            e %= atom[1]
        if e:
            if abs(e) > MAX_POWER:
                raise Unreadable
            rest[atom] = e
    out = {tuple(sorted(rest.items(), key=repr)): factor}
    for inside, times in roots:
        for _ in range(times):
            out = _mul(out, inside)
    return out


def _mul(a: Poly, b: Poly) -> Poly:
    if len(a) * len(b) > MAX_TERMS * 10:
        raise Unreadable
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for atom, e in n:
                powers[atom] = powers.get(atom, 0) + e
            for k, f in _monomial(powers).items():
                out[k] = out.get(k, 0) + c * d * f
    return _checked({m: c for m, c in out.items() if c})


class Quotient:
    """A value ``top / under``; ``under`` is never the zero polynomial."""

    def __init__(self, top: Poly, under: Poly | None = None):
        under = _number(1) if under is None else under
        if not under:
            raise Unreadable
        if len(under) == 1:  # a single term moves to the other side
            ((m, c),) = under.items()
            top, under = _mul(top, {m2: f / c for m2, f in _monomial({a: -e for a, e in m if a[0] in ("prime", "i")}).items()}), {tuple(x for x in m if x[0][0] not in ("prime", "i")): Fraction(1)}
        self.top, self.under = top, under

    def __add__(self, o, sign=1):
        if self.under == o.under:
            return Quotient(_add(self.top, o.top, sign), self.under)
        return Quotient(_add(_mul(self.top, o.under), _mul(o.top, self.under), sign), _mul(self.under, o.under))

    def __sub__(self, o):
        return self.__add__(o, -1)

    def __mul__(self, o):
        return Quotient(_mul(self.top, o.top), _mul(self.under, o.under))

    def __truediv__(self, o):
        return Quotient(_mul(self.top, o.under), _mul(self.under, o.top))

    def constant(self) -> Fraction | None:
        """Its value if that is a rational number."""
        if self.under == {(): 1} and set(self.top) <= {()}:
            return self.top.get((), Fraction(0))
        return None

    def key(self) -> tuple:
        return tuple(sorted(self.top.items(), key=repr)), tuple(sorted(self.under.items(), key=repr))

    def power(self, e: Quotient) -> Quotient:
        n = e.constant()
        if n is None:
            return opaque("pow", self.key(), e.key())
        if abs(n) > MAX_POWER:
            raise Unreadable
        if n < 0:
            return Quotient(_number(1)) / self.power(Quotient(_number(-n)))
        if n.denominator > 1:
            return self.root(n.denominator).power(Quotient(_number(n.numerator)))
        out = Quotient(_number(1))
        for _ in range(n.numerator):
            out = out * self
        return out

    def root(self, q: int) -> Quotient:
        c = self.constant()
        if c is None:
            if self.under == {(): 1}:
                return Quotient(_monomial({("root", q, tuple(sorted(self.top.items(), key=repr))): 1}))
            return Quotient(self.top).root(q) / Quotient(self.under).root(q)
        if not c:
            return self
        if c < 0 and q != 2:
            raise Unreadable
        powers = {("i",): 1} if c < 0 else {}
        for p, e in [*primes(abs(c.numerator)), *((p, -e) for p, e in primes(c.denominator))]:
            powers["prime", p] = Fraction(e, q)
        return Quotient(_monomial(powers))


def opaque(*what) -> Quotient:
    return Quotient({((what, 1),): Fraction(1)})


def primes(n: int) -> list[tuple[int, int]]:
    if n > MAX_ROOT:
        raise Unreadable
    out, p = [], 2
    while p * p <= n:
        e = 0
        while n % p == 0:
            n, e = n // p, e + 1
        if e:
            out.append((p, e))
        p += 1 if p == 2 else 2
    return out + [(n, 1)] * (n > 1)


class _Reader:
    """Recursive descent over tokens: sums, products with implied signs, powers, atoms."""

    def __init__(self, text: str):
        self.tokens = [_SAME.get(t, t) for t in self._split(text)]
        self.at = self.depth = 0

    @staticmethod
    def _split(text: str):
        text = re.sub(r"(?<![\d.])(\d+)\s*\\[dt]?frac\s*\{(\d+)\}\s*\{(\d+)\}", r"(\1+\2/\3)", text)  # mixed numbers
        text = re.sub(r"(?<![\d.])(\d+)\s+(\d+)/(\d+)", r"(\1+\2/\3)", text)
        text = re.sub(r"\\(?:left|right|displaystyle|[,;:! ])|(?<=\d),(?=\d{3}(?!\d))|\$", "", text)
        for m in _TOKEN.finditer(text.strip()):
            yield m[1] or m[2] or m[3] or m[4]

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if not t or (wanted and t != wanted):
            raise Unreadable
        self.at += 1
        return t

    def whole(self) -> Quotient:
        out = self.sum()
        if self.peek():
            raise Unreadable
        return out

    def sum(self) -> Quotient:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Unreadable
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        self.depth -= 1
        return out

    def product(self) -> Quotient:
        if self.peek() in ("+", "-"):
            sign, part = self.take(), self.product()
            return part if sign == "+" else Quotient({}) - part
        out = self.factor()
        while t := self.peek():
            if t in "*/":
                if self.take() == "*" and self.peek() == "*":  # two stars are a power
                    raise Unreadable
                signed = self.peek() == "-" and self.take()
                part = Quotient({}) - self.factor() if signed else self.factor()
                out = out * part if t == "*" else out / part
            elif t[0].isalpha() or t in "({":
                out = out * self.factor()
            else:
                break
        return out

    def factor(self) -> Quotient:
        out = self.atom()
        while self.peek() == "!":
            self.take()
            n = out.constant()
            if n is None or n.denominator > 1 or not 0 <= n <= 100:
                raise Unreadable
            out = Quotient(_number(math.factorial(int(n))))
        if self.peek() == "^" or self.tokens[self.at : self.at + 2] == ["*", "*"]:
            self.at += 1 if self.peek() == "^" else 2
            signed = self.peek() == "-" and self.take()
            e = self.factor()
            out = out.power(Quotient({}) - e if signed else e)
        return out

    def group(self) -> Quotient:
        close = {"(": ")", "{": "}", "[": "]"}[self.take()]
        out = self.sum()
        self.take(close)
        return out

    def short(self) -> Quotient:
        """An argument in braces, or the single digit or name after a command."""
        t = self.peek()
        if t == "{":
            return self.group()
        if t[:1].isdigit() and len(t) > 1:
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.atom()

    def atom(self) -> Quotient:
        t = self.peek()
        if t in ("(", "{"):
            return self.group()
        self.take()
        if t[:1].isdigit() or t[:1] == ".":
            return Quotient(_checked(_number(Fraction(t.rstrip(".")))))
        if t == "frac":
            return self.short() / self.short()
        if t == "sqrt":
            q = self.group().constant() if self.peek() == "[" else Fraction(2)
            inside = self.group() if self.peek() == "(" else self.short()
            if q is None or q.denominator > 1 or not 2 <= q <= MAX_POWER:
                raise Unreadable
            return inside.root(int(q))
        if t in FUNCTIONS:
            return opaque(t, (self.group() if self.peek() in ("(", "{") else self.factor()).key())
        if t == "i":
            return Quotient(_monomial({("i",): 1}))
        if not t[:1].isalpha() or t in ("pm", "infty", "text", "mathrm", "begin", "end"):
            raise Unreadable
        return Quotient({((("name", t), 1),): Fraction(1)})


@lru_cache(maxsize=4096)
def read(text: str) -> Quotient | None:
    """The value of an expression, or None if it is unreadable."""
    if len(text) > MAX_CHARS:
        return None
    try:
        return _Reader(text).whole()
    except (Unreadable, ZeroDivisionError, RecursionError):
        return None


def names(text: str) -> set[str]:
    """Distinct letters of an expression apart from those of roots and fractions."""
    return {c for c in text.replace("sqrt", "").replace("frac", "") if c.isalpha()}


def equal(a: str, b: str) -> bool:
    """Whether both can be read and their difference is zero."""
    x, y = read(a), read(b)
    if x is None or y is None:
        return False
    try:
        return not (x - y).top
    except Unreadable:
        return False


def value(text: str) -> float | None:
    """The number that an expression of numbers, roots and the circle's and Euler's constants stands for."""
    x = read(text)
    if x is None:
        return None
    known = {("name", "pi"): math.pi, ("name", "e"): math.e}

    def number(p: Poly) -> float:
        total = 0.0
        for m, c in p.items():
            part = float(c)
            for atom, e in m:
                part *= (atom[1] if atom[0] == "prime" else known[atom]) ** float(e)
            total += part
        return total

    try:
        return number(x.top) / number(x.under)
    except (KeyError, ZeroDivisionError, OverflowError):
        return None
