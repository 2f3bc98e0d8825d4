"""Format-preserving pseudonyms for validated numbers, dates and addresses.

Each value is permuted under a key inside its own format by a Feistel
network, so equal values get equal pseudonyms in every document, different
values different ones, and the result still passes the same validation:

* card numbers (Luhn): first digit kept, middle permuted, check digit remade;
* phone numbers (North American plan): area, exchange and line permuted;
* social security numbers: area, group and serial permuted;
* dates: permuted among the days of their century;
* IPv4 addresses: permuted over all addresses;
* e-mail addresses: letters and digits of the local part permuted in class.

Everything is a column expression; the round function is SHA-256 of key,
format, round and half.  Null stays null, texts without values are unchanged,
values that fail validation are left alone, repeated rows are treated alike.
An empty table stays empty; a very long text is one row like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ISO_DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])"
US_DATE = r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])"
PATTERNS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "iso_date": ISO_DATE, "us_date": US_DATE, "ipv4": IPV4, "card": CARD}
KINDS = list(PATTERNS)


def _round(key: str, tweak: str, i: Column, half: Column) -> Column:
    """60 bits that depend on key, format, round and half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _feistel(key: str, tweak: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Keyed permutation of ``[0, a) x [0, b)``: halves are added to in turns, modulo their own size."""

    def step(s, i):
        even = F.struct(F.pmod(s["l"] + F.pmod(_round(key, tweak, i, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_round(key, tweak, i, s["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shifted(ch: Column, by: Column) -> Column:
    """A letter or digit moved inside its class; anything else as it is."""
    move = lambda first, n: F.char(F.ascii(ch) - first + F.pmod(by, F.lit(n)) - F.when(F.ascii(ch) - first + F.pmod(by, F.lit(n)) >= n, n).otherwise(0) + first)
    return F.when(ch.between("0", "9"), move(48, 10)).when(ch.between("a", "z"), move(97, 26)).when(ch.between("A", "Z"), move(65, 26)).otherwise(ch)


def _feistel_text(key: str, tweak: str, value: Column) -> Column:
    """Keyed permutation of strings that keeps length and each position's class."""
    half = F.floor(F.length(value) / 2).cast("int")

    def turn(text, i, other):
        return F.array_join(F.transform(F.split(text, ""), lambda ch, k: _shifted(ch, _round(key, tweak, i, F.concat_ws("|", other, k.cast("string"))))), "")

    def step(s, i):
        return F.when(i % 2 == 0, F.struct(turn(s["l"], i, s["r"]).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), turn(s["r"], i, s["l"]).alias("r")))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in turn by those of ``digits``; separators stay."""
    before = lambda i: F.length(_digits(F.substring(m, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(m, ""), lambda ch, i: F.when(ch.between("0", "9"), F.substring(digits, before(i), F.lit(1))).otherwise(ch)), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number without its check digit."""

    def add(s, x):
        d = x.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((~s["odd"]).alias("odd"), (s["t"] + F.when(s["odd"], twice).otherwise(d)).alias("t"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(True).alias("odd"), F.lit(0).alias("t")), add, lambda s: s["t"])


def _check_digit(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def _number(digits: Column, at: int, n: int) -> Column:
    return F.substring(digits, at, n).try_cast("long")


def _pad(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    ok = F.length(d).between(13, 19) & (F.substring(d, F.length(d), F.lit(1)) == _check_digit(body)) & ~d.rlike("^0+$")
    new = F.concat(F.substring(d, 1, 1), _feistel_text(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
    return ok, _refill(m, F.concat(new, _check_digit(new)))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    local = F.right(d, F.lit(10))
    area, exchange, line = _number(local, 1, 3), _number(local, 4, 3), _number(local, 7, 4)
    ok = (area >= 200) & (exchange >= 200)
    n = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
    p = _feistel(key, "phone", F.floor(n / 80_000), F.pmod(n, F.lit(80_000)), F.lit(80_000), F.lit(80_000))
    whole = p["l"] * 80_000 + p["r"]
    new = F.concat(_pad(F.floor(whole / 8_000_000) + 200, 3), _pad(F.floor(F.pmod(whole, F.lit(8_000_000)) / 10_000) + 200, 3), _pad(F.pmod(whole, F.lit(10_000)), 4))
    return ok, _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    d = _digits(m)
    area, group, serial = _number(d, 1, 3), _number(d, 4, 2), _number(d, 6, 4)
    ok = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    dense = area - F.when(area > 666, 2).otherwise(1)  # 0..897: every area but 666
    p = _feistel(key, "ssn", dense * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    slot = F.floor(p["l"] / 99)
    new = F.concat(_pad(slot + F.when(slot >= 665, 2).otherwise(1), 3), _pad(F.pmod(p["l"], F.lit(99)) + 1, 2), _pad(p["r"] + 1, 4))
    return ok, _refill(m, new)


def _day(date: Column, key: str) -> Column:
    """The pseudonym of a date: another day of its century, which has 75*487 or 92*397 days."""
    century = F.floor(F.year(date) / 100)
    first = F.make_date(century.cast("int") * 100, F.lit(1), F.lit(1))
    leap = F.pmod(century, F.lit(4)) == 0
    a, b = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    n = F.datediff(date, first)
    p = _feistel(key, "date", F.floor(n / b), F.pmod(n, b), a, b)
    return F.date_add(first, (p["l"] * b + p["r"]).cast("int"))


def _date(m: Column, key: str, us: bool) -> tuple[Column, Column]:
    parts = (m, F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)) if not us else (m, F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    date = F.concat_ws("-", *parts[1:]).try_cast("date")
    ok = date.isNotNull() & (F.year(date) >= 1000)
    new = F.date_format(_day(date, key), "yyyyMMdd")
    digits = F.concat(F.substring(new, 5, 4), F.substring(new, 1, 4)) if us else new
    return ok, _refill(m, digits)


def _ipv4(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("long"))
    at = lambda k: F.get(octets, F.lit(k))
    ok = F.forall(octets, lambda x: x <= 255)
    p = _feistel(key, "ipv4", at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536))
    return ok, F.concat_ws(".", F.floor(p["l"] / 256), F.pmod(p["l"], F.lit(256)), F.floor(p["r"] / 256), F.pmod(p["r"], F.lit(256)))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    return F.lit(True), F.concat(_feistel_text(key, "email", local), F.substring(m, F.length(local) + 1, F.length(m)))


def _pseudonym(m: Column, key: str) -> tuple[Column, Column]:
    """Kind (null: not valid) and replacement of one match."""
    makers = {"email": _email(m, key), "phone": _phone(m, key), "ssn": _ssn(m, key), "iso_date": _date(m, key, False), "us_date": _date(m, key, True), "ipv4": _ipv4(m, key), "card": _card(m, key)}
    kind, value = F.lit(None).cast("string"), m
    for name in reversed(KINDS):
        ok, new = makers[name]
        here = m.rlike("^(?:" + PATTERNS[name] + ")$")
        kind = F.when(here, F.when(ok, F.lit(name))).otherwise(kind)
        value = F.when(here, F.when(ok, new).otherwise(m)).otherwise(value)
    return kind, value


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` rewritten, and ``pii_kinds``: the kind of each replaced value.

    Whoever has ``key`` can undo the pseudonyms, so it is never a default.  An
    input column ``pii_kinds`` is replaced; all others stay whatever their names.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    pattern = r"(?s)\G(.*?)(" + "|".join(PATTERNS.values()) + ")"
    likely = text.rlike("[0-9]{3}|@") | text.rlike(IPV4)
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    none = F.array().cast("array<struct<gap:string,hit:string>>")
    # The row travels as one value, so that no column of it can clash with a column made here.
    cells = docs.select(F.struct("*").alias("row"), F.when(likely, F.arrays_zip(group(1).alias("gap"), group(2).alias("hit"))).otherwise(none).alias("hits"))

    def replaced(x):
        kind, value = _pseudonym(x["hit"], key)
        return F.struct(x["gap"].alias("gap"), F.length(x["gap"]).alias("g"), F.length(x["hit"]).alias("n"), value.alias("value"), kind.alias("kind"))

    text = F.col(f"row.`{text_col}`")
    cells = cells.select("row", F.transform("hits", replaced).alias("new"))
    used = F.aggregate("new", F.lit(0), lambda s, x: s + x["g"] + x["n"])
    body = F.array_join(F.transform("new", lambda x: F.concat(x["gap"], x["value"])), "")
    tail = F.substring(text, used + 1, F.length(text))
    kinds = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    new = F.when(F.size("new") > 0, F.concat(body, tail)).otherwise(text)
    return cells.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "pii_kinds"], F.coalesce(kinds, F.array().cast("array<string>")).alias("pii_kinds"))
