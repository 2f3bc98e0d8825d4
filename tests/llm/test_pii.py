"""Pseudonyms: format kept, one-to-one, equal everywhere, validated only."""

import datetime
import hashlib
import random
import re

import pytest

from millrace.llm.pii import pseudonymise


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def card(rng, n=16):
    body = str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 2))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["pii_kinds"]) for r in pseudonymise(df, "k").collect()}


def test_each_format(spark):
    rng = random.Random(4)
    values = {
        "card": [card(rng, n) for n in (13, 16, 16, 19)] + [" ".join(re.findall("....", card(rng)))],
        "phone": ["+1 (415) 555-2671", "(415) 555-2671", "415-555-2671", "212.555.0000"],
        "ssn": ["123-45-6789", "665-01-0001", "899-99-9999"],
        "iso_date": ["1999-02-28", "2000-02-29", "2024-12-31", "1900-01-01"],
        "us_date": ["12/31/1999", "01/02/2023"],
        "ipv4": ["10.0.0.1", "255.255.255.255", "8.8.8.8"],
        "email": ["Jane.Doe+42@mail.example.com", "a@b.co"],
    }
    flat = [(k, v) for k, vs in values.items() for v in vs]
    got = run(spark, [f"é x {v}, and {v}. end" for _, v in flat])
    for i, (kind, v) in enumerate(flat):
        text, kinds = got[i]
        m = re.fullmatch(r"é x (.+), and (.+)\. end", text)
        assert m, text
        assert kinds == [kind, kind] and m[1] == m[2] != v, (kind, v, text)
        new = m[1]
        if kind != "ipv4":
            assert [re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x))) for x in (v, new)][0] == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new)))
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new)) and new[0] == v[0]
        if kind == "iso_date":
            assert datetime.date.fromisoformat(new).year // 100 == int(v[:2])
        if kind == "us_date":
            datetime.datetime.strptime(new, "%m/%d/%Y")
        if kind == "ssn":
            a, g, s = map(int, new.split("-"))
            assert 1 <= a <= 899 and a != 666 and g and s
        if kind == "phone":
            d = re.sub(r"\D", "", new)[-10:]
            assert d[0] >= "2" and d[3] >= "2"
        if kind == "ipv4":
            assert all(int(x) <= 255 for x in new.split("."))


def test_one_to_one(spark):
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(800)]
    phones = [f"415-555-{k:04d}" for k in range(600)]
    got = run(spark, days + phones + [f"x{k}@e.org" for k in range(10)])
    assert len({t for t, _ in got.values()}) == len(got)


def test_left_alone(spark):
    texts = [None, "", "plain", "4111111111111112", "000-12-3456", "999-99-9999", "2023-02-30", "13/45/2020", "1.2.3.400", "1.2.3.4.5", "a@b", "115-555-2671", "x123-45-6789", "id 12345678901234567890123", "no digits" * 20000]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == (t, []), t


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "k", 5, "h", "n", "r")], "doc_id long, text string, kind string, value int, hits string, new string, row string")
    out = pseudonymise(df, "k")
    assert out.columns == [*df.columns, "pii_kinds"] and tuple(out.first()[c] for c in ("kind", "value", "hits", "new", "row")) == ("k", 5, "h", "n", "r")
    assert pseudonymise(df.where("false"), "k").collect() == []
    again = pseudonymise(out, "k")
    assert again.columns == out.columns  # its own column is replaced
    with pytest.raises(ValueError):
        pseudonymise(df, "")


# -- the same permutations in plain Python

KEY = "a key of the tests"


def bits(tweak, i, half):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)


def feistel(tweak, l, r, a, b):
    for i in range(10):
        if i % 2 == 0:
            l = (l + bits(tweak, i, r)) % a
        else:
            r = (r + bits(tweak, i, l)) % b
    return l, r


def feistel_text(tweak, v):
    def moved(text, i, other):
        out = ""
        for k, ch in enumerate(text):
            by = bits(tweak, i, f"{other}|{k}")
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(ch) < ord(first) + n:
                    ch = chr(ord(first) + (ord(ch) - ord(first) + by) % n)
                    break
            out += ch
        return out

    l, r = v[: len(v) // 2], v[len(v) // 2 :]
    for i in range(10):
        if i % 2 == 0:
            l = moved(l, i, r)
        else:
            r = moved(r, i, l)
    return l + r


def refill(m, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), m)


def by_hand(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, _, rest = m.partition("@")
        return feistel_text("email", local) + "@" + rest
    if kind == "phone":
        local = d[-10:]
        n = (int(local[:3]) - 200) * 8_000_000 + (int(local[3:6]) - 200) * 10_000 + int(local[6:])
        l, r = feistel("phone", n // 80_000, n % 80_000, 80_000, 80_000)
        n = l * 80_000 + r
        return refill(m, d[:-10] + f"{n // 8_000_000 + 200:03d}{n % 8_000_000 // 10_000 + 200:03d}{n % 10_000:04d}")
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        l, r = feistel("ssn", areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999)
        return refill(m, f"{areas[l // 99]:03d}{l % 99 + 1:02d}{r + 1:04d}")
    if kind in ("iso_date", "us_date"):
        day = datetime.date.fromisoformat(m) if kind == "iso_date" else datetime.datetime.strptime(m, "%m/%d/%Y").date()
        first = datetime.date(day.year // 100 * 100, 1, 1)
        days = (datetime.date(first.year + 100, 1, 1) - first).days
        a, b = {36525: (75, 487), 36524: (92, 397)}[days]
        l, r = feistel("date", (day - first).days // b, (day - first).days % b, a, b)
        new = first + datetime.timedelta(l * b + r)
        return new.isoformat() if kind == "iso_date" else new.strftime("%m/%d/%Y")
    if kind == "ipv4":
        w, x, y, z = map(int, m.split("."))
        l, r = feistel("ipv4", w * 256 + x, y * 256 + z, 65536, 65536)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    body = d[0] + feistel_text("card", d[1:-1])
    return refill(m, next(body + str(c) for c in range(10) if luhn(body + str(c))))


def test_against_plain_python(spark):
    rng = random.Random(6)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    makers = {
        "email": lambda: rng.choice(["Jo.Doe+", "x_", "A-9."]) + number(rng.randint(1, 5)) + "@mail.example.com",
        "phone": lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{number(4)}",
        "ssn": lambda: f"{rng.choice([1, 665, 667, rng.randint(1, 665)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "iso_date": lambda: (datetime.date(1901, 1, 1) + datetime.timedelta(rng.randint(0, 70_000))).isoformat(),
        "us_date": lambda: (datetime.date(1999, 1, 1) + datetime.timedelta(rng.randint(0, 9_000))).strftime("%m/%d/%Y"),
        "ipv4": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(rng, rng.randint(13, 19)),
    }
    values = [(kind, make()) for kind, make in makers.items() for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["pii_kinds"]) for r in pseudonymise(df, KEY).collect()}
    for i, (kind, v) in enumerate(values):
        assert got[i] == (by_hand(kind, v), [kind]), (kind, v)
    other = {r["doc_id"]: r["text"] for r in pseudonymise(df, KEY + "!").collect()}
    assert sum(other[i] != got[i][0] for i in other) > 0.9 * len(values)
