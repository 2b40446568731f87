import datetime
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cumulus.llm import pii


@pytest.fixture(scope="module")
def change(spark):
    def run(texts, key="k"):
        docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_pseudonyms string")
        return [(r.text, r.n_pseudonyms) for r in pii.pseudonymise(docs, key).orderBy("doc_id").collect()]
    return run


def luhn(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def mod97(text):
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", text)))


VALUES = {
    "card": ["4417744280351547", "4417 7442 8035 1547", "378282246310005"],
    "mail": ["heitlich.60@mail8.example.com", "a@b.co", "Bob+x@mail.example.org"],
    "phone": ["+1 (243) 555-5526", "(243) 555-5526", "243-555-5526", "555-5526", "+44 20 7946 0958"],
    "ip": ["248.40.198.62", "8.8.8.8"],
    "ssn": ["123-45-6789"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89370400440532013000"],
    "secret": ["681c09b8e90e7e8c9575180f595f646cf29690ab"],
    "date": ["1987-03-05", "5.3.1987", "03/25/1987", "2020/12/31", "1898-03-02", "1500-01-01", "2100-2-28", "31.12.9999", "0001-01-01"],
}


def test_every_value_is_replaced_within_its_format(change):
    values = [v for several in VALUES.values() for v in several]
    out = change([f"before {v} after." for v in values])
    for v, (text, count) in zip(values, out):
        assert count == 1 and v not in text
        new = text.removeprefix("before ").removesuffix(" after.")
        if v in VALUES["card"]:
            assert luhn(new) and shape(new) == shape(v)
        elif v in VALUES["iban"]:
            assert mod97(new) == 1 and new[:2] == v[:2] and len(new) == len(v)
        elif v in VALUES["ip"]:
            assert all(0 <= int(x) <= 255 for x in new.split(".")) and new.count(".") == 3
        elif v in VALUES["date"]:
            parts = [int(x) for x in re.split("[./-]", new)]
            y, m, d = parts if parts[0] > 31 else (parts[2], parts[0], parts[1]) if v == "03/25/1987" else parts[::-1]
            datetime.date(y, m, d)
        else:
            assert shape(new) == shape(v)


def test_equal_values_stay_linked_across_documents(change):
    out = change(["x 4417744280351547", "4417744280351547 y, and z 4417744280351547", "+1 (243) 555-5526", "(243) 555-5526",
                  "1987-03-05", "5.3.1987"])
    card = out[0][0][2:]
    assert out[1][0] == f"{card} y, and z {card}" and out[1][1] == 2
    assert out[2][0].endswith(out[3][0])
    y, m, d = out[4][0].split("-")
    assert out[5][0].split(".") == [str(int(d)), str(int(m)), y]


def test_invalid_values_stay(change):
    texts = ["card 4417744280351548.", "ip 300.1.1.1 x", "ssn 000-12-3456", "GB83 WEST 1234 5698 7654 32", "2023-02-30", "12345", "3.14",
             "version 1.2.3", "a@b", "x" * 100_000 + "1", "1" * 25]
    assert change(texts) == [(t, 0) for t in texts]


def test_permutations_are_one_to_one(change):
    cards = []
    for k in range(300):
        body = f"4000{k:011d}"
        cards.append(next(body + str(c) for c in range(10) if luhn(body + str(c))))
    dates = [(datetime.date(1990, 1, 1) + datetime.timedelta(days=k)).isoformat() for k in range(300)]
    phones = [f"555-{k:04d}" for k in range(300)]
    ips = [f"10.0.{k // 20}.{k % 20}" for k in range(300)]
    mails = [f"ab.{k:02d}@x.org" for k in range(100)]
    for values in (cards, dates, phones, ips, mails):
        assert len({t for t, _ in change(values)}) == len(values)
    assert change(cards[:5]) != change(cards[:5], key="other") and change(cards[:5]) == change(cards[:5])


class Plain:
    """The pseudonyms of single values, value by value."""

    def __init__(self, key):
        self.key = key

    def number(self, kind, turn, place, other):
        return int(hashlib.sha256(f"{self.key}|{kind}|{turn}|{place}|{other}".encode()).hexdigest()[:12], 16)

    def character(self, c, n, letters):
        for first, size in (("0", 10), ("a", letters), ("A", letters)):
            if ord(first) <= ord(c) < ord(first) + (10 if first == "0" else 26):
                return chr(ord(first) + (ord(c) - ord(first) + n) % size)
        if unicodedata.category(c)[0] != "L":
            return c
        while True:
            c = chr(ord(c) // 64 * 64 + (ord(c) + n) % 64)
            if unicodedata.category(c)[0] == "L":
                return c

    def text(self, value, kind, letters=26):
        left, right = value[:len(value) // 2], value[len(value) // 2:]
        for turn in range(1, pii.ROUNDS + 1):
            left, right = right, "".join(self.character(c, self.number(kind, turn, i, right.lower()), letters)
                                         for i, c in enumerate(left, 1))
        return left + right

    def pair(self, left, right, sides, kind):
        for turn in range(1, pii.ROUNDS + 1, 2):
            left = (left + self.number(kind, turn, 0, right)) % sides[0]
            right = (right + self.number(kind, turn + 1, 1, left)) % sides[1]
        return left, right

    def ssn(self, v):
        v = self.text(v, "ssn")
        while v[:3] in ("000", "666") or v[0] == "9" or v[3:5] == "00" or v[5:] == "0000":
            v = self.text(v, "ssn")
        return v

    def date(self, d):
        first, days, (a, b) = max(s for s in pii.SPANS if s[0] <= d.isoformat())
        # Python has no year 0, whose 366 days come before its first ordinal.
        zero = -365 if first[:4] == "0000" else datetime.date.fromisoformat(first).toordinal()
        n = d.toordinal() - zero
        while True:
            h = self.pair(n // b, n % b, (a, b), "date")
            n = h[0] * b + h[1]
            if n < days:
                return n + zero


def test_pseudonyms_are_those_of_a_plain_feistel_network(change):
    """Every kind, against the same network walked value by value in Python."""
    rng, plain = random.Random(7), Plain("k")
    values, want = [], []

    def add(value, pseudonym):
        values.append(value)
        want.append(pseudonym)

    for _ in range(40):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        ends = [str(c) for c in range(10)]
        body = plain.text(digits, "card")
        add(digits + next(c for c in ends if luhn(digits + c)), body + next(c for c in ends if luhn(body + c)))
        ip = [rng.randrange(256) for _ in range(4)]
        h = plain.pair(ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], (65536, 65536), "ipv4")
        add(".".join(map(str, ip)), ".".join(map(str, [h[0] // 256, h[0] % 256, h[1] // 256, h[1] % 256])))
        ssn = f"{rng.randrange(1, 600):03d}{rng.randrange(1, 99):02d}{rng.randrange(1, 9999):04d}"
        new = plain.ssn(ssn)
        add(f"{ssn[:3]}-{ssn[3:5]}-{ssn[5:]}", f"{new[:3]}-{new[3:5]}-{new[5:]}")
        name = "".join(rng.choice("abcXYZ019._éßЖяλ日本") for _ in range(9)) + "q"
        add(f"{name}@x.org", f"{plain.text(name, 'email')}@x.org")
        phone = f"{rng.randrange(200, 999)}-555-{rng.randrange(10000):04d}"
        p = plain.text(phone.replace("-", ""), "phone")
        add(phone, f"{p[:3]}-{p[3:6]}-{p[6:]}")
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        add(secret, plain.text(secret, "secret", 6))
        bban = "WEST" + "".join(rng.choice("0123456789") for _ in range(14))
        moved = plain.text(bban, "iban")
        check = [f"{98 - mod97('GB00' + b):02d}" for b in (bban, moved)]
        add(f"GB{check[0]}{bban}", f"GB{check[1]}{moved}")
    for year in (1, 99, 400, 1600, 1899, 1900, 1987, 2000, 2099, 2100, 2400, 9999):
        for month, day in ((1, 1), (12, 31), (2, 28)):
            d = datetime.date(year, month, day)
            n = plain.date(d)
            if n > 0:   # a day of year 0 has no name in Python
                add(d.isoformat(), datetime.date.fromordinal(n).isoformat())
    got = [t for t, _ in change([f"x {v} y" for v in values])]
    assert [g for g, w in zip(got, want) if g != f"x {w} y"] == []


def test_spans_cover_all_years_of_four_digits():
    days = [(datetime.date(1900, 1, 1) - datetime.date(1, 1, 1)).days + 366,
            (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days,
            (datetime.date(9999, 12, 31) - datetime.date(2100, 1, 1)).days + 1]
    assert [s[1] for s in pii.SPANS] == days and all(a * b >= n for _, n, (a, b) in pii.SPANS)


def test_letters_and_old_dates_are_one_to_one(change):
    mails = [f"{c}@x.com" for c in map(chr, range(0xC0, 0x250)) if unicodedata.category(c)[0] == "L"]
    dates = [(datetime.date(1898, 1, 1) + datetime.timedelta(days=k)).isoformat() for k in range(1000)]
    for values in (mails, dates):
        new = [t for t, _ in change(values)]
        assert len(set(new)) == len(values)
    assert all(t[:2] < "19" for t, _ in change(dates[:700]))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co")], "doc_id long, text string")
    names = ["__new", "__found", "__between", "new", "found", "between", "m", "other_0", "x.y"]
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    out = pii.pseudonymise(docs, "k")
    assert out.columns == ["doc_id", "text", *names, "n_pseudonyms"]
    row = out.collect()[0]
    assert row[2:11] == tuple(names) and row.n_pseudonyms == 1 and row.text != "mail a@b.co"


def test_a_long_text_with_values_throughout(change):
    filler = "lorem ipsum dolor " * 50
    text = "".join(f"{filler}a{k}@b.co 1987-03-05 " for k in range(300))
    out, count = change([text])[0]
    assert count == 600 and "1987-03-05" not in out and out.count(filler) == 300


def test_nulls_and_empty(change, spark):
    assert change([None, "", "no data at all"]) == [(None, 0), ("", 0), ("no data at all", 0)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymise(docs, "k").columns == ["doc_id", "text", "n_pseudonyms"] and pii.pseudonymise(docs, "k").count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
