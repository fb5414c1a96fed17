"""The PII query against a plain Python version of its rules."""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import re

import pytest

import __spark_entry__ as entry
from xsfactor.llm import pii

KEY = pii.DEMO_KEY
SF = "/root/testdata/sf0.01"


def feistel(kind, a, b, sa, sb):
    mix = lambda r, half: int(hashlib.sha256("|".join(map(str, (KEY, kind, sa, sb, r, half))).encode()).hexdigest()[:15], 16)
    for r in range(pii.ROUNDS):
        a, b = ((a + mix(r, b)) % sa, b) if r % 2 == 0 else (a, (b + mix(r, a)) % sb)
    return a, b


def digits(kind, d):
    n, u = len(d), len(d) // 2
    a, b = feistel(kind, int(d[:u] or 0), int(d[u:]), 10**u, 10 ** (n - u))
    return (str(a).zfill(u) if u else "") + str(b).zfill(n - u)


def only(m):
    return re.sub("[^0-9]", "", m)


def over(shape, filling, slot="[0-9]"):
    it = iter(filling)
    return "".join(next(it, "") if re.fullmatch(slot, c) else c for c in shape)


def luhn(d, doubled_last):
    return sum(sum(divmod(2 * int(c), 10)) if (i % 2 == 0) == doubled_last else int(c) for i, c in enumerate(reversed(d)))


def token(kind, value, n=16):
    return hashlib.sha256("|".join((KEY, kind, value)).encode()).hexdigest()[:n]


def secret(m):
    name, value = re.match(r"([^:=]*[:=]\s*[\"']?)", m)[1], re.search(r"[:=]\s*[\"']?([^\"']*)", m)[1]
    return f"{name}redacted-{token('secret', value)}{m[-1] if m[-1] in chr(34) + chr(39) else ''}"


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def iban(m):
    x = m.replace(" ", "")
    if mod97(x[4:] + x[:4]) != 1:
        return m
    body = x[4:]
    new = over(body, digits("iban", only(body))) if only(body) else body
    return over(m, x[:2] + f"{98 - mod97(new + x[:2] + '00'):02d}" + new, "[A-Z0-9]")


def ipv4(m):
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return m
    a, b = feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def made(y, mo, d):
    try:
        return dt.date(y, mo, d)
    except ValueError:
        return None


def moved(d):
    first = dt.date(1800, 1, 1)
    i = (d - first).days
    a, b = feistel("date", i // 5411, i % 5411, 27, 5411)
    return first + dt.timedelta(days=a * 5411 + b)


def iso_date(m):
    d = made(*map(int, m.split("-")))
    return moved(d).strftime("%Y-%m-%d") if d and 1800 <= d.year < 2200 else m


def day_date(m):
    p = [int(x) for x in re.split("[./]", m)]
    s = re.findall("[./]", m)
    shape = f"00{s[0]}00{s[1]}0000"
    if d := made(p[2], p[1], p[0]):
        return over(shape, moved(d).strftime("%d%m%Y")) if 1800 <= d.year < 2200 else m
    d = made(p[2], p[0], p[1])
    if not d or not 1800 <= d.year < 2200:
        return m
    last = lambda y, mo: calendar.monthrange(y, mo)[1]
    years = [y for y in range(1800, 2200) if d.month != 2 or last(y, 2) == last(d.year, 2)]
    months = [k for k in range(1, 13) if last(d.year, k) == last(d.year, d.month)]
    a, b = feistel("month_date", years.index(d.year) * len(months) + months.index(d.month), d.day - 13, len(years) * len(months), last(d.year, d.month) - 12)
    return over(shape, f"{months[a % len(months)]:02d}{b + 13:02d}{years[a // len(months)]}")


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return m
    a, b = feistel("ssn", area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def phone(m):
    d = only(m)
    country, x = d[:-10], d[-10:]
    area, exchange = int(x[:3]), int(x[3:6])
    if area >= 200 and exchange >= 200:
        a, b = feistel("phone", area - 200, (exchange - 200) * 10000 + int(x[6:]), 800, 8_000_000)
        new = f"{a + 200:03d}{b + 2_000_000:07d}"
    elif area < 200:
        new = x[0] + digits("phone1", x[1:])
    else:
        new = x[:4] + digits("phone4", x[4:])
    return over(m, country + new)


def intl(m):
    d, g = only(m), re.match(r"\+([0-9]{1,3})[^0-9]", m)
    n = len(g[1]) if g else 2
    return over(m, d[:n] + digits("intl", d[n:]))


def national(m):
    d = only(m)
    return over(m, d[:2] + digits("national", d[2:]))


def card(m):
    d = only(m)
    body = d[0] + digits("card", d[1:-1])
    return over(m, body + str((luhn(d, False) - luhn(body, True)) % 10))


def email(m):
    return f"user-{token('email', m.lower())}@example.invalid"


MAKERS = {f.__name__: f for f in (secret, email, iban, ipv4, iso_date, day_date, ssn, phone, intl, national, card)}


def plain(text):
    def swap(m):
        return next(MAKERS[k](m[0]) for k, p in pii.KINDS.items() if re.fullmatch(p, m[0], re.ASCII))

    return re.sub(pii.ANY, swap, text, flags=re.ASCII)


ODD = [
    "card 4111 1111 1111 1111, 378282246310005, 1234567890123 and 3782 822463 10005.", "DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00",
    "on 31.12.1999, 12/31/1999, 2/29/2000, 02/29/1999, 1.2.2020, 2020-02-30, 2020-02-29 and 1700-01-01", "at 10.0.0.1, 256.1.1.1 and 1.2.3.4.5",
    "call +1 (269) 555-0001, 212-555-0123, (112) 555-0123, 212-155-0123, +49 30 1234567, +4915112345678, 01 23 45 67 89, 030/1234567", "ssn 123-45-6789, 666-45-6789, 900-11-1111, 899-99-9999",
    "password: _Abcdefgh1 token='abcdefgh12' api_key = \"0123456789\" X.Y+z@mail.example.com", "",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_values(spark, text):
    got = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first()["text"]
    assert got == plain(text)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    got = entry.queries()["op3_pii"](spark, SF).toPandas().set_index("doc_id").text
    wrong = [i for i, t in docs.items() if got[i] != (plain(t) if t is not None else None)]
    assert not wrong and (got != docs).sum() > 10
