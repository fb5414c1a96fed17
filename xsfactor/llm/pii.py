"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds candidates; each is validated by kind (Luhn, mod 97, octets, calendar, ranges) and replaced
by a keyed Feistel permutation within its format: a card number becomes another valid card number of that length and
first digit, a date another date of that layout. The permutation hangs on key and kind alone, so equal values stay equal
across documents, and different ones stay different. E-mail addresses get a keyed local part at a reserved domain, values
of secrets a keyed token.

Card-like numbers are replaced whether or not their Luhn sum holds, as a mistyped one is personal too: those that hold it
hold it still, the others still don't. Phone numbers are those of North America, those with a + and a country code, and
those that begin with 0 as in France and Germany; bare groups of digits as in Spain are left alone, being numbers as often.

Defined cases: null text stays null, empty text empty; other candidates that fail their validation stay as they are;
repeated rows get equal results; an empty table stays empty; texts are searched whole, however long; of candidates that begin at
one place the kind listed first counts; dates as 1.2.2020 come back with two-digit days and months; other columns pass through
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: For demonstrations and tests; production passes its own.
DEMO_KEY = "xsfactor-demo-key"
ROUNDS = 8
#: What each kind looks like. Each begins and ends at a token's edge.
KINDS = {
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{8,}+[\"']?",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "iso_date": r"(?<![\w\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w\-])",
    "day_date": r"(?<![\w./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![\w/]|\.[0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\w\-])",
    "intl": r"(?<![\w+])\+(?=[0-9](?:[ .\-()/]{0,2}[0-9]){7,14}(?![0-9]))[0-9]{1,3}(?:[ .\-/]?\(?[0-9]{1,9}\)?){1,6}(?![\w\-])",
    "national": r"(?<![\w+.\-/])0[1-9](?:(?:[ .][0-9]{2}){4}|[0-9]{1,4}[ /\-][0-9]{4,8})(?![\w\-/]|[ .][0-9])",
    "card": r"(?<![\w\-])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![\w\-]|\.[0-9])",
}
#: What a kind begins with: the expression looks no further at other characters.
FIRST = {"secret": "[A-Za-z]", "email": "[A-Za-z0-9]", "iban": "[A-Z]", "phone": "[0-9+(]", "intl": "[+]", "national": "0"}
ANY = "|".join(f"(?:(?={FIRST.get(k, '[0-9]')})(?:{p}))" for k, p in KINDS.items())
#: A cheap test that every text with a candidate passes.
HINT = r"(?=[@0-9:=])(?:@[A-Za-z0-9]|[0-9][0-9A-Z.\-/() ]{5}|[:=]\s{0,3}[\"']?[A-Za-z0-9+/_\-])"
#: Days of the calendar's 400-year cycle, from 1800-01-01: 27 x 5411.
FIRST_DAY, CYCLE = "1800-01-01", (27, 5411)


def keyed(key: str, *parts: Column) -> Column:
    """60 pseudo-random bits from the key and the parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A permutation of the pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b: rounds add a keyed function of one half to the other."""

    def step(s: Column, r: Column) -> Column:
        mix = lambda half: keyed(key, F.lit(kind), size_a.cast("string"), size_b.cast("string"), r.cast("string"), half.cast("string"))
        return (
            F.when(r % 2 == 0, F.struct(F.pmod(s["a"] + mix(s["b"]), size_a).alias("a"), s["b"].alias("b")))
            .otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + mix(s["a"]), size_b).alias("b")))
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def within(value: Column, body: callable) -> Column:
    """let value in body: evaluates value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def power10(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**k) for k in range(19))), n + 1)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of a length, 1 to 36."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u)
    whole = lambda x: F.coalesce(F.when(F.length(x) > 0, x.cast("long")), F.lit(0).cast("long"))
    mixed = feistel(key, kind, whole(a), whole(b), power10(u), power10(n - u))
    return within(mixed, lambda s: F.concat(
        F.when(u > 0, F.lpad(s["a"].cast("string"), u, F.lit("0"))).otherwise(F.lit("")),
        F.lpad(s["b"].cast("string"), n - u, F.lit("0")),
    ))


def luhn(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; doubled_last: the last digit is doubled, as in a payload without its check digit."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(
        F.filter(each, lambda x: x != ""),
        lambda x, i: F.when((i % 2 == 0) == F.lit(doubled_last), F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.cast("int") + 1)).otherwise(x.cast("int")),
    )
    return F.aggregate(value, F.lit(0), lambda s, x: s + x)


def laid_over(shape: Column, filling: Column, slot: str = r"[0-9]") -> Column:
    """The shape with its slots filled by the characters of filling, one after the other."""
    chars = F.filter(F.split(shape, ""), lambda x: x != "")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        chars, state,
        lambda s, x: F.when(x.rlike(slot), F.struct(F.concat(s["out"], F.substring(filling, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], x).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def only(digits_of: Column) -> Column:
    return F.regexp_replace(digits_of, r"[^0-9]", "")


def card(key: str, m: Column) -> Column:
    """The first digit and the remainder of the Luhn sum stay: valid numbers stay valid, others don't become so."""

    def put(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), permute_digits(key, "card", F.substring(d, F.lit(2), n - 2)))
        off = luhn(d, False)
        return within(body, lambda p: laid_over(m, F.concat(p, F.pmod(off - luhn(p, True), F.lit(10)).cast("string"))))

    return within(only(m), put)


def split_number(key: str, kind: str, m: Column, first: Column, size_first: int, rest: Column, size_rest: int, back: callable) -> Column:
    """Permutes (first, rest) and lays what back() makes of it over the shape of m."""
    mixed = feistel(key, kind, first, rest, F.lit(size_first).cast("long"), F.lit(size_rest).cast("long"))
    return within(mixed, lambda s: laid_over(m, back(s["a"], s["b"])))


def pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(m, *x).cast("int") for x in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)

    def back(a: Column, b: Column) -> Column:
        area2 = a + 1 + F.when(a >= 665, 1).otherwise(0)
        return F.concat(pad(area2, 3), pad(F.floor(b / 9999) + 1, 2), pad(b % 9999 + 1, 4))

    return F.when(valid, split_number(key, "ssn", m, index, 898, (group - 1) * 9999 + serial - 1, 99 * 9999, back)).otherwise(m)


def phone(key: str, m: Column) -> Column:
    """Ten digits behind any country code: area and exchange 200 to 999 stay in that range, others are ten free digits."""

    def put(d: Column) -> Column:
        country, national = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, F.length(d) - 9, F.lit(10))

        def mixed(x: Column) -> Column:
            area, exchange, line = (F.substring(x, *y).cast("long") for y in ((1, 3), (4, 3), (7, 4)))
            plan = feistel(key, "phone", area - 200, (exchange - 200) * 10000 + line, F.lit(800).cast("long"), F.lit(8_000_000).cast("long"))
            plan = within(plan, lambda s: F.concat(pad(s["a"] + 200, 3), pad(s["b"] + 2_000_000, 7)))
            return F.when((area >= 200) & (exchange >= 200), plan).otherwise(
                F.when((area < 200), F.concat(F.substring(x, 1, 1), permute_digits(key, "phone1", F.substring(x, 2, 9))))
                .otherwise(F.concat(F.substring(x, 1, 4), permute_digits(key, "phone4", F.substring(x, 5, 6))))
            )

        return within(national, lambda x: laid_over(m, F.concat(country, mixed(x))))

    return within(only(m), put)


def intl(key: str, m: Column) -> Column:
    """The country code stays (the first group of digits, or two where there is none); what follows is permuted."""
    group = F.regexp_extract(m, r"^\+([0-9]{1,3})[^0-9]", 1)

    def put(d: Column) -> Column:
        n = F.when(F.length(group) > 0, F.length(group)).otherwise(F.lit(2))
        rest = F.substring(d, n + 1, F.length(d) - n)
        return laid_over(m, F.concat(F.substring(d, F.lit(1), n), permute_digits(key, "intl", rest)))

    return within(only(m), put)


def national(key: str, m: Column) -> Column:
    """The first two digits stay, the others are permuted."""
    return within(only(m), lambda d: laid_over(m, F.concat(F.substring(d, 1, 2), permute_digits(key, "national", F.substring(d, F.lit(3), F.length(d) - 2)))))


def ipv4(key: str, m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def put(o: Column) -> Column:
        at = lambda k: F.element_at(o, k)
        mixed = feistel(key, "ipv4", at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536).cast("long"), F.lit(65536).cast("long"))
        return within(mixed, lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if hi else s[h] % 256).cast("string") for h in "ab" for hi in (1, 0))))

    return within(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), put(o)).otherwise(m))


def date(key: str, m: Column, parsed: Column, layout: callable) -> Column:
    """Dates of 1800 to 2199 are permuted among themselves; other strings of this look stay."""
    index = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
    a, b = (F.lit(x).cast("long") for x in CYCLE)
    mixed = feistel(key, "date", F.floor(index / CYCLE[1]), index % CYCLE[1], a, b)
    moved = within(mixed, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * CYCLE[1] + s["b"]).cast("int")))
    valid = parsed.isNotNull() & (index >= 0) & (index < CYCLE[0] * CYCLE[1])
    return F.when(valid, within(moved, layout)).otherwise(m)


def iso_date(key: str, m: Column) -> Column:
    return date(key, m, F.try_to_date(m, "yyyy-MM-dd"), lambda d: F.date_format(d, "yyyy-MM-dd"))


def day_date(key: str, m: Column) -> Column:
    """Day before month if that is a date, else month before day; the order and the separators stay."""
    p = F.split(m, "[./]")
    get = lambda k: F.lpad(F.element_at(p, k), 2, "0")
    make = lambda d, mo: F.try_to_date(F.concat_ws("-", F.element_at(p, 3), get(mo), get(d)), "yyyy-MM-dd")
    day_first, month_first = make(1, 2), make(2, 1)
    # Two digits for day and month each: a date of one digit needs a fixed width to stay reversible.
    shape = F.concat(F.lit("00"), F.regexp_extract(m, r"([./])", 1), F.lit("00"), F.regexp_extract(m, r"[./][0-9]+([./])", 1), F.lit("0000"))
    return F.when(day_first.isNotNull(), date(key, m, day_first, lambda d: laid_over(shape, F.date_format(d, "ddMMyyyy")))).otherwise(
        within(month_first, lambda d: F.when((F.year(d) >= 1800) & (F.year(d) < 2200), month_date(key, d, shape)).otherwise(m))
    )


def month_date(key: str, d: Column, shape: Column) -> Column:
    """Month before day, the day above 12, so that no date read day first gets the same string: permuted among the months of its length."""
    last = lambda y, mo: F.dayofmonth(F.last_day(F.make_date(y, mo, F.lit(1))))
    every = F.sequence(F.lit(1800), F.lit(2199))

    def put(x: Column) -> Column:
        years, months, size = x["years"], x["months"], F.size(x["months"])
        at = (F.array_position(years, F.year(d)) - 1) * size + F.array_position(months, F.month(d)) - 1
        mixed = feistel(key, "month_date", at, F.dayofmonth(d) - 13, (F.size(years) * size).cast("long"), (x["last"] - 12).cast("long"))
        month, year = (lambda s: F.element_at(months, (s["a"] % size + 1).cast("int"))), (lambda s: F.element_at(years, (F.floor(s["a"] / size) + 1).cast("int")))
        return within(mixed, lambda s: laid_over(shape, F.concat(pad(month(s), 2), pad(s["b"] + 13, 2), year(s).cast("string"))))

    of = last(F.year(d), F.month(d))
    years = F.when(F.month(d) == 2, F.filter(every, lambda y: last(y, F.lit(2)) == of)).otherwise(every)
    months = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda mo: last(F.year(d), mo) == of)
    return within(F.struct(years.alias("years"), months.alias("months"), of.alias("last")), put)


def mod97(alnum: Column) -> Column:
    return F.aggregate(
        F.filter(F.split(alnum, ""), lambda x: x != ""), F.lit(0),
        lambda s, x: F.when(x.rlike("[0-9]"), (s * 10 + F.ascii(x) - 48) % 97).otherwise((s * 100 + F.ascii(x) - 55) % 97),
    )


def iban(key: str, m: Column) -> Column:
    """Digits of the account part are permuted, letters and country stay, check digits are made anew."""

    def put(x: Column) -> Column:
        body = F.substring(x, F.lit(5), F.length(x) - 4)
        new = F.when(F.length(only(body)) > 0, laid_over(body, permute_digits(key, "iban", only(body)))).otherwise(body)

        def check(y: Column) -> Column:
            return F.concat(F.substring(x, 1, 2), pad(98 - mod97(F.concat(y, F.substring(x, 1, 2), F.lit("00"))), 2), y)

        return within(new, lambda y: laid_over(m, check(y), "[A-Z0-9]"))

    plain = F.regexp_replace(m, " ", "")
    ok = lambda x: mod97(F.concat(F.substring(x, F.lit(5), F.length(x) - 4), F.substring(x, 1, 4))) == 1
    return within(plain, lambda x: F.when(ok(x), put(x)).otherwise(m))


def email(key: str, m: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def secret(key: str, m: Column) -> Column:
    """Name, separator and quotes stay; the value becomes a keyed token."""
    name, value = F.regexp_extract(m, r"^([^:=]*[:=]\s*[\"']?)", 1), F.regexp_extract(m, r"[:=]\s*[\"']?([^\"']*)", 1)
    token = F.concat(F.lit("redacted-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), 1, 16))
    return F.concat(name, token, F.regexp_extract(m, r"([\"']?)$", 1))


MAKERS = {"secret": secret, "email": email, "iban": iban, "ipv4": ipv4, "iso_date": iso_date, "day_date": day_date, "ssn": ssn, "phone": phone, "intl": intl, "national": national, "card": card}


def replacement(key: str, m: Column) -> Column:
    """What stands for a match, by the first kind that it is wholly of."""
    out = m
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), MAKERS[kind](key, m)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the text replaced; found: the name of a column for the number of values replaced.

    Per row, without a shuffle. Most rows fail the first test and are not taken apart.
    """
    t = F.col(text)
    tmp = free_name(docs.columns, "_pii")
    match = F.when(t.rlike(HINT) & t.rlike(ANY), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)))
    swapped = F.transform(match, lambda m: F.struct(m.alias("old"), replacement(key, m).alias("new")))
    out = docs.withColumn(tmp, swapped)
    s = F.col(tmp)
    between = F.split(t, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform(s, lambda x: x["new"]), lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")
    if found:
        out = out.withColumn(found, F.coalesce(F.size(F.filter(s, lambda x: x["old"] != x["new"])), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(s.isNull(), t).otherwise(joined)).drop(tmp)
