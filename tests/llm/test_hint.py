"""A text whose only candidate is of one kind passes the first test."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from xsfactor.llm import pii

ONE_OF_EACH = {
    "secret": ["password: _Abcdefgh1", "secret=/abcdefghijk", "token = '+abcdefgh'", "pwd:-abcdefgh", "api_key=abcdefgh", "passwd: Zbcdefgh"],
    "email": ["a@b.de"], "iban": ["DE89370400440532013000"], "ipv4": ["1.2.3.4"], "iso_date": ["2020-01-02"], "day_date": ["1.2.2020"],
    "ssn": ["123-45-6789"], "phone": ["(212) 555-0123", "212.555.0123"], "card": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"],
    "intl": ["+49 30 1234567", "+33 1 23 45 67 89", "+34 612 345 678", "+4915112345678", "+44 (20) 7946-0958"], "national": ["01 23 45 67 89", "030/1234567", "0171-1234567"],
}


@pytest.mark.parametrize("kind", pii.KINDS)
def test_kind_implies_hint(spark, kind):
    df = spark.createDataFrame([(t,) for t in ONE_OF_EACH[kind]], "text string")
    assert df.where(F.col("text").rlike(pii.KINDS[kind])).count() == len(ONE_OF_EACH[kind])
    assert df.where(~F.col("text").rlike(pii.HINT)).count() == 0


def test_secrets_of_any_first_character_are_replaced(spark):
    df = spark.createDataFrame([(t,) for t in ONE_OF_EACH["secret"]], "text string")
    assert all("redacted-" in r["text"] for r in pii.pseudonymise(df, pii.DEMO_KEY).collect())


def test_dates_in_either_order_stay_different(spark):
    days = [f"{d:02d}/{m:02d}/{y}" for y in (2000, 2001) for m in range(1, 13) for d in range(1, 29)]
    months = [f"{m:02d}/{d:02d}/{y}" for y in (1900, 2000, 2001) for m in range(1, 13) for d in range(13, 29)] + ["02/29/2000", "01/31/1999", "04/30/1999"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in days + months], "text string"), "key").collect()]
    assert len(set(out)) == len(days + months) and all(len(t) == 10 for t in out)
    assert all(1 <= int(t[:2]) <= 12 and int(t[3:5]) > 12 for t in out[len(days) :]) and sum(a != b for a, b in zip(out, days + months, strict=True)) > 0.99 * len(out)


def test_phones_of_other_countries_keep_their_shape(spark):
    texts = ONE_OF_EACH["intl"] + ONE_OF_EACH["national"] + [f"+49 30 12345{i:02d}" for i in range(100)]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), "key").collect()]
    shape = str.maketrans("0123456789", "0" * 10)
    assert [t.translate(shape) for t in out] == [t.translate(shape) for t in texts]
    assert len(set(out)) == len(set(texts)) and all(a[:2] == b[:2] for a, b in zip(out, texts, strict=True)) and sum(a == b for a, b in zip(out, texts, strict=True)) < 3
