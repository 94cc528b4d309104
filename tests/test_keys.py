import math
from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetloom.functions.keys import canonical_text, in_range, key_equals, key_text, literal_for, number_text


@pytest.mark.parametrize(
    ("value", "text"),
    [(5, "5"), (5.0, "5"), (5.5, "5.5"), (-0.0, "0"), (True, "true"), (None, "null"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (1.25e22, "1.25e+22"),
     (float("nan"), "NaN"), (float("-inf"), "-Infinity"), ("5.0", "5.0"), (Decimal("5.10"), "5.1"), ([1, "x"], "1,x"), (datetime(2025, 1, 2, 3, 4, 5, 678999), "2025-01-02T03:04:05.678Z"), (0.1, "0.1"), (123456.789, "123456.789")],
)
def test_canonical_text(value, text):
    assert canonical_text(value) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=300)
def test_number_text_round_trips(x):
    assert float(number_text(x)) == x


def test_only_canonical_spellings_match():
    assert literal_for("5", T.DoubleType()) == 5.0
    assert literal_for("5.0", T.DoubleType()) is None
    assert literal_for("05", T.LongType()) is None
    assert literal_for(str(1 << 40), T.IntegerType()) is None
    assert literal_for("True", T.BooleanType()) is None
    assert math.isnan(literal_for("NaN", T.DoubleType()))
    assert literal_for("5.1", T.DecimalType(5, 2)) == Decimal("5.1")


def test_key_text_agrees_with_canonical_text(spark):
    numbers = [0.0, -0.0, 5.0, 5.5, 1e7, 12345678.25, 1e-3, 1e-6, 1.5e-7, 1e20, 1e21, -1e22, 0.1, 1 / 3, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r[0] for r in df.select(key_text(F.col("x"), T.DoubleType())).collect()]
    assert got == [None if x is None else canonical_text(x) for x in numbers]
    when = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-02 03:04:05.678912' AS t, DATE '2025-01-02' AS d, CAST(5.10 AS DECIMAL(5,2)) AS n")
    row = when.select(key_text(F.col("t"), T.TimestampNTZType()), key_text(F.col("d"), T.DateType()), key_text(F.col("n"), T.DecimalType(5, 2))).first()
    assert list(row) == ["2025-01-02T03:04:05.678Z", "2025-01-02T00:00:00.000Z", "5.1"]


def test_times_compare_by_millisecond(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-02 03:04:05.678912' AS n, TIMESTAMP '2025-01-02 03:04:05.678912 UTC' AS z, DATE '2025-01-02' AS d")
    ms = 1735787045678
    for name, kind in (("n", T.TimestampNTZType()), ("z", T.TimestampType())):
        for keys, hit in ((["2025-01-02T03:04:05.678Z"], 1), ([str(ms)], 1), ([str(ms + 1)], 0)):
            assert df.where(key_equals(F.col(name), keys, kind)).count() == hit
        assert key_equals(F.col(name), ["2025-01-02"], kind) is None
        assert df.where(in_range(F.col(name), kind, ms, ms, True)).count() == 1
        assert df.where(in_range(F.col(name), kind, ms + 0.5, None, True)).count() == 0
    assert df.where(key_equals(F.col("d"), ["1735776000000"], T.DateType())).count() == 1
    assert df.where(in_range(F.col("d"), T.DateType(), 1735776000000, 1735776000000, True)).count() == 1


def test_bounds(spark):
    df = spark.createDataFrame([(1, 1.0, "2025-01-01", "3"), (2, float("nan"), "no date", "x"), (None, None, None, None)], "i long, x double, d string, n string")
    count = lambda c, k, lo, hi, date=False: (lambda t: 0 if t is None else df.where(t).count())(in_range(F.col(c), k, lo, hi, date))
    assert count("i", T.LongType(), None, None) == 2
    assert count("i", T.LongType(), 1.5, 2.5) == 1
    assert count("i", T.LongType(), float("nan"), float("inf")) == 2
    assert count("i", T.LongType(), float("inf"), None) == 0
    assert count("i", T.LongType(), 3, 1) == 0
    assert count("i", T.LongType(), 1e300, None) == 0
    assert count("x", T.DoubleType(), None, None) == 1
    assert count("x", T.DoubleType(), 0, None) == 1
    assert count("d", T.StringType(), None, None, True) == 1
    assert count("d", T.StringType(), 1735689600000, 1735689600000, True) == 1
    assert count("n", T.StringType(), 3, 3) == 1
