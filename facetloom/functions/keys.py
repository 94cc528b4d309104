"""Value keys: equality by text form, compiled to predicates on the typed column.

Two values are equal if their canonical texts are, so ``5`` and ``"5"`` match and
``"5.0"`` does not.  Rather than cast a column to text, each key is turned into a
literal of the column's own type (or found impossible), which keeps filters in the
form that Parquet readers can use.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1)
DAY_MS = 86_400_000
TIME_TYPES = (T.TimestampType, T.TimestampNTZType)
INTEGRAL_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
ISO_MS = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z")
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def canonical_text(value: object) -> str:
    """The key of a query value."""
    if value is None:
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return "true" if value else "false"
    if isinstance(value, (int, np.integer)):
        return str(int(value)) if abs(int(value)) < 10**21 else number_text(float(value))
    if isinstance(value, (float, np.floating)):
        return number_text(float(value))
    if isinstance(value, Decimal):
        return decimal_text(value)
    if isinstance(value, datetime):
        return ms_text(datetime_ms(value))
    if isinstance(value, date):
        return ms_text((value - EPOCH.date()).days * DAY_MS)
    if isinstance(value, (list, tuple)):
        return ",".join("" if v is None else canonical_text(v) for v in value)
    return str(value)


def number_text(x: float) -> str:
    """Shortest round-trip digits; plain notation from 1e-6 up to 1e21."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exponent  # the decimal point stands before this digit
    minus = "-" if sign else ""
    if len(text) <= point <= 21:
        return minus + text + "0" * (point - len(text))
    if 0 < point <= 21:
        return f"{minus}{text[:point]}.{text[point:]}"
    if -6 < point <= 0:
        return f"{minus}0.{'0' * -point}{text}"
    mantissa = text[0] + (f".{text[1:]}" if len(text) > 1 else "")
    return f"{minus}{mantissa}e{point - 1:+d}"


def decimal_text(value: Decimal) -> str:
    if not value.is_finite():
        return number_text(float(value))
    text = format(value.normalize(), "f")
    return "0" if text in ("-0", "0") else text


def datetime_ms(value: datetime) -> int:
    plain = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
    return (plain - EPOCH) // timedelta(milliseconds=1)


def ms_text(ms: int) -> str:
    at = EPOCH + timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def key_ms(key: str) -> int | None:
    """Milliseconds of an ISO or epoch key in canonical form, else None."""
    if ISO_MS.fullmatch(key):
        try:
            return datetime_ms(datetime.strptime(key, "%Y-%m-%dT%H:%M:%S.%fZ"))
        except ValueError:
            return None
    if re.fullmatch(r"-?\d{1,15}", key) and str(int(key)) == key and FIRST_MS <= int(key) <= LAST_MS:
        return int(key)
    return None


def time_literal(ms: int, kind: T.DataType) -> Column:
    at = (EPOCH + timedelta(milliseconds=ms)).isoformat(sep=" ", timespec="milliseconds")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{at}'")
    return F.expr(f"TIMESTAMP '{at} UTC'")


def date_literal(day: int) -> Column:
    return F.expr(f"DATE '{(EPOCH + timedelta(days=day)).date().isoformat()}'")


def literal_for(key: str, kind: T.DataType) -> object | None:
    """The value of an exact type whose key is ``key``, or None if there is none."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return key
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False}.get(key)
    if type(kind) in INTEGRAL_BITS:
        if not re.fullmatch(r"-?\d{1,20}", key) or str(int(key)) != key:
            return None
        half = 1 << (INTEGRAL_BITS[type(kind)] - 1)
        return int(key) if -half <= int(key) < half else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        try:
            x = float(key)
        except ValueError:
            return None
        if number_text(x) != key or (isinstance(kind, T.FloatType) and not math.isnan(x) and float(np.float32(x)) != x):
            return None
        return x
    if isinstance(kind, T.DecimalType):
        try:
            x = Decimal(key)
        except InvalidOperation:
            return None
        return x if x.is_finite() and decimal_text(x) == key else None
    return None


def key_equals(col: Column, keys: Iterable[str], kind: T.DataType) -> Column | None:
    """Rows whose key (any element's, for arrays) is among ``keys``; None if no row can be."""
    keys = list(dict.fromkeys(keys))
    if isinstance(kind, T.ArrayType):
        return any_element(col, keys, kind.elementType)
    tests: list[Column] = []
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # The reference point is the millisecond; columns may be finer.
        tests = [(col >= time_literal(ms, kind)) & (col < time_literal(ms + 1, kind)) for ms in map(key_ms, keys) if ms is not None and ms < LAST_MS]
    elif isinstance(kind, T.DateType):
        days = [ms // DAY_MS for ms in map(key_ms, keys) if ms is not None and ms % DAY_MS == 0]
        tests = [col.isin([date_literal(d) for d in days])] if days else []
    else:
        values = [v for v in (literal_for(k, kind) for k in keys) if v is not None]
        plain = [F.lit(v).cast(kind) if isinstance(v, (float, Decimal)) else v for v in values if not (isinstance(v, float) and math.isnan(v))]
        if plain:
            tests.append(col == plain[0] if len(plain) == 1 else col.isin(plain))
        if any(isinstance(v, float) and math.isnan(v) for v in values):
            tests.append(F.isnan(col))
    return reduce(Column.__or__, tests) if tests else None


def any_element(col: Column, keys: list[str], kind: T.DataType) -> Column | None:
    tests: list[Column] = []
    if isinstance(kind, T.StringType) and keys:
        found = F.array_contains(col, keys[0]) if len(keys) == 1 else F.arrays_overlap(col, F.array(*map(F.lit, keys)))
        tests.append(F.coalesce(found, F.lit(False)))  # a null element makes the built-ins answer null
    elif key_equals(F.lit(None), keys, kind) is not None:
        tests.append(F.exists(col, lambda e: F.coalesce(key_equals(e, keys, kind), F.lit(False))))
    if "null" in keys and not isinstance(kind, T.StringType):
        tests.append(F.exists(col, lambda e: e.isNull()))
    elif "null" in keys:
        tests[0] = tests[0] | F.exists(col, lambda e: e.isNull())
    return reduce(Column.__or__, tests) if tests else None


def key_text(col: Column, kind: T.DataType) -> Column:
    """The key of a column's values as text, as ``canonical_text`` gives it."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_key(col.cast("double"))
    if isinstance(kind, T.DecimalType):
        return trim_zeros(col.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.DateType):
        return F.concat(F.date_format(col, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    return col.cast("string")


def trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number_key(x: Column) -> Column:
    plain = trim_zeros(x.cast("string").cast("decimal(38,17)").cast("string"))
    e = F.regexp_replace(F.lower(x.cast("string")), r"\.0e", "e")
    exponent = F.regexp_replace(e, r"e(\d)", "e+$1")
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), F.lit("NaN"))
        .when(x == float("inf"), F.lit("Infinity"))
        .when(x == float("-inf"), F.lit("-Infinity"))
        .when(x == 0, F.lit("0"))
        .when((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6), exponent)
        .when((x == F.floor(x)) & (F.abs(x) >= 1e17), F.trim(F.format_string("%.0f", x)))
        .otherwise(plain)
    )


def bound(value: object) -> float | int | Decimal | None:
    """A range bound as a number, or None where there is no bound."""
    if value is None or isinstance(value, bool):
        return None if value is None else int(value)
    if isinstance(value, datetime):
        return datetime_ms(value)
    if isinstance(value, date):
        return (value - EPOCH.date()).days * DAY_MS
    if isinstance(value, (int, float, Decimal, np.integer, np.floating)):
        return None if isinstance(value, (float, np.floating)) and math.isnan(value) else value
    return None


def in_range(col: Column, kind: T.DataType, low: object, high: object, as_date: bool) -> Column | None:
    """Rows with a usable value between the bounds, both included; None if no row can be.

    Without bounds this still drops nulls, NaN and text that is no date or number.
    """
    low, high = bound(low), bound(high)
    if low == math.inf or high == -math.inf or (low is not None and high is not None and low > high):
        return None
    low, high = (None if x in (math.inf, -math.inf) else x for x in (low, high))
    tests = [col.isNotNull()]
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        value = F.unix_millis(F.try_to_timestamp(col)) if as_date else F.try_cast(col, "double") if hasattr(F, "try_cast") else col.try_cast("double")
        tests = [value.isNotNull()] + ([] if as_date else [~F.isnan(value)])
        tests += [] if low is None else [value >= F.lit(float(low))]
        tests += [] if high is None else [value <= F.lit(float(high))]
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        first, last = (FIRST_MS if low is None else math.ceil(low)), (LAST_MS if high is None else math.floor(high))
        if first > LAST_MS or last < FIRST_MS:
            return None
        tests += [col >= time_literal(first, kind)] if first > FIRST_MS else []
        tests += [col < time_literal(last + 1, kind)] if last < LAST_MS else []
    elif isinstance(kind, T.DateType):
        first, last = (None if low is None else math.ceil(low / DAY_MS)), (None if high is None else math.floor(high / DAY_MS))
        if (first is not None and first * DAY_MS > LAST_MS) or (last is not None and last * DAY_MS < FIRST_MS):
            return None
        tests += [] if first is None or first * DAY_MS <= FIRST_MS else [col >= date_literal(first)]
        tests += [] if last is None or last * DAY_MS >= LAST_MS - DAY_MS else [col <= date_literal(last)]
    elif type(kind) in INTEGRAL_BITS:
        half = 1 << (INTEGRAL_BITS[type(kind)] - 1)
        first, last = (-half if low is None else math.ceil(low)), (half - 1 if high is None else math.floor(high))
        if first >= half or last < -half:
            return None
        tests += [col >= F.lit(first).cast(kind)] if first > -half else []
        tests += [col <= F.lit(last).cast(kind)] if last < half - 1 else []
    else:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            tests.append(~F.isnan(col))
        wide = col.cast("double") if isinstance(kind, T.FloatType) else col
        exact = (lambda x: F.lit(Decimal(str(x)))) if isinstance(kind, T.DecimalType) else (lambda x: F.lit(float(x)))
        tests += [] if low is None else [wide >= exact(low)]
        tests += [] if high is None else [wide <= exact(high)]
    return reduce(Column.__and__, tests)
