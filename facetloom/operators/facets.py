"""Facet counts and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import INTEGRAL_BITS, TIME_TYPES, canonical_text, key_text, number_key
from ..plans.compiler import column

#: Facets in one aggregate: the number of a grouping set has a bit for each.
MAX_SETS = 48
#: Columns that hold facet values until they are counted: texts, doubles, whole numbers and booleans.
HOLDERS = {"s": "string", "d": "double", "l": "long"}


def holder(kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "d"
    return "l" if type(kind) in INTEGRAL_BITS or isinstance(kind, T.BooleanType) else "s"


def occurrences(name: str, kind: T.DataType) -> Column:
    """(field, s, d, l) for each value that a row counts for: each element of an array, duplicates too.

    Values keep their type here; the few distinct ones are turned into text later.
    """

    def held(value: Column, of: T.DataType, absent: Column) -> Column:
        at = holder(of)
        own = key_text(value, of) if at == "s" else value.cast(HOLDERS[at])
        cells = {h: own if h == at else F.lit(None).cast(t) for h, t in HOLDERS.items()}
        cells["s"] = F.coalesce(cells["s"], F.when(value.isNull(), absent))
        return F.struct(F.lit(name).alias("field"), *[c.alias(h) for h, c in cells.items()])

    if isinstance(kind, T.ArrayType):
        each = F.transform(column(name), lambda e: held(e, kind.elementType, F.lit("null")))
        return F.coalesce(each, F.array().cast("array<struct<field:string,s:string,d:double,l:bigint>>"))
    return F.array(held(column(name), kind, F.lit(None).cast("string")))


def no_occurrences() -> Column:
    return F.array().cast("array<struct<field:string,s:string,d:double,l:bigint>>")


def counted(pairs: DataFrame, kinds: dict[str, T.DataType], *by: str) -> DataFrame:
    """(by, field, value, count) of occurrences, in one partial and final aggregate."""
    some = F.col("field").isNull() | F.coalesce(F.col("s").isNotNull() | F.col("d").isNotNull() | F.col("l").isNotNull(), F.lit(False))
    groups = pairs.filter(some).groupBy(*by, "field", *HOLDERS).agg(F.count(F.lit(1)).alias("count"))
    inner = {f: k.elementType if isinstance(k, T.ArrayType) else k for f, k in kinds.items()}
    booleans = [f for f, k in inner.items() if isinstance(k, T.BooleanType)]
    whole = F.col("l").cast("string")
    if booleans:
        whole = F.when(F.col("field").isin(booleans), (F.col("l") == 1).cast("string")).otherwise(whole)
    return groups.select(*by, "field", F.coalesce("s", whole, number_key(F.col("d")), F.lit("")).alias("value"), "count")


def exploded_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(field, value, count) by exploding rows into values: for arrays, and for streams."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in facets}
    parts = [occurrences(f, kinds[f]) for f in facets] or [no_occurrences()]
    return counted(df.select(F.inline(F.concat(*parts) if len(parts) > 1 else parts[0])), kinds)


def grouping(df: DataFrame, facets: list[str]) -> DataFrame:
    """(g0, g1, ..., count, set): scalar facets as grouping sets over one scan, and the number of rows as the empty set."""
    names, kinds = [f"g{i}" for i in range(len(facets))], {f.name: f.dataType for f in df.schema.fields}
    # Times of the same millisecond are one value.
    value = lambda f: key_text(column(f), kinds[f]) if isinstance(kinds[f], TIME_TYPES) else column(f)
    rows = df.select(*[value(f).alias(n) for f, n in zip(facets, names, strict=True)])
    return rows.groupingSets([*[[n] for n in names], []], *names).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("set"))


def set_of(at: int, n: int) -> int:
    """The number of the grouping set of one of ``n`` columns: a bit for each column left out, the first the highest."""
    return (1 << n) - 1 ^ (1 << (n - 1 - at))


def grouped_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(field, value, count) of scalar facets; the row of null field has the number of rows."""
    groups, n = grouping(df, facets), len(facets)
    field, value = F.lit(None).cast("string"), F.when(F.col("set") == (1 << n) - 1, F.lit(""))
    for i, f in enumerate(facets):
        own, text = F.col("set") == set_of(i, n), key_text(F.col(f"g{i}"), groups.schema[f"g{i}"].dataType)
        field, value = F.when(own, F.lit(f)).otherwise(field), F.when(own, text).otherwise(value)
    return groups.select(field.alias("field"), value.alias("value"), "count").filter("value IS NOT NULL")


def split_facets(df: DataFrame, facets: list[str]) -> tuple[list[list[str]], list[str]]:
    """Scalar facets, so many at a time as one aggregate takes, and array facets."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    arrays = [f for f in facets if isinstance(kinds.get(f), T.ArrayType)]
    scalars = [f for f in facets if f in kinds and f not in arrays]
    return [scalars[i : i + MAX_SETS] for i in range(0, len(scalars), MAX_SETS)], arrays


def collected_counts(df: DataFrame, facets: list[str]) -> tuple[int, dict[str, dict[str, int]]]:
    """The number of rows, and counts by field and key: a row for each distinct value comes to the driver."""
    out: dict[str, dict[str, int]] = {f: {} for f in facets}
    scalars, arrays = split_facets(df, facets)
    total = None
    for some in scalars or [[]]:
        if not some:
            total = df.count()
            break
        for r in grouping(df, some).collect():
            at = next((i for i in range(len(some)) if r["set"] == set_of(i, len(some))), None)
            if at is None:
                total = r["count"]
            elif r[at] is not None:
                key = canonical_text(r[at])
                out[some[at]][key] = out[some[at]].get(key, 0) + r["count"]
    if arrays:
        for r in exploded_counts(df, arrays).collect():
            out[r["field"]][r["value"]] = r["count"]
    return total or 0, out


def facet_counts(df: DataFrame, facets: list[str], with_total: bool = False) -> DataFrame:
    """(field, value, count): scalar facets in one aggregate over one scan, array facets in another.

    With ``with_total`` one more row, of null field, has the number of rows.
    """
    scalars, arrays = split_facets(df, facets)
    parts = [grouped_counts(df, some) for some in scalars]
    parts = [p if with_total and not i else p.filter("field IS NOT NULL") for i, p in enumerate(parts)]
    if with_total and not parts:
        parts.append(df.select(F.lit(None).cast("string").alias("field"), F.lit("").alias("value")).groupBy("field", "value").count())
    if arrays:
        parts.append(exploded_counts(df, arrays))
    if not parts:
        return df.sparkSession.createDataFrame([], "field string, value string, count long")
    return reduce(DataFrame.unionByName, parts)


def facet_summary(df: DataFrame, name: str) -> DataFrame:
    """(value, count) of one facet: typed values, sorted; dates as epoch milliseconds, text by Unicode collation."""
    kind = df.schema[name].dataType
    value = column(name)
    if isinstance(kind, T.ArrayType):
        df, kind, value = df.select(F.explode(value).alias("v")), kind.elementType, F.col("v")
    if isinstance(kind, T.DateType):
        value = F.unix_millis(value.cast("timestamp"))
    elif isinstance(kind, TIME_TYPES):
        value = F.unix_millis(value.cast("timestamp"))
    found = df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    order = [F.collate("value", "UNICODE"), F.col("value")] if isinstance(kind, T.StringType) else [F.col("value")]
    return found.orderBy(*order)
