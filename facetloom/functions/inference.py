"""Field types from a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = (T.StringType, T.VarcharType, T.CharType)
TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_simple(kind: T.DataType) -> bool:
    """Scalars, and arrays of scalars."""
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return not isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.BinaryType, T.VariantType))


def field_type(kind: T.DataType | None, infer: str = "runtime") -> str:
    """The declared type of a column; arrays have that of their elements."""
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if kind is None or infer == "none":
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    return "date" if isinstance(kind, TIME) else "string"


def range_type(df: DataFrame, name: str, infer: str = "runtime") -> str:
    """number or date; a text column is judged by its first value."""
    kind = df.schema[name].dataType if name in df.columns else None
    if kind is None or infer == "none" or isinstance(kind, (T.NumericType, T.NullType)):
        return "number"
    if isinstance(kind, TIME):
        return "date"
    if isinstance(kind, TEXT):
        col = F.col(f"`{name}`")
        found = df.select(col.alias("v"), F.try_to_timestamp(col).alias("t")).filter("v IS NOT NULL").take(1)
        if not found or found[0]["t"] is not None:
            return "date" if found else "number"
        raise ValueError(f'Cannot infer range type for field "{name}": "{found[0]["v"]}" is neither a number nor a date')
    raise ValueError(f'Cannot infer range type for field "{name}": unsupported type {kind.simpleString()}')
