"""Normal queries to one predicate that Catalyst can push down."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import TIME_TYPES, canonical_text, in_range, key_equals, key_text
from .manifest import Manifest
from .query import NormalQuery

log = logging.getLogger(__name__)

#: Ids of an alias that become literals; more are joined.
MAX_LITERALS = 10_000
PREVIEW = 5


@dataclass
class Plan:
    """What to do with the rows: nothing can match, or a predicate and joins on alias targets."""

    empty: bool = False
    predicate: Column | None = None
    #: (target, ids, whether they are wanted, field whose nulls are wanted too) for aliases with too many ids for literals.
    joins: tuple[tuple[str, DataFrame, bool, str | None], ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        if self.empty:
            return df.limit(0)
        out = df if self.predicate is None else df.where(self.predicate)
        for target, ids, wanted, or_null in self.joins:
            out = restricted(out, target, ids, wanted, or_null)
        return out


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores in front until no column has that name."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = "_" + base
    return base


def same_value(kind: T.DataType, value: Column) -> Column:
    """What is equal for equal values: times count by the millisecond."""
    return key_text(value, kind) if isinstance(kind, TIME_TYPES) else value


def restricted(df: DataFrame, target: str, ids: DataFrame, wanted: bool, or_null: str | None) -> DataFrame:
    """The rows whose target (any element, for arrays) is among ``ids``, or is not, by joins; all columns stay."""
    key, marker = free_name(df.columns, "__key"), free_name(df.columns, "__in")
    kind = df.schema[target].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    held = ids.select(same_value(inner, F.col(ids.columns[0])).alias(key)).distinct()
    if isinstance(kind, T.ArrayType):
        # Few arrays are distinct, so those that have such an element are found first and then joined whole.
        arrays = df.select(column(target).alias("a")).distinct()
        each = arrays.select("a", F.explode("a").alias("e")).select("a", same_value(inner, F.col("e")).alias(key))
        held = each.join(held, key, "left_semi").select(F.col("a").alias(key)).distinct()
        test = column(target) == F.col(key)
    else:
        test = same_value(kind, column(target)) == F.col(key)
    if not wanted:
        return df.join(held, test, "left_anti")
    if or_null is None:
        return df.join(held, test, "left_semi")
    found = df.join(held.withColumn(marker, F.lit(True)), test, "left")
    return found.where(F.col(marker).isNotNull() | column(or_null).isNull()).select(*[column(c) for c in df.columns])


#: ids of the values of an alias field: (alias, values) to (ids, values without a mapping, table of ids if there are too many)
Resolver = Callable[[str, list[str]], tuple[list, list[str], DataFrame | None]]

NEVER = Plan(empty=True)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def both(tests: list[Column]) -> Column | None:
    return reduce(Column.__and__, tests) if tests else None


class Compiler:
    def __init__(self, manifest: Manifest, schema: T.StructType, resolve: Resolver, compat: bool = False):
        self.manifest, self.resolve, self.compat = manifest, resolve, compat
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def kind(self, name: str) -> T.DataType:
        return self.kinds.get(name, T.NullType())

    def col(self, name: str) -> Column:
        """A declared column that the data does not have is null throughout."""
        return column(name) if name in self.kinds else F.lit(None)

    def compile(self, q: NormalQuery, is_empty: Callable[[Column | None], bool] | None = None) -> Plan:
        """``is_empty`` tells whether a predicate finds nothing; only ``compat`` asks it."""
        if any(self.manifest.get(name) is None for name in q.fields()):
            return NEVER
        if any(name not in self.manifest.ranges for name in q.ranges):
            return NEVER
        joins: list[tuple[str, DataFrame, bool, str | None]] = []
        equal = self.constraints(q.equal, "equal", joins, q.or_null)
        tests: list[Column] = []
        if self.compat:
            found = [self.equals(f, values) for f, values, _ in self.last_wins(equal)]
            if any(t is None for t in found):
                return NEVER
            base = both(found)
            nullable = [self.col(f).isNull() for f in q.or_null if f in self.kinds and self.manifest.get(f).kind in ("facet", "range", "alias")]
            if q.or_null and is_empty is not None and is_empty(base):
                return NEVER
            if base is not None:
                tests.append(reduce(Column.__or__, [base, *nullable]))
        else:
            for f, values, asked in equal:
                test = self.equals(f, values)
                if asked in q.or_null:
                    null = self.col(asked).isNull()
                    test = null if test is None else test | null
                if test is None:
                    return NEVER
                tests.append(test)
        for name, r in q.ranges.items():
            test = in_range(self.col(name), self.kind(name), r.get("min"), r.get("max"), self.manifest.get(name).type == "date") if name in self.kinds else None
            if test is None:
                return NEVER
            tests.append(test)
        tests += [self.col(f).isNull() for f in q.is_null if not (self.compat and f in q.or_null)]
        tests += [self.col(f).isNotNull() for f in q.is_not_null]
        excluded = self.constraints(q.not_equal, "not_equal", joins)
        for f, values, _ in self.last_wins(excluded) if self.compat else excluded:
            test = key_equals(self.col(f), map(canonical_text, values), self.kind(f)) if f in self.kinds else None
            if test is not None:
                tests.append(self.col(f).isNull() | ~test)
        return Plan(predicate=both(tests), joins=tuple(joins))

    def equals(self, name: str, values: list) -> Column | None:
        """Only facets are looked up by value; on any other field no row matches."""
        if self.manifest.get(name).kind != "facet" or name not in self.kinds:
            return None
        return key_equals(self.col(name), map(canonical_text, values), self.kind(name))

    def constraints(self, filters: dict[str, list], operator: str, joins: list, or_null: Iterable[str] = ()) -> list[tuple[str, list, str]]:
        """(field, values, field asked for), with aliases resolved to their targets."""
        out = []
        for name, values in filters.items():
            f = self.manifest.get(name)
            if f.kind != "alias":
                out.append((name, values, name))
                continue
            ids, unmapped, table = self.resolve(name, [canonical_text(v) for v in values])
            if unmapped:
                more = f", +{len(unmapped) - PREVIEW} more" if len(unmapped) > PREVIEW else ""
                log.warning("No mapping found for %s='%s'%s in %s; dropped", name, ", ".join(unmapped[:PREVIEW]), more, operator)
            target = self.manifest.get(f.target)
            if table is not None and operator == "equal" and (target.kind != "facet" or f.target not in self.kinds):
                out.append((f.target, [], name))  # only facets are looked up by value
            elif table is not None:
                if f.target in self.kinds:
                    joins.append((f.target, table, operator == "equal", name if name in or_null and name in self.kinds else None))
            elif ids or operator == "equal":
                out.append((f.target, ids, name))
        return out

    @staticmethod
    def last_wins(found: list[tuple[str, list, str]]) -> list[tuple[str, list, str]]:
        return list({f: (f, values, asked) for f, values, asked in found}.values())
