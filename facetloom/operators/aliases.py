"""Aliases: many-to-many lookups between readable values and canonical ids."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_equals, key_text
from ..plans.compiler import MAX_LITERALS, column, free_name
from ..plans.manifest import Field

log = logging.getLogger(__name__)


def build_lookup(df: DataFrame, alias: Field, order: list[Column]) -> DataFrame:
    """(alias_value, canonical_id, first_row): the distinct pairs, by first appearance.

    Rows in which either side is null have no pair; array columns have none at all.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    own, target = kinds.get(alias.name), kinds.get(alias.target)
    if own is None or target is None or isinstance(own, T.ArrayType) or isinstance(target, T.ArrayType):
        log.warning("Alias '%s' → '%s': no valid pairs; arrays and absent columns have none", alias.name, alias.target)
        id_type = target.elementType if isinstance(target, T.ArrayType) else target or T.StringType()
        schema = T.StructType([T.StructField("alias_value", T.StringType()), T.StructField("canonical_id", id_type), T.StructField("first_row", T.StructType([T.StructField("o0", T.LongType())]))])
        return df.sparkSession.createDataFrame([], schema)
    pairs = df.select(key_text(column(alias.name), own).alias("alias_value"), column(alias.target).alias("canonical_id"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("first_row"))
    return pairs.filter("alias_value IS NOT NULL AND canonical_id IS NOT NULL").groupBy("alias_value", "canonical_id").agg(F.min("first_row").alias("first_row"))


def pair_counts(df: DataFrame, alias: Field) -> tuple[int, int, int]:
    """Rows with both sides, without the alias, without the target; warns if pairs are missing."""
    a, t = column(alias.name).isNotNull(), column(alias.target).isNotNull()
    pairs, no_alias, no_target = df.agg(F.count(F.when(a & t, 1)), F.count(F.when(~a, 1)), F.count(F.when(~t, 1))).first()
    if not pairs or no_alias or no_target:
        log.warning("Alias '%s' → '%s': %d valid pairs, %d missing alias, %d missing target", alias.name, alias.target, pairs, no_alias, no_target)
    return pairs, no_alias, no_target


def resolve(lookup: DataFrame, keys: list[str], most: int | None = MAX_LITERALS) -> tuple[list, list[str], DataFrame | None]:
    """Ids of alias values, the values without one, and the ids as a table if they are more than ``most``."""
    found = lookup.filter(column("alias_value").isin(keys)) if keys else lookup.limit(0)
    pairs = found.select("alias_value", "canonical_id")
    rows = (pairs if most is None else pairs.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        mapped = {r[0] for r in found.select("alias_value").distinct().collect()}  # at most the values asked for
        return [], [k for k in keys if k not in mapped], found.select("canonical_id").distinct()
    mapped = {r["alias_value"] for r in rows}
    return list(dict.fromkeys(r["canonical_id"] for r in rows)), [k for k in keys if k not in mapped], None


def alias_values(lookup: DataFrame, key: str) -> DataFrame:
    """(value): the alias values of one id, by first appearance."""
    test = key_equals(column("canonical_id"), [key], lookup.schema["canonical_id"].dataType)
    found = lookup.limit(0) if test is None else lookup.filter(test)
    return found.orderBy("first_row", "alias_value").select(F.col("alias_value").alias("value"))


def enrich(page: DataFrame, aliases: list[Field], lookups: dict[str, DataFrame]) -> DataFrame:
    """``page`` with each alias column as the array of its id's alias values.

    Rows whose id is null or has no alias keep their own value, as an array of one.
    An array of ids gets the union of their aliases in element order.
    """
    out = page
    for alias in aliases:
        if alias.target not in page.columns:
            continue
        kind = page.schema[alias.target].dataType
        own = F.when(column(alias.name).isNotNull(), F.array(column(alias.name).cast("string"))) if alias.name in page.columns else F.lit(None).cast("array<string>")
        if isinstance(kind, T.ArrayType):
            out = enrich_arrays(out, alias, lookups[alias.name], own)
            continue
        wanted = page.select(column(alias.target).alias("canonical_id")).distinct()
        key, found = free_name(out.columns, "__id"), free_name(out.columns, "__names")
        names = named(lookups[alias.name].join(wanted, "canonical_id", "left_semi")).withColumnsRenamed({"canonical_id": key, "names": found})
        joined = out.join(names, column(alias.target) == column(key), "left")
        out = joined.withColumn(alias.name, F.coalesce(column(found), own)).drop(key, found)
    return out


def named(lookup: DataFrame) -> DataFrame:
    """(canonical_id, names): an id's aliases by first appearance."""
    gathered = F.array_sort(F.collect_list(F.struct("first_row", "alias_value")))
    return lookup.groupBy("canonical_id").agg(F.transform(gathered, lambda p: p["alias_value"]).alias("names"))


def enrich_arrays(page: DataFrame, alias: Field, lookup: DataFrame, own: Column) -> DataFrame:
    # Rows with the same ids get the same names, so the distinct arrays are looked up.
    key, got = free_name(page.columns, "__ids"), free_name(page.columns, "__names")
    single = page.select(column(alias.target).alias("ids")).distinct().select("ids", F.posexplode("ids").alias("pos", "canonical_id"))
    found = single.join(named(lookup), "canonical_id").groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("pos", "names"))).alias("found"))
    names = F.array_distinct(F.flatten(F.transform("found", lambda p: p["names"])))
    found = found.select(F.col("ids").alias(key), names.alias(got))
    return page.join(found, column(alias.target) == column(key), "left").withColumn(alias.name, F.coalesce(column(got), own)).drop(key, got)
