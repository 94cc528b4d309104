"""Saved datasets: Parquet rows, Parquet lookups and a manifest."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import DAY_MS, TIME_TYPES, canonical_text, key_ms, ms_text
from ..operators.dataset import ROW_ID, FacetDataset
from ..operators.facets import facet_counts, split_facets
from ..plans.compiler import column, free_name
from ..plans.manifest import Manifest
from ..plans.query import FacetQuery, NormalQuery, normalize


#: Facet totals that are held on the driver once read; more are looked up in their table.
MAX_HELD = 100_000


def save(dataset: FacetDataset, path: str, cluster_by: Sequence[str] = (), bloom: Sequence[str] = (), mode: str = "error", files: int | None = None, totals: bool = True) -> None:
    """Write a dataset.

    ``cluster_by`` range-partitions and sorts rows by the given columns, so that row
    groups' statistics prune filters on them; ``bloom`` adds bloom filters for point
    lookups.  Both change the layout only: a dataset in scan order keeps its numbers.
    ``totals`` also counts the values of scalar facets, which later answers totals of
    one such facet without a scan.
    """
    rows, order, hidden = dataset.df, dataset.order_by, dataset.hidden
    if not order:
        hidden = free_name(rows.columns, ROW_ID)
        rows, order = rows.withColumn(hidden, F.monotonically_increasing_id()), [hidden]
    if cluster_by:
        columns = [column(c) for c in cluster_by]
        rows = (rows.repartitionByRange(files, *columns) if files else rows.repartitionByRange(*columns)).sortWithinPartitions(*columns)
    elif files:
        rows = rows.repartition(files)
    writer = rows.write.mode(mode)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(f"{path}/items")
    for alias, lookup in dataset.lookups.items():
        lookup.write.mode(mode).parquet(f"{path}/lookups/{alias}")
    spark = rows.sparkSession
    if totals:
        (scalars, _), stored = split_facets(dataset.df, dataset.describe().facets), spark.read.parquet(f"{path}/items")
        flat = [f for some in scalars for f in some]
        facet_counts(stored, flat, with_total=True).write.mode(mode).parquet(f"{path}/totals")
    held = json.dumps({"manifest": dataset.describe().to_dict(), "orderBy": order, "hidden": hidden, "compat": dataset.compat, "totals": totals}, ensure_ascii=False)
    spark.createDataFrame([(held,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> FacetDataset:
    """Open a saved dataset; data is read when queries ask for it."""
    held = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
    manifest = Manifest.from_dict(held["manifest"])
    lookups: dict[str, DataFrame] = {a: spark.read.parquet(f"{path}/lookups/{a}") for a in manifest.aliases}
    out = Saved(spark.read.parquet(f"{path}/items"), manifest, lookups, held["orderBy"], held["compat"])
    out.hidden = held.get("hidden")
    out.counts = spark.read.parquet(f"{path}/totals") if held.get("totals") else None
    return out


def stored_key(key: str, kind: T.DataType) -> str | None:
    """The key under which a value is counted: times may be asked for in more than one spelling."""
    if not isinstance(kind, (*TIME_TYPES, T.DateType)):
        return key
    ms = key_ms(key)
    if ms is None or (isinstance(kind, T.DateType) and ms % DAY_MS):
        return None
    return ms_text(ms)


class Saved(FacetDataset):
    """A dataset read back; its row numbers are a stored column."""

    counts: DataFrame | None = None
    _held: dict | None = None

    def total(self, query=None, **parts) -> int:
        known = self.stored_total(normalize(FacetQuery.of(query, **parts)))
        return super().total(query, **parts) if known is None else known

    def stored_total(self, q: NormalQuery) -> int | None:
        """The number of matches of a query on nothing, or on the values of one scalar facet, from the stored counts."""
        self._open()
        if self.counts is None or q.not_equal or q.ranges or q.is_null or q.is_not_null or q.or_null or len(q.equal) > 1:
            return None
        for name, values in q.equal.items():
            kind = self.df.schema[name].dataType if name in self.df.columns else None
            if name not in self._manifest.facets or kind is None or isinstance(kind, T.ArrayType):
                return None
            return self._stored(name, {stored_key(canonical_text(v), kind) for v in values} - {None})
        return self._stored(None, {""})

    def _stored(self, field: str | None, keys: set[str]) -> int:
        if self._held is None:
            rows = self.counts.limit(MAX_HELD + 1).collect()
            self._held = {(r["field"], r["value"]): r["count"] for r in rows} if len(rows) <= MAX_HELD else {}
        if self._held:
            return sum(self._held.get((field, k), 0) for k in keys)
        some = self.counts.filter(F.col("field").eqNullSafe(F.lit(field)) & F.col("value").isin(list(keys)))
        return some.agg(F.sum("count")).first()[0] or 0
