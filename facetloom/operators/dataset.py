"""A queryable snapshot: a DataFrame, its manifest and its alias lookups."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import canonical_text
from ..plans.compiler import MAX_LITERALS, Compiler, Plan, column, free_name
from ..plans.config import manifest_for
from ..plans.manifest import Manifest
from ..plans.query import FacetQuery, normalize
from . import aliases as al
from . import facets as fc

log = logging.getLogger(__name__)

ROW_ID = "__row_id"


@dataclass
class FacetResult:
    """Lazy parts of an answer: rows, total and counts each run when asked for."""

    items: DataFrame
    matches: DataFrame
    facets: DataFrame | None
    applied: dict
    snapshot: dict
    facet_fields: list[str] = field(default_factory=list)

    @cached_property
    def total(self) -> int:
        """Matches before the page is cut; free once the facet counts have been collected."""
        return self._counted[0] if "_counted" in self.__dict__ else self.matches.count()

    @cached_property
    def _counted(self) -> tuple[int, dict[str, dict[str, int]]]:
        return fc.collected_counts(self.matches, self.facet_fields)

    @property
    def facet_dict(self) -> dict[str, dict[str, int]] | None:
        """Counts by field and key: a row for each distinct value."""
        return None if self.facets is None else self._counted[1]


class FacetDataset:
    """Filters, pages, counts and describes an immutable table.

    ``order_by`` names the columns that give rows their order; by default the id
    field, else the order of the scan: file and place in it for Parquet files, else the
    order in which partitions come.  Pages come in that order, enriched or not; all
    matches at once come as the scan and its joins give them.  With ``compat`` the odd corners of null lists
    and repeated targets follow the order in which filters apply (see README).
    """

    def __init__(self, df: DataFrame, manifest: Manifest, lookups: dict[str, DataFrame], order_by: Sequence[str] = (), compat: bool = False):
        self._df, self._manifest, self._lookups, self.compat = df, manifest, lookups, compat
        self._order_by = list(order_by)
        self._row_id = free_name(df.columns, ROW_ID)
        self._disposed = False

    #: A column that orders rows and does not show in results.
    hidden: str | None = None
    #: Ids of an alias that become literals; more are joined.
    max_literals: int = MAX_LITERALS

    @staticmethod
    def create(df: DataFrame, config: Mapping, order_by: str | Sequence[str] | None = None, compat: bool = False, check: bool = False) -> FacetDataset:
        """Build from a table and a configuration.  ``check`` scans the alias columns for missing pairs and warns."""
        manifest = manifest_for(df, dict(config))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        absent = [f.name for f in manifest.fields if f.name not in kinds]
        if absent:
            log.warning("Configured fields that no row has: %s", ", ".join(absent))
        for f in manifest.fields:
            kind = kinds.get(f.name)
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if f.kind == "facet" and isinstance(inner, (T.StructType, T.MapType, T.ArrayType, T.BinaryType)):
                raise ValueError(f'Facet field "{f.name}" has type {kind.simpleString()}; only scalars and arrays of scalars can be facets')
            if f.kind == "range" and isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.BinaryType, T.BooleanType)):
                raise ValueError(f'Range field "{f.name}" has type {kind.simpleString()}')
        order = [order_by] if isinstance(order_by, str) else list(order_by or [f for f in manifest.of_kind("id") if f in kinds])
        out = FacetDataset(df, manifest, {}, order, compat)
        for f in manifest.fields:
            if f.kind == "alias":
                out._lookups[f.name] = out._build_lookup(f).persist()  # made by the first query that needs it
                if check and f.name in kinds and f.target in kinds:
                    al.pair_counts(df, f)
        return out

    def _build_lookup(self, alias) -> DataFrame:
        ordered = self._ordered(self._df)
        return al.build_lookup(ordered, alias, self._order(ordered))

    def _ordered(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that order it; scan order needs a number for each row."""
        if self._order_by:
            return df
        if "_metadata" not in df.columns:
            try:  # a place in a file does not depend on how the scan is split
                return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(self._row_id))
            except AnalysisException:
                pass
        return df.withColumn(self._row_id, F.monotonically_increasing_id())

    def _order(self, df: DataFrame) -> list[Column]:
        return [column(c) for c in self._order_by or [self._row_id]]

    def _open(self) -> None:
        if self._disposed:
            raise RuntimeError("Cannot use a disposed dataset")

    @property
    def df(self) -> DataFrame:
        self._open()
        return self._df

    @property
    def lookups(self) -> dict[str, DataFrame]:
        self._open()
        return self._lookups

    @property
    def order_by(self) -> list[str]:
        return list(self._order_by)

    def plan(self, query: FacetQuery | Mapping | None = None, **parts) -> Plan:
        """The predicate of a query, without running it."""
        self._open()
        q = normalize(FacetQuery.of(query, **parts))
        compiler = Compiler(self._manifest, self._df.schema, self._resolve, self.compat)
        return compiler.compile(q, lambda p: (self._df if p is None else self._df.where(p)).isEmpty())

    def _resolve(self, alias: str, keys: list[str]):
        if alias not in self._lookups:
            raise ValueError(f"Alias field '{alias}' has no lookup")
        # The order in which filters apply (compat) is that of one predicate, so it takes any number of literals.
        return al.resolve(self._lookups[alias], keys, None if self.compat else self.max_literals)

    def query(self, query: FacetQuery | Mapping | None = None, **parts) -> FacetResult:
        """Rows that meet every filter, one page of them, and on demand their number and facet counts."""
        q = FacetQuery.of(query, **parts)
        plan = self.plan(q)
        matches = plan.apply(self._df)
        page = self._page(plan, q)
        if q.select is not None:
            page = page.select(*[column(c) for c in dict.fromkeys(q.select) if c in page.columns])
        chosen = self._enrichable(q.enrich_aliases)
        if chosen and (q.limit is not None or max(0, q.offset or 0)):
            number = free_name([*page.columns, *(a.name for a in chosen)], "__number")
            page = al.enrich(page.withColumn(number, F.monotonically_increasing_id()), chosen, self._lookups).orderBy(number).drop(number)
        elif chosen:
            page = al.enrich(page, chosen, self._lookups)
        if self.hidden:
            page = page.drop(self.hidden)
        counted = [f for f in self._manifest.facets if f in self._df.columns]
        wants = q.include_facet_counts and not (self.compat and plan.empty)
        facets = fc.facet_counts(matches, counted) if wants else None
        return FacetResult(page, matches, facets, q.applied(), self.snapshot(), self._manifest.facets)

    def _page(self, plan: Plan, q: FacetQuery) -> DataFrame:
        if q.limit is None and not max(0, q.offset or 0):
            return plan.apply(self._df)  # all matches: their order is the caller's affair
        if self._order_by:
            rows = plan.apply(self._df).orderBy(*self._order(self._df))
        else:  # rows are numbered before the filter, which then stays above the scan
            rows = plan.apply(self._ordered(self._df)).orderBy(self._row_id)
        if q.offset:
            rows = rows.offset(max(0, int(q.offset)))
        if q.limit is not None:
            rows = rows.limit(max(0, int(q.limit)))
        return rows.select(*[column(c) for c in self._df.columns])

    def _enrichable(self, asked: bool | Sequence[str]) -> list:
        names = self._manifest.aliases if asked is True else [a for a in self._manifest.aliases if a in (asked or ())]
        return [self._manifest.get(a) for a in names]

    def total(self, query: FacetQuery | Mapping | None = None, **parts) -> int:
        return self.query(query, **parts).total

    def totals(self, queries: Sequence[FacetQuery | Mapping], at_once: int = 32) -> list[int]:
        """The totals of many queries, from one scan and one aggregate for every ``at_once`` of them."""
        plans = [self.plan(q) for q in queries]
        out = [p.apply(self._df).count() if p.joins else 0 for p in plans]
        together = [i for i, p in enumerate(plans) if not p.empty and not p.joins]
        for at in range(0, len(together), at_once):
            some = together[at : at + at_once]
            every = F.lit(True)
            row = self._df.agg(*[F.count_if(every if plans[i].predicate is None else plans[i].predicate).alias(f"q{i}") for i in some]).first()
            for i in some:
                out[i] = row[f"q{i}"]
        return out

    def facet_summary(self, name: str, equal: Mapping | None = None, ranges: Mapping | None = None) -> DataFrame:
        """(value, count) of one facet over the filtered rows; empty for a field that is no facet."""
        self._open()
        if name not in self._manifest.facets or name not in self._df.columns:
            return self._df.sparkSession.createDataFrame([], "value string, count long")
        return fc.facet_summary(self.plan(equal=equal, ranges=ranges).apply(self._df), name)

    def alias_values(self, alias: str, canonical_id: object) -> list[str]:
        """The alias values of an id; none for an unknown alias or id."""
        self._open()
        if alias not in self._lookups or canonical_id is None:
            return []
        return [r["value"] for r in al.alias_values(self._lookups[alias], canonical_text(canonical_id)).collect()]

    def lookup(self, alias: str) -> DataFrame:
        """(alias_value, canonical_id) pairs of an alias."""
        return self.lookups[alias].select("alias_value", "canonical_id")

    def enrich(self, items: DataFrame, alias_fields: Sequence[str]) -> DataFrame:
        """``items`` with alias columns filled in; fields that are no aliases are passed over."""
        self._open()
        return al.enrich(items, self._enrichable(tuple(alias_fields)), self._lookups)

    def describe(self) -> Manifest:
        return self._manifest

    def snapshot(self) -> dict:
        m = self._manifest
        return {"datasetId": m.dataset_id, "builtAt": m.built_at, "indexVersion": m.version}

    @property
    def is_disposed(self) -> bool:
        return self._disposed

    def persist(self) -> FacetDataset:
        """Cache the rows, with their numbers where scan order counts."""
        self._open()
        if not self._order_by:
            self._df, self.hidden = self._ordered(self._df), self._row_id
            self._order_by = [self._row_id]
        self._df.persist()
        return self

    def dispose(self) -> None:
        """Release cached data; queries raise from now on, descriptions stay."""
        if not self._disposed:
            for held in (self._df, *self._lookups.values()):
                held.unpersist()
            self._disposed = True
