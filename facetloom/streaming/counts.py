"""Running facet counts over a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facets import counted, exploded_counts, no_occurrences, occurrences
from ..plans.compiler import Compiler, column
from ..plans.manifest import Manifest
from ..plans.query import FacetQuery, normalize


def no_aliases(alias: str, keys: list[str]):
    raise ValueError(f"Alias '{alias}' needs a snapshot's lookup; filter streams on canonical fields")


def matching(stream: DataFrame, manifest: Manifest, query: FacetQuery | Mapping | None = None, **parts) -> DataFrame:
    """The rows of a stream that a query matches, by the predicate that snapshots use."""
    plan = Compiler(manifest, stream.schema, no_aliases).compile(normalize(FacetQuery.of(query, **parts)))
    return stream.where(F.lit(False)) if plan.empty else plan.apply(stream)


def stream_facet_counts(stream: DataFrame, manifest: Manifest, query: FacetQuery | Mapping | None = None, **parts) -> DataFrame:
    """(field, value, count) so far; for output modes update and complete.  Without facets there are no rows."""
    return exploded_counts(matching(stream, manifest, query, **parts), [f for f in manifest.facets if f in stream.columns])


def windowed_facet_counts(stream: DataFrame, manifest: Manifest, time: str, width: str, late: str, query: FacetQuery | Mapping | None = None, **parts) -> DataFrame:
    """(window, field, value, count) by event time; the watermark bounds the state."""
    rows = matching(stream, manifest, query, **parts).withWatermark(time, late)
    facets = [f for f in manifest.facets if f in stream.columns]
    kinds = {f.name: f.dataType for f in stream.schema.fields if f.name in facets}
    each = [occurrences(f, kinds[f]) for f in facets] or [no_occurrences()]
    timed = rows.select(F.window(column(time), width).alias("window"), *[column(f) for f in facets])
    return counted(timed.select("window", F.inline(F.concat(*each) if len(each) > 1 else each[0])), kinds, "window")
