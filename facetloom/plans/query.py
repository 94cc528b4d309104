"""Queries and their normal form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

#: The keys of a query as a plain mapping, and what they are called here.
NAMES = {
    "equal": "equal",
    "notEqual": "not_equal",
    "ranges": "ranges",
    "isNull": "is_null",
    "isNotNull": "is_not_null",
    "limit": "limit",
    "offset": "offset",
    "select": "select",
    "includeFacetCounts": "include_facet_counts",
    "enrichAliases": "enrich_aliases",
}


@dataclass(frozen=True)
class FacetQuery:
    """A conjunctive query; every part is optional."""

    equal: Mapping | None = None
    not_equal: Mapping | None = None
    ranges: Mapping | None = None
    is_null: Sequence[str] | None = None
    is_not_null: Sequence[str] | None = None
    limit: int | None = None
    offset: int | None = None
    select: Sequence[str] | None = None
    include_facet_counts: bool = False
    enrich_aliases: bool | Sequence[str] = False

    @staticmethod
    def of(raw: FacetQuery | Mapping | None = None, **parts) -> FacetQuery:
        """From a query, a mapping in either spelling, or keywords; unknown keys are errors."""
        if isinstance(raw, FacetQuery):
            return raw
        known = {NAMES.get(k, k): v for k, v in {**(raw or {}), **parts}.items()}
        return FacetQuery(**{k: v for k, v in known.items() if v is not None})

    def applied(self) -> dict:
        """The filters as they were asked for."""
        shown = {"equal": self.equal, "notEqual": self.not_equal, "ranges": self.ranges, "isNull": self.is_null, "isNotNull": self.is_not_null}
        return {k: v for k, v in shown.items() if v is not None}


def is_list(value: object) -> bool:
    return isinstance(value, (list, tuple, set, frozenset))


@dataclass
class NormalQuery:
    """Value lists without nulls; nulls have become null tests."""

    equal: dict[str, list] = field(default_factory=dict)
    or_null: set[str] = field(default_factory=set)  # fields whose equal list also takes nulls
    not_equal: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, Mapping] = field(default_factory=dict)
    is_null: list[str] = field(default_factory=list)
    is_not_null: list[str] = field(default_factory=list)

    def fields(self) -> set[str]:
        return {*self.equal, *self.not_equal, *self.ranges, *self.is_null, *self.is_not_null}


def normalize(query: FacetQuery) -> NormalQuery:
    out = NormalQuery(is_null=list(query.is_null or []), is_not_null=list(query.is_not_null or []))
    for name, value in (query.equal or {}).items():
        values = list(value) if is_list(value) else [value]
        some = [v for v in values if v is not None]
        if values and not some:
            out.is_null.append(name)
            continue
        out.equal[name] = some  # empty: no row can match
        if len(some) < len(values):
            out.or_null.add(name)
    for name, value in (query.not_equal or {}).items():
        values = list(value) if is_list(value) else [value]
        some = [v for v in values if v is not None]
        if len(some) < len(values):
            out.is_not_null.append(name)
        if some:
            out.not_equal[name] = some
    out.ranges = {name: r or {} for name, r in (query.ranges or {}).items()}
    return out
