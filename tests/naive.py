"""A row-at-a-time model of the query semantics, to compare the engine with."""

from __future__ import annotations

import math

from facetloom.functions.keys import canonical_text
from facetloom.plans.query import is_list


def keys_of(value):
    if value is None:
        return set()
    return {canonical_text(v) for v in value} if isinstance(value, list) else {canonical_text(value)}


def matches(row: dict, kinds: dict[str, str], query: dict) -> bool:
    names = [n for part in ("equal", "not_equal", "ranges") for n in query.get(part) or {}]
    if any(n not in kinds for n in [*names, *(query.get("is_null") or []), *(query.get("is_not_null") or [])]):
        return False
    for name, asked in (query.get("equal") or {}).items():
        values = list(asked) if is_list(asked) else [asked]
        ok = None in values and row.get(name) is None
        if kinds[name] == "facet":
            ok = ok or bool(keys_of(row.get(name)) & {canonical_text(v) for v in values if v is not None})
        if not ok:
            return False
    for name, asked in (query.get("not_equal") or {}).items():
        values = list(asked) if is_list(asked) else [asked]
        if None in values and row.get(name) is None:
            return False
        if keys_of(row.get(name)) & {canonical_text(v) for v in values if v is not None}:
            return False
    for name, r in (query.get("ranges") or {}).items():
        v = row.get(name)
        if kinds[name] != "range" or v is None or (isinstance(v, float) and math.isnan(v)):
            return False
        low, high = r.get("min"), r.get("max")
        if low is not None and not math.isnan(low) and v < low:
            return False
        if high is not None and not math.isnan(high) and v > high:
            return False
    return all(row.get(n) is None for n in query.get("is_null") or []) and all(row.get(n) is not None for n in query.get("is_not_null") or [])


def facet_counts(rows: list[dict], facets: list[str]) -> dict:
    out = {f: {} for f in facets}
    for row in rows:
        for f in facets:
            v = row.get(f)
            for x in v if isinstance(v, list) else [] if v is None else [v]:
                k = canonical_text(x)
                out[f][k] = out[f].get(k, 0) + 1
    return out
