"""A query's JSON Schema, and that schema as a function tool for agents."""

from __future__ import annotations

from .manifest import Manifest

#: What the schema says of each part of a query, and of a dataset.
SAYS = {
    "equal": "Equality filters (exact match or IN semantics)",
    "notEqual": "Inequality filters (NOT equal or NOT IN)",
    "ranges": "Range filters (min/max bounds per field)",
    "isNull": "Keep rows where each of these fields is empty",
    "isNotNull": "Keep rows where each of these fields has a value",
    "limit": "Maximum number of results to return",
    "offset": "Number of results to skip (for pagination)",
    "includeFacetCounts": "Include facet counts in the response",
    "enrichAliases": "Fill in the readable names of ids: true for every alias, or a list of the aliases wanted",
    "min": "Minimum value (inclusive)",
    "max": "Maximum value (inclusive)",
    "date": "min/max as Unix ms",
    "number": "numeric range",
    "dataset": 'Query dataset "{}" using explicit filter operators (equal, notEqual, ranges, isNull, isNotNull).',
    "aliases": " Ids may also be asked for by their names, through these fields: {}.",
}


def value_schema(kind: str) -> dict:
    """One value, null, or a list of either."""
    return {"anyOf": [{"type": kind}, {"type": "null"}, {"type": "array", "items": {"anyOf": [{"type": kind}, {"type": "null"}]}}]}


def query_schema(manifest: Manifest) -> dict:
    """What a query over this manifest may say."""
    by_value = {}
    for name in [*manifest.facets, *manifest.aliases]:
        f = manifest.get(name)
        by_value[name] = value_schema(f.type if f.kind == "facet" and f.type in ("number", "boolean") else "string")
    bounds = {end: {"type": "number", "description": SAYS[end]} for end in ("min", "max")}
    by_range = {name: closed(SAYS[manifest.get(name).type], bounds) for name in manifest.ranges}
    nullable = {"type": "string", "enum": list(by_value)}
    parts = {name: closed(SAYS[name], dict(own)) for name, own in (("equal", by_value), ("notEqual", by_value), ("ranges", by_range))}
    parts |= {name: {"type": "array", "description": SAYS[name], "items": nullable} for name in ("isNull", "isNotNull")}
    parts |= {name: {"type": "number", "description": SAYS[name]} for name in ("limit", "offset")}
    parts["includeFacetCounts"] = {"type": "boolean", "description": SAYS["includeFacetCounts"]}
    if manifest.aliases:
        some = {"type": "array", "items": {"type": "string", "enum": manifest.aliases}}
        parts["enrichAliases"] = {"anyOf": [{"type": "boolean"}, some], "description": SAYS["enrichAliases"]}
    return {"type": "object", "properties": parts, "additionalProperties": False}


def closed(description: str, properties: dict) -> dict:
    return {"type": "object", "description": description, "properties": properties, "additionalProperties": False}


def function_tool(manifest: Manifest, name: str, description: str | None = None) -> dict:
    """The schema as a function tool; the default description names the dataset and its aliases."""
    if not description:
        description = SAYS["dataset"].format(manifest.dataset_id)
        if manifest.aliases:
            description += SAYS["aliases"].format(", ".join(manifest.aliases))
    return {"type": "function", "function": {"name": name, "description": description, "parameters": query_schema(manifest)}}
