"""Build configurations: explicit fields, or names by purpose with inferred types."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.inference import field_type, is_simple, range_type
from .manifest import Field, Manifest, now


def manifest_for(df: DataFrame, config: dict) -> Manifest:
    """A validated manifest.

    Explicit: ``{"dataset_id", "fields": {name: {"kind", "type", "target"?}}}``.
    Simple: ``{"dataset_id", "id"?, "facets"? or "equal"?, "ranges"?, "meta"?,
    "aliases"?: {alias: target}, "infer_types"?: "runtime" | "none", "auto_meta"?}``.
    """
    fields = explicit_fields(config["fields"]) if "fields" in config else simple_fields(df, config)
    return Manifest(config.get("dataset_id", ""), tuple(fields), now()).validate()


def explicit_fields(fields: dict) -> list[Field]:
    return [Field(name, f.get("kind", ""), f.get("type", ""), f.get("target")) for name, f in fields.items() if f is not None]


def simple_fields(df: DataFrame, config: dict) -> list[Field]:
    """Later purposes replace earlier ones, but meta replaces nothing."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    infer = config.get("infer_types", "runtime")
    found: dict[str, Field] = {}

    def put(name: str, kind: str, type_: str | None = None, target: str | None = None) -> None:
        found[name] = Field(name, kind, type_ or field_type(kinds.get(name), infer), target)

    own_id = config.get("id") or next((n for n in ("id", "Id", "ID") if n in kinds), None)
    if own_id:
        put(own_id, "id")
    for name in config["equal"] if config.get("equal") is not None else config.get("facets") or []:
        put(name, "facet")
    for name in config.get("ranges") or []:
        put(name, "range", range_type(df, name, infer))
    for name in config.get("meta") or []:
        if name not in found:
            put(name, "meta")
    if config.get("auto_meta", True):
        for name, kind in kinds.items():
            if name not in found and is_simple(kind):
                put(name, "meta")
    for name, target in (config.get("aliases") or {}).items():
        put(name, "alias", target=target)
    return list(found.values())
