"""The manifest: what a dataset's fields are and how they may be queried."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

#: The kinds, types and operators of fields, and the format versions that can be read.
KINDS = ("id", "facet", "range", "meta", "alias")
TYPES = ("string", "number", "boolean", "date")
OPERATORS = {"facet": ["eq", "in"], "alias": ["eq", "in"], "range": ["between", "gte", "lte"]}
MAJORS = ("3", "4")
VERSION = "4.1.0"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    type: str
    target: str | None = None

    @property
    def ops(self) -> list[str]:
        return list(OPERATORS.get(self.kind, []))


@dataclass(frozen=True)
class Manifest:
    dataset_id: str
    fields: tuple[Field, ...]
    built_at: str = ""
    version: str = VERSION
    #: Names that may be queried, by kind; None takes them from the fields.
    capabilities: dict[str, list[str]] | None = field(default=None)

    def of_kind(self, kind: str) -> list[str]:
        return [f.name for f in self.fields if f.kind == kind]

    @property
    def facets(self) -> list[str]:
        return self.of_kind("facet")

    @property
    def ranges(self) -> list[str]:
        return self.of_kind("range")

    @property
    def aliases(self) -> list[str]:
        return self.of_kind("alias")

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def validate(self) -> Manifest:
        """Raise ValueError where the manifest contradicts itself."""
        if not self.version:
            raise ValueError("Invalid manifest: missing version")
        if self.version.split(".")[0] not in MAJORS:
            raise ValueError(f'Unsupported version "{self.version}"; supported majors: {", ".join(MAJORS)}')
        if not self.fields:
            raise ValueError("Invalid manifest: fields must not be empty")
        seen: set[str] = set()
        for f in self.fields:
            if not f.name:
                raise ValueError("Invalid manifest: a field has no name")
            if f.name in seen:
                raise ValueError(f'Invalid manifest: duplicate field name "{f.name}"')
            seen.add(f.name)
            if f.kind not in KINDS:
                raise ValueError(f'Invalid field kind "{f.kind}" for field "{f.name}"; one of {", ".join(KINDS)}')
            if f.type not in TYPES:
                raise ValueError(f'Invalid field type "{f.type}" for field "{f.name}"; one of {", ".join(TYPES)}')
            if f.kind == "range" and f.type not in ("number", "date"):
                raise ValueError(f'Range field "{f.name}" must be a number or a date')
        for f in self.fields:
            if f.kind != "alias":
                continue
            if not f.target:
                raise ValueError(f'"{f.name}" is an alias of nothing: name its target')
            target = self.get(f.target)
            if target is None:
                raise ValueError(f'"{f.name}" is an alias of "{f.target}", but no field is called that')
            if target.kind not in ("facet", "range"):
                raise ValueError(f'"{f.name}" is an alias of "{f.target}", which is of kind {target.kind}; facets and ranges can have aliases')
        for kind, names in (self.capabilities or {}).items():
            one = kind.rstrip("s") if kind != "aliases" else "alias"
            for name in names:
                if name not in seen:
                    raise ValueError(f'Capability {kind} lists "{name}", but no field is called that')
                if self.get(name).kind != one:
                    raise ValueError(f'Capability {kind} lists "{name}", which is no {one} field')
            for name in self.of_kind(one):
                if name not in names:
                    raise ValueError(f'{one} field "{name}" is missing from capability {kind}')
        return self

    def to_dict(self) -> dict:
        fields = [{"name": f.name, "kind": f.kind, "type": f.type, "ops": f.ops} | ({"aliasTarget": f.target} if f.target else {}) for f in self.fields]
        capabilities = {"facets": self.facets, "ranges": self.ranges} | ({"aliases": self.aliases} if self.aliases else {})
        return {"version": self.version, "datasetId": self.dataset_id, "builtAt": self.built_at, "fields": fields, "capabilities": capabilities}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    @staticmethod
    def from_dict(raw: dict) -> Manifest:
        fields = tuple(Field(f.get("name", ""), f.get("kind", ""), f.get("type", ""), f.get("aliasTarget")) for f in raw.get("fields") or [])
        capabilities = raw.get("capabilities")
        if capabilities is not None:
            capabilities = {"facets": [], "ranges": [], "aliases": []} | {k: list(v or []) for k, v in capabilities.items()}
        return Manifest(raw.get("datasetId", ""), fields, raw.get("builtAt", ""), raw.get("version", ""), capabilities).validate()


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
