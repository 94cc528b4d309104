"""Faceted queries over dataset snapshots, on Spark."""

from .operators.dataset import FacetDataset, FacetResult
from .plans.manifest import Field, Manifest
from .plans.query import FacetQuery
from .plans.tool_schema import function_tool, query_schema
from .sources.store import load, save

__all__ = ["FacetDataset", "FacetQuery", "FacetResult", "Field", "Manifest", "function_tool", "load", "query_schema", "save"]
