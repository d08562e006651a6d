"""Queries on the star-schema tables, by name, each with its SQL equivalent."""

from tallyframe.plans.catalog.registry import CATALOG, Entry

from tallyframe.plans.catalog import (  # noqa: F401  (each module registers its queries)
    calllog,
    checks,
    curation,
    primitives,
    sampling,
    scoring,
    sources,
    workload,
)

__all__ = ["CATALOG", "Entry"]
