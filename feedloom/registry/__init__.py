"""Named queries over the shared tables, each with an independent SQL check."""

from feedloom.registry.core import ORACLES, QUERIES

# Importing a module registers its queries.
from feedloom.registry import aggregates, feeds, filters, scalars, streams, tables, translation  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
