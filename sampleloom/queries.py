"""All queries of the core library; importing a module of plans registers its queries."""

from sampleloom.plans import aggregates, bundles, composites, filters, joins, metrics, more, sampling, series, sources, text, windows  # noqa: F401
from sampleloom.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
