"""All queries of the library's own operators, by catalogue."""

from quarry.plans import catalog_context, catalog_files, catalog_graph, catalog_parsing, catalog_rules, catalog_search, pipeline  # noqa: F401
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
