"""The registered queries of the reference's own operators."""

from tidemark.plans import catalog, coverage, graph, impact, lookups, report, sources, streams, table_functions  # noqa: F401
