"""Registered queries over the generic test tables."""

from importlib import import_module

# The modules that register queries.
MODULES = [
    "parsing_queries", "relational_queries", "aggregate_queries", "window_queries", "outcome_queries", "quality_queries", "source_queries", "model_queries",
]


def load() -> None:
    """Import every query module once."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
