"""Runnable queries over the driver tables, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("similarity", "graph", "ingest", "naming", "tiering", "statistics", "fusion", "evaluation", "learning")


def load() -> None:
    for name in MODULES:
        import_module(f"loomgraph.catalog.{name}")
