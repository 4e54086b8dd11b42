"""End-to-end plans and the registered queries."""

from importlib import import_module

_MODULES = ("relations", "checks_scalar", "checks_inventory", "checks_graph", "checks_resolve", "checks_snapshots", "checks_extract", "checks_sources")


def load():
    """The registry with every query module imported."""
    for name in _MODULES:
        import_module(f"relgraph.plans.{name}")
    return import_module("relgraph.plans.registry")
