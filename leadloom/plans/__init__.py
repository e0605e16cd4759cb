"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from importlib import import_module

MODULES = ("reporting", "qualifying", "outreaching", "lifecycles", "scheduling", "verifying", "listing", "texts",
           "people", "storing", "opening")


def load():
    """Every registered query by name."""
    from leadloom.plans.registry import QUERIES

    for module in MODULES:
        import_module(f"leadloom.plans.{module}")
    return QUERIES
