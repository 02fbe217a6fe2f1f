"""Registered queries over the given tables, with independent SQL for the same results."""

from __future__ import annotations

from importlib import import_module

MODULES = ("source_queries", "feature_queries", "explore_queries", "explain_queries", "detection_queries")


def load_catalogue() -> dict:
    for module in MODULES:
        import_module(f"registry.{module}")
    from registry.catalogue import CATALOGUE

    return CATALOGUE
