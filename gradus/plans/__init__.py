"""Registered queries, each beside the same query in SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("classify", "generate", "judge", "rollup", "checkers", "keyed", "rating", "items", "sentences", "languages")


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {n: f for m in MODULES for n, f in import_module(f"gradus.plans.{m}").REGISTRY.queries.items()}


def oracles() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in import_module(f"gradus.plans.{m}").REGISTRY.oracles.items()}
