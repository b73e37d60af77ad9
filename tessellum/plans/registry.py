"""All queries of the core, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("nested_queries", "core_queries", "rag_queries")


def collect(package: str, modules: tuple[str, ...]) -> tuple[dict, dict]:
    """QUERIES and ORACLE of the named modules, merged; one name may be defined once only."""
    queries: dict = {}
    oracle: dict = {}
    for name in modules:
        m = import_module(f"{package}.{name}")
        assert not queries.keys() & m.QUERIES.keys(), queries.keys() & m.QUERIES.keys()
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle


def queries() -> dict:
    return collect("tessellum.plans", MODULES)[0]


def oracle() -> dict:
    return collect("tessellum.plans", MODULES)[1]
