"""All queries of the llm subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_pairs", "q_threads", "q_scans", "q_leaks", "q_mixing", "q_cuts", "q_toxic")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"tessellum.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
