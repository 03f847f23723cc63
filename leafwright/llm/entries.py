"""All queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("q_percentiles", "q_prose", "q_lookalike", "q_language", "q_scan_noise", "q_packing", "q_mixing", "q_residue")


def _modules() -> list:
    return [import_module(f"leafwright.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for m in _modules() for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.oracle_sql().items()}
