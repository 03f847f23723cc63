"""Every query outside the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("layout", "elements", "pageplan", "tables", "stats", "metrics", "service", "compare", "streams")


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in import_module(f"leafwright.operators.{m}").queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"leafwright.operators.{m}").oracle_sql().items()}
