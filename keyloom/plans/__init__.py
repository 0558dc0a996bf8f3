"""Registered queries: operators over the driver tables, with SQL that checks them."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ["scan", "compare", "rules", "extract", "reshape", "catalog", "health"]


def load() -> ModuleType:
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"keyloom.plans.{name}")
    return importlib.import_module("keyloom.plans.registry")
