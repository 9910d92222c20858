"""Queries over the test tables, one for each operator, with their SQL."""

import importlib
import pkgutil

from .registry import QUERIES, SQL

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES", "SQL"]
