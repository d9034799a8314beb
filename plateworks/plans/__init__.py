"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """(queries, oracles) of all query modules."""
    from plateworks.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.endswith("_queries")):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
