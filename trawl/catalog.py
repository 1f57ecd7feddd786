"""The reference-operator queries, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil

from trawl import plans
from trawl.registry import REGISTRY, Registry


def load() -> Registry:
    """Import every plan module (each registers its queries) and return the registry."""
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"trawl.plans.{module.name}")
    return REGISTRY
