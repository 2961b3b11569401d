"""Imports every module that registers queries and hands out the registry."""

from __future__ import annotations

import importlib
import pkgutil

from spreadlake import plans
from spreadlake.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"spreadlake.plans.{module.name}")
    return dict(REGISTRY)
