"""Registered queries over the driver tables, each with its SQL."""

from __future__ import annotations

import importlib
import pkgutil

from .registry import REGISTRY, Query


def load() -> dict[str, Query]:
    """All registered queries; every module here whose name ends in _plans is read."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{m.name}")
    return REGISTRY
