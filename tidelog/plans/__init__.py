"""Registered queries: each pairs a Spark callable with an independent SQL text."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every query module so that it registers itself."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
