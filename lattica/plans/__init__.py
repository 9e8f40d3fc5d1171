"""Analyses composed from the operators."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module that registers queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
