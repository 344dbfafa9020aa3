"""Named queries: what runs on the driver's tables, with its SQL."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import the modules of this package: each registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
