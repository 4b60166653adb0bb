"""All query catalogues of the core."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_MODULES = ["extraction", "aggregates", "scalars", "relations", "more", "retrieval", "graphs", "documents", "dealt"]


def _catalogues() -> list:
    return [importlib.import_module(f"lodestone.plans.{m}") for m in _MODULES]


def queries() -> dict[str, Callable]:
    return {k: v for m in _catalogues() for k, v in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {k: v for m in _catalogues() for k, v in m.ORACLE.items()}
