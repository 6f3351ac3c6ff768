"""All registered queries."""

from __future__ import annotations

import importlib

from freightaudit.bindings import registry

MODULES = [
    "text_queries",
    "rule_queries",
    "document_queries",
    "score_queries",
    "feature_queries",
    "source_queries",
]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"freightaudit.bindings.{module}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(registry.CHECKS)
