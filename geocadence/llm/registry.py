"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = (
    "packing", "line_dedup", "substring_dedup", "near_dedup", "mixing",
    "token_counts", "fingerprints", "quality_rules", "quality_classifier", "url_filters",
)


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable]:
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules():
        out |= getattr(m, "ORACLE_SQL", {})
    return out
