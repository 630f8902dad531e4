"""The registry of queries: each module of ``MODULES`` offers QUERIES and ORACLE_SQL under the same names."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("expressions", "temporal", "series", "maps", "kernels", "regions", "more")
FLAGSHIP = "stm_by_month"


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"geocadence.plans.{name}"), what).items():
            assert key not in out, key
            out[key] = value
    return out


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
