"""All registered queries: name to (function of session and folder, SQL that gives the same rows or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.types import cast

MODULES: tuple[str, ...] = tuple(f"sparkloom.plans.{m}_queries" for m in ("batch", "group", "scan", "metric", "text", "scene", "stream", "extra", "more", "scale"))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(name).QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracles() -> dict[str, str]:
    return {name: cast(name, sql) for name, (_, sql) in _all().items() if sql}
