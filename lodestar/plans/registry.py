"""Registration of queries and assembly of their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.views import VIEWS
from lodestar.sources.bindings import Tables

Builder = Callable[[Tables], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register ``builder(tables)``; ``oracle`` may use the names in VIEWS.

    Extra common table expressions come first, separated from the final
    SELECT by a line holding only ``---``.
    """

    def register(builder: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = builder
        if oracle is not None:
            _ORACLES[name] = expand(oracle)
        return builder

    return register


def expand(sql: str) -> str:
    """Prefix the views that the text mentions, in dependency order."""
    ordered: list[str] = []
    open_views: set[str] = set()

    def visit(text: str) -> None:
        for view, body in VIEWS.items():
            if view in ordered or view in open_views:
                continue
            if re.search(rf"\b(?:FROM|JOIN)\s+{view}\b", text):
                open_views.add(view)  # a recursive view mentions itself
                visit(body)
                ordered.append(view)

    visit(sql)
    parts = re.split(r"^\s*---\s*$", sql, flags=re.M)
    ctes = [f"{view} AS ({VIEWS[view].strip()})" for view in ordered]
    if len(parts) == 2:
        ctes.append(parts[0].strip().rstrip(","))
    if not ctes:
        return parts[-1].strip()
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + parts[-1].strip()


def _bind(builder: Builder) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: builder(Tables(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(builder) for name, builder in _BUILDERS.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
