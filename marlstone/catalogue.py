"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "operators.filters",
    "operators.catalog",
    "operators.joins",
    "operators.aggregates",
    "operators.windows",
    "operators.search",
    "operators.retrieval",
    "operators.graph",
    "operators.networks",
    "operators.intervals",
    "operators.walk",
    "operators.patterns",
    "operators.related",
    "operators.pagegraph",
    "operators.lookup",
    "operators.entities",
    "operators.mentions",
    "operators.pages",
    "operators.etl",
    "operators.reports",
    "operators.maintenance",
    "operators.cleanup",
    "operators.grounding",
    "operators.overtexts",
    "functions.scalars",
    "functions.strings",
    "sources.connectors",
    "sources.files",
    "sources.journal",
    "plans.incremental",
    "plans.projection",
    "plans.service",
    "streaming.events",
    "streaming.worker",
)


def _all(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"marlstone.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
