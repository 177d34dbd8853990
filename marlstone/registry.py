"""Registration of queries beside the operators they apply."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries, their SQL, and the decorator that adds to both."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = f
            if oracle is not None:
                sql[name] = oracle
            return f

        return add

    return queries, sql, query
