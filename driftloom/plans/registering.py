"""A decorator that registers queries and their SQL in a module's dictionaries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """QUERIES, ORACLES and ``query``, which adds a function under its name, and its SQL if there is any."""
    queries: dict = {}
    oracles: dict = {}

    def query(oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if oracle is not None:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query
