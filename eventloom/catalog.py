"""Name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Decorator: put a (spark, sf_dir) -> DataFrame callable in the catalogue, with its SQL if there is one."""

    def put(function):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if oracle:
            _ORACLES[name] = oracle
        return function

    return put


def _load() -> None:
    from eventloom import plans  # noqa: F401  importing the plans registers them


def queries() -> dict:
    """All registered queries."""
    _load()
    return _QUERIES


def oracle_sql() -> dict:
    """SQL of the registered queries that have one."""
    _load()
    return _ORACLES
