"""Queries of the core library and the DuckDB SQL that checks them."""

from __future__ import annotations

FLAGSHIP = "anchor_error_by_length"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under a name."""

    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from sondeflow.plans import composites, extended, modelling, relations, sequences, summaries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
