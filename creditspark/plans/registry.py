"""Registry of named queries: a Spark plan builder and, where SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Decorator: ``@register("policy_sweep", oracle=SQL)``; omit ``oracle`` for rows-only checks."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return wrap


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return {k: (v() if callable(v) else v) for k, v in _ORACLES.items()}


def _load() -> None:
    # Importing the modules registers their queries.
    from creditspark.plans import (  # noqa: F401
        audit_queries,
        decision_queries,
        metric_queries,
        model_queries,
        policy_queries,
        profile_queries,
        scenario_queries,
    )
