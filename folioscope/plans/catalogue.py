"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.plans import answers, derived, figures, files, language, layout, metadata, registry, relational, search, stores, streams, structure

_PLANS = (search, structure, registry, layout, language, answers, figures, relational, streams, metadata, stores, files)
#: Queries over the tables that take the place of queries of the same names over written-down examples.
_OVER_TABLES = derived


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in (*_PLANS, _OVER_TABLES) for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in (*_PLANS, _OVER_TABLES) for name, sql in plan.ORACLES.items()}


def examples() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Written-down examples of registered queries and their SQL, for the tests."""
    return {name: (plan.QUERIES[name], plan.ORACLES[name]) for plan in _PLANS for name in plan.ORACLES if name in _OVER_TABLES.QUERIES}
