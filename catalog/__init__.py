"""Every operator as a query over the given tables, with equivalent SQL for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepwell.plans.views import ACCOUNTS_SQL, CUSTOMERS_SQL, SCORED_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PLAIN = {n: n for n in ("orders", "lineitem", "customer", "events", "accounts")}
_VIEWS = {"accounts": ACCOUNTS_SQL, "scored": SCORED_SQL, "customers": CUSTOMERS_SQL}
FAMILIES = ["tables", "select", "rules", "profile", "portfolio", "evaluate", "compare", "learn"]
_NEEDS = {"accounts": ["accounts"], "scored": ["accounts", "scored"], "customers": ["customers"]}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def over(view: str, *more: str) -> str:
    """A WITH clause defining a test view and further named queries (`name as (...)`)."""
    parts = [f"{v} as ({_VIEWS[v].format(**_PLAIN)})" for v in _NEEDS[view]]
    return "with " + ",\n".join([*parts, *more]) + "\n"


def load() -> None:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"catalog.{family}")
