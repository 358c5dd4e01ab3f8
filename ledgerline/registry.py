"""Name -> query and name -> equivalent SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.ledger import PRELUDE, Ledger

MODULES = (
    "ledgerline.operators.lookups",
    "ledgerline.operators.joins",
    "ledgerline.operators.aggregates",
    "ledgerline.operators.windows",
    "ledgerline.operators.writes",
    "ledgerline.operators.queues",
    "ledgerline.operators.state",
    "ledgerline.operators.policy",
    "ledgerline.operators.integrity",
    "ledgerline.functions.queries",
    "ledgerline.streaming.cursors",
    "ledgerline.streaming.controllers",
    "ledgerline.plans.scheduler",
    "ledgerline.plans.reports",
    "ledgerline.sources.queries",
    "ledgerline.sources.objects",
    "ledgerline.sources.migrations",
    "ledgerline.sources.readback",
)

_found: dict[str, tuple[Callable[[Ledger], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Ledger under a name, with the SELECT that follows the ledger's common table expressions, or SQL with its own."""

    def put(f: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        _found[name] = (f, sql)
        return f

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(module)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, f=f: f(Ledger(spark, folder))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql if sql.lstrip().startswith("WITH") else f"{PRELUDE.rstrip()}{sql}" if sql.lstrip().startswith(",") else f"{PRELUDE}{sql}" for name, (_, sql) in _found.items() if sql}
