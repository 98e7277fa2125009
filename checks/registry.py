"""Registry of checked queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from cohortry.session import ensure_checkpoint_dir, tune
from cohortry.sources.omop_views import BASE_TABLES, VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Discharges after this moment count as future ones in the test data.
AS_OF = datetime(2001, 8, 1)
MAX_VISITS = 15
SEEDS = {
    "steroid": [200001, 200002, 200003],
    "narcotic": [200004, 200005],
    "sedative": [200006, 200007, 200006],
    "vasopressor": [200008, 200009, 200010, 200011, 200012],
}

#: Named SQL building blocks on top of the views; a block may use views and other blocks.
BLOCKS: dict[str, str] = {}


def _expand(sql: str) -> str:
    """Prefix ``sql`` with the views and blocks it names, in dependency order."""
    bodies = {n: re.sub(r"\{(\w+)\}", r"\1", v) for n, v in VIEWS.items()} | BLOCKS
    order: list[str] = []

    def visit(text: str) -> None:
        for name in bodies:
            if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                visit(bodies[name])
                order.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS (\n{bodies[n].strip()}\n)" for n in order)
    if not head:
        return sql.strip()
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


def check(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    return {name: _expand(sql) for name, sql in ORACLES.items()}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch/{name}-{uuid.uuid4().hex}"


EXCLUDED_DEVICE = 600003

__all__ = ["AS_OF", "BASE_TABLES", "BLOCKS", "MAX_VISITS", "SEEDS", "Tables", "check", "oracle_sql", "scratch"]
