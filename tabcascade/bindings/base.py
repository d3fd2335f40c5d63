"""Registry, table access and the derived inputs shared by Spark and SQL.

No driver column holds a NULL, so inputs get them by key. Expressions below are
plain SQL that Spark and the oracle read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabcascade.session import ensure_checkpoint_dir, release_held


@dataclass(frozen=True)
class Bound:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Bound] = {}


class Tables:
    """Parquet tables of one scale factor as attributes, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under an operator id."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            release_held()
            return build(Tables(spark, folder))

        REGISTRY[name] = Bound(run, sql)
        return build

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, so that all executors see it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


# ---- derived inputs: (list of expressions, table) --------------------------------------

ORDERS = [
    "o_orderkey",
    "o_custkey",
    "CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS visits",
    "CASE WHEN o_orderkey % 11 = 5 THEN NULL ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 13 = 7 THEN NULL ELSE o_orderstatus END AS status",
    "CASE WHEN o_orderkey % 10 < 8 THEN 1 ELSE 0 END AS is_train",
]

# Six classes, one of them with three quarters of the rows.
LABEL = (
    "CAST(CASE WHEN event_id % 100 < 75 THEN 0 WHEN event_id % 100 < 87 THEN 1 WHEN event_id % 100 < 93 THEN 2 "
    "WHEN event_id % 100 < 96 THEN 3 WHEN event_id % 100 < 98 THEN 4 ELSE 5 END AS INT)"
)
EVENTS = ["event_id", "user_id", "event_type", "value", f"{LABEL} AS label"]
# A prediction that is right for about half of the rows.
PREDICTED = f"CAST(CASE WHEN (event_id * 13) % 17 < 9 THEN {LABEL} ELSE (event_id * 7) % 6 END AS INT)"


def sub(table: str, columns: list[str]) -> str:
    """A parenthesised SELECT for use in oracle SQL."""
    return f"(SELECT {', '.join(columns)} FROM {table})"


def orders(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*ORDERS)


def events(t: Tables, *more: str) -> DataFrame:
    return t.events.selectExpr(*EVENTS, *more)


ORDERS_SQL = sub("orders", ORDERS)
EVENTS_SQL = sub("events", EVENTS)


def seeded_sql(seed: int | str, *keys: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]) + "))"
