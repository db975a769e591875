"""Registry of named queries: a Spark plan over the test tables plus its DuckDB oracle.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
double columns are rounded once to 4 dp in the final projection; the oracle
SQL rounds the same way so the driver can hash-compare results.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from millwright.functions.common import round_doubles
from millwright.session import ensure_checkpoint_dir, ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: Optional[str] = None, rounded: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)  # the cluster's setting wins; set only when unset
            ship_package(spark)
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return deco


def load_all() -> None:
    """Import every query module so its @register calls run."""
    from millwright.plans import (  # noqa: F401
        q_clean,
        q_dq,
        q_downtime,
        q_finance,
        q_insights,
        q_joins,
        q_maintenance,
        q_ml,
        q_oee,
        q_quality,
        q_sources,
    )
