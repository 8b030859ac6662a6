"""The registry of the telemetry queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.operators import usage
from beaconry.plans import errors, metering, sessions, web
from beaconry.streaming import jobs

_PARTS = (web, metering, sessions, errors, jobs)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage per billing owner of the admitted, debounced web events."""
    rows = web.web_events(spark, sf_dir)
    return usage.usage(rows.select(F.col("owner_id").alias("billing_owner"), "token", "organization_id", F.col("request_id").alias("ord"), F.lit("web").alias("kind")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
