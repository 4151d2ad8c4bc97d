"""Registered queries: a name, a plan, and the same result as SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql:
            TWINS[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_over(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """spark.sql() over DataFrames named {name} in a text that has braces of its own."""
    plain = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        plain = plain.replace("{{" + name + "}}", "{" + name + "}")
    return spark.sql(plain, **frames)
