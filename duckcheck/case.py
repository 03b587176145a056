"""A registered query: the Spark side and, where SQL can say it, the SQL side."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from crewcast.sources.star_schema import StarSchema
from duckcheck.tables import query


class Case(NamedTuple):
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def case(build: Callable[[StarSchema], DataFrame], sql: str | None) -> Case:
    return Case(
        lambda spark, folder: build(StarSchema(spark, folder)), query(sql) if sql else None
    )
