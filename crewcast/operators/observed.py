"""Checks that are computed by the job which writes a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGED = (T.DateType, T.TimestampType, T.IntegralType, T.DecimalType)


def standard_checks(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Row count; missing or blank values of each key; lowest and highest of dates and whole or decimal numbers."""
    checks = {"rows": F.count(F.lit(1))}
    for key in keys:
        checks[f"missing {key}"] = F.count_if(F.coalesce(F.trim(F.col(f"`{key}`").cast("string")), F.lit("")) == "")
    for field in df.schema:
        if isinstance(field.dataType, _RANGED):
            checks[f"lowest {field.name}"] = F.min(F.col(f"`{field.name}`")).cast("string")
            checks[f"highest {field.name}"] = F.max(F.col(f"`{field.name}`")).cast("string")
    return checks


def observed_write(df: DataFrame, path: str, checks: Mapping[str, Column]) -> dict[str, str | None]:
    """Writes df as Parquet and returns the checks' values as text, taken while the rows passed by.

    No job beside the write runs. The checks stand above the whole plan, so they see the rows as
    written: a sampling pass of a sort below is not counted, and a task that is repeated counts
    once. Only the values reach the driver.
    """
    observation = Observation()
    # Names of metrics are numbered, as those of checks may be anything.
    metrics = [value.alias(f"m{n}") for n, value in enumerate(checks.values())]
    df.observe(observation, *metrics).write.mode("overwrite").parquet(path)
    seen = observation.get
    texts = {name: seen[f"m{n}"] for n, name in enumerate(checks)}
    return {name: None if value is None else str(value) for name, value in texts.items()}
