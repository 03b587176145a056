"""Row filters built from parameters, and the people-list join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.text import contains_any, simple_name_key, strip

# Knowledge texts that mean "not known".
NO_KNOWLEDGE = ("", "nan", "none", "no knowledge")

# Columns a skill table shows, in this order, where present.
SKILL_COLUMNS = (
    "EmployeeName", "Level", "TechnologyName", "Vendor", "Priority", "Knowledge_Level",
    "LevelShort (stars)", "Type", "Manager", "Office", "UpdateDate",
)

# Names under which a people list may carry the person's name, best first.
NAME_COLUMNS = (
    "Consultant_Name", "Consultant Name", "Employee", "Employee_Name", "Employee Name", "Name",
    "Consultant", "Full Name",
)

_FIELD_SEPARATOR = "\x1f"


def current_rows(df: DataFrame) -> DataFrame:
    """Rows whose Status is 'current' or missing; all rows when there is no Status column."""
    if "Status" not in df.columns:
        return df
    return df.filter(F.col("Status").isNull() | (F.lower(strip(F.col("Status"))) == "current"))


def known_rows(df: DataFrame, level: str = "Knowledge_Level") -> DataFrame:
    """Current rows whose knowledge level says that something is known; the column is required."""
    rows = current_rows(df)
    if level not in rows.columns:
        raise ValueError(f"skill table without the column {level}")
    return rows.filter(
        F.col(level).isNotNull() & ~F.lower(strip(F.col(level))).isin(*NO_KNOWLEDGE)
    )


def skill_matches(
    technologies: DataFrame,
    search_terms: Sequence[str] = (),
    exclude_no_knowledge: bool = True,
    current_only: bool = True,
) -> DataFrame:
    """Distinct skill rows whose technology contains any of the terms; each filter is optional."""
    rows = technologies
    terms = tuple(t for t in (str(term).strip().lower() for term in search_terms) if t)
    if search_terms:
        rows = rows.filter(contains_any(F.lower(F.coalesce("TechnologyName", F.lit(""))), terms))
    if exclude_no_knowledge:
        if "Knowledge_Level" not in rows.columns:
            raise ValueError("skill table without the column Knowledge_Level")
        rows = rows.filter(F.lower(strip(F.col("Knowledge_Level"))) != "no knowledge")
    if current_only and "Status" in rows.columns:
        rows = rows.filter(F.lower(strip(F.col("Status"))) == "current")
    shown = [c for c in SKILL_COLUMNS if c in rows.columns]
    order = [c for c in ("EmployeeName", "TechnologyName") if c in shown]
    return rows.select(*[f"`{c}`" for c in shown]).distinct().orderBy(*order)


def replay_skill_filter(technologies: DataFrame, metadata: Mapping[str, Any]) -> DataFrame:
    """Rows that a saved answer showed, rebuilt from its metadata."""
    if not metadata.get("replay_supported") or not str(metadata.get("report_name") or "").strip():
        return technologies.limit(0)
    if metadata["report_name"] != "technologies":
        return technologies
    filters = metadata.get("filters")
    filters = filters if isinstance(filters, Mapping) else {}
    terms = filters.get("search_terms", [])
    return skill_matches(
        technologies,
        terms if isinstance(terms, list) else (),
        bool(filters.get("exclude_no_knowledge")),
        bool(filters.get("current_employees_only")),
    )


def active_projects_condition(column: Column, condition: Mapping[str, Any] | None) -> Column:
    """Comparison of a count with {operator, value}; nulls fail, an unknown operator lets all pass."""
    if not condition or condition.get("value") is None:
        return F.lit(True)
    number, value = column.try_cast("double"), F.lit(float(condition["value"]))
    tests = {
        "lt": number < value,
        "lte": number <= value,
        "gt": number > value,
        "gte": number >= value,
        "eq": number == value,
    }
    return F.coalesce(tests.get(condition.get("operator"), F.lit(True)), F.lit(False))


def group_condition(column: Column, requested: str) -> Column:
    return F.coalesce(
        F.lower(strip(column)).contains(requested.strip().lower()), F.lit(False)
    )


def equality_filter(df: DataFrame, filters: Mapping[str, Any] | None) -> Column:
    """AND over columns of equality or membership; None and empty lists are skipped."""
    test = F.lit(True)
    for name, expected in (filters or {}).items():
        if expected is None:
            continue
        column = F.col(f"`{name}`")
        if isinstance(expected, (list, tuple, set)):
            if expected:
                test = test & column.cast("string").isin(*[str(v) for v in expected])
        elif isinstance(expected, (bool, int, float)):
            test = test & (column == F.lit(expected))
        else:
            test = test & (column.cast("string") == str(expected))
    return F.coalesce(test, F.lit(False))


def _row_text(df: DataFrame) -> Column:
    """All cells of a row as one lower-cased text; the separator keeps matches inside a cell."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in df.columns]
    return F.lower(F.concat_ws(_FIELD_SEPARATOR, *cells))


def rows_mentioning(df: DataFrame, *terms: str) -> DataFrame:
    """Rows with any of the terms in any column; no terms, no rows."""
    wanted = tuple(t.lower() for t in terms if t)
    return df.filter(contains_any(_row_text(df), wanted) if wanted else F.lit(False))


def technology_rows(df: DataFrame, technology: str, levels: Sequence[str]) -> DataFrame:
    """Rows that mention the technology in one cell and one of the levels in any cell."""
    return rows_mentioning(rows_mentioning(df, technology), *levels)


def same_people(
    left: DataFrame, right: DataFrame, suffixes: tuple[str, str] = ("_availability", "_profile")
) -> DataFrame:
    """Rows of two people lists paired by name; columns on both sides get the suffixes."""

    def name_of(df: DataFrame) -> str:
        for candidate in NAME_COLUMNS:
            if candidate in df.columns:
                return candidate
        raise ValueError(f"no name column among: {', '.join(df.columns)}")

    def keyed(df: DataFrame, suffix: str, shared: set[str]) -> DataFrame:
        return df.select(
            simple_name_key(F.col(f"`{name_of(df)}`")).alias("_name_key"),
            *[F.col(f"`{c}`").alias(c + suffix if c in shared else c) for c in df.columns],
        )

    shared = set(left.columns) & set(right.columns)
    return (
        keyed(left, suffixes[0], shared)
        .join(keyed(right, suffixes[1], shared), "_name_key")
        .drop("_name_key")
    )


