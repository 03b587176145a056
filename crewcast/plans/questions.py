"""Batch classification of questions: route, confidence and filters as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.text import collapse_spaces, contains_any

# Phrases and patterns that decide the route of a question.
PERSON_TERMS = (
    "who", "which consultant", "which consultants", "which employee", "which employees",
    "find someone", "find a consultant", "find consultants", "find an employee",
    "find employees", "show people", "show consultants", "show employees",
    "looking for someone", "need someone", "need a consultant",
)
SKILL_TERMS = (
    "know", "knows", "has experience", "have experience", "experience in", "experienced in",
    "experience with", "experienced with", "knowledge of", "knowledge in", "skilled in",
    "skilled with", "skills in", "worked with", "familiar with", "expert in", "expertise in",
    "qualified in", "certified in",
)
EXPERIENCE_PATTERNS = (r"\bhas\s+.+?\s+experience\b", r"\bhave\s+.+?\s+experience\b")
SKILL_PATTERNS = (
    *EXPERIENCE_PATTERNS,
    r"\bknows?\s+.+",
    r"\bexperienced\s+(?:in|with)\s+.+",
    r"\bskilled\s+(?:in|with)\s+.+",
    r"\bexpert\s+in\s+.+",
    r"\bcertified\s+in\s+.+",
    r"\bqualified\s+in\s+.+",
)
GENERIC_SKILL_TERMS = (
    "skill", "skills", "technology", "technologies", "qualified in", "certified in",
)
PROFILE_TERMS = (
    "profile", "cv", "résumé", "resume", "professional experience", "project experience",
    "career history", "employment history", "background", "tell me about", "summarise",
    "summarize",
)
DOCUMENT_TERMS = ("policy", "document", "pdf", "handbook", "guideline", "procedure")

# Report routes in order of precedence (route, confidence, phrases).
REPORT_ROUTES = (
    ("bench", 0.99, ("bench", "on bench", "boşta")),
    ("consultant_tracker", 0.99, ("consultant tracker",)),
    (
        "partial_assignments",
        0.98,
        ("partial assignment", "partial assignments", "partly assigned", "partially assigned"),
    ),
    (
        "utilisation_detailed",
        0.98,
        (
            "utilisation detailed", "detailed utilisation",
            "utilization detailed", "detailed utilization",
        ),
    ),
    ("utilisation", 0.97, ("utilisation", "utilization")),
    (
        "project_tracker",
        0.90,
        ("project tracker", "show projects", "list projects", "client assignments"),
    ),
)

# Patterns that name the skill asked for; the first with a result counts.
_WHO = r"\b(?:who|which consultant|which consultants|which employee|which employees)\s+"
_SKILL_END = r"(.+?)(?:\s+and\b|\?|$)"
SKILL_QUERY_PATTERNS = (
    _WHO + r"(?:has|have)\s+(.+?)\s+experience\b",
    _WHO + r"knows?\s+" + _SKILL_END,
    r"\bexperience\s+(?:in|with)\s+" + _SKILL_END,
    r"\bexperienced\s+(?:in|with)\s+" + _SKILL_END,
    r"\bskilled\s+(?:in|with)\s+" + _SKILL_END,
    r"\bexpert(?:ise)?\s+in\s+" + _SKILL_END,
    r"\bknowledge\s+(?:of|in)\s+" + _SKILL_END,
    r"\bworked\s+with\s+" + _SKILL_END,
    r"\bfamiliar\s+with\s+" + _SKILL_END,
    r"\b(?:qualified|certified)\s+in\s+" + _SKILL_END,
)
GROUP_PATTERNS = (
    r"\bin\s+the\s+(.+?)\s+group\b",
    r"\bfrom\s+the\s+(.+?)\s+group\b",
    r"\bgroup\s+(?:is|=|called)\s+(.+?)(?:\?|$)",
)
NEXT_MONTH_TERMS = (
    "available next month", "availability next month", "free next month",
    "on bench next month", "bench next month",
)
ON_BENCH_TERMS = ("on bench", "currently on bench", "is on bench", "are on bench", "benched")
FEWER_PROJECTS_PATTERNS = (
    r"(?:less than|fewer than|under)\s+(\d+)\s+active projects?",
    r"active projects?\s+(?:less than|fewer than|under)\s+(\d+)",
)
NO_PROJECT_TERMS = ("no active projects", "without active projects", "zero active projects")
EDGE_SIGNS = " ?,.!"

# Keywords looked for in a question, the first found counts.
EXPERIENCE_KEYWORDS = (
    "banking", "finance", "insurance", "retail", "telecom", "pharma", "healthcare", "energy",
    "customer", "migration", "cloud", "data warehouse", "manufacturing", "public sector",
    "allianz",
)
SKILL_KEYWORDS = (
    "aws", "azure", "python", "sql", "power bi", "tableau", "databricks", "snowflake", "java",
    "sap", "oracle", "dbt", "spark", "machine learning", "ai", "genai", "data engineering",
)
# Level word → levels that satisfy it; the first word found counts.
LEVELS = (
    ("expert", ("expert",)),
    ("advanced", ("advanced", "expert")),
    ("intermediate", ("intermediate", "advanced", "expert")),
    ("basic", ("basic", "intermediate", "advanced", "expert")),
)
DEFAULT_LEVELS = ("advanced", "expert")


def normalised(question: Column) -> Column:
    return F.lower(collapse_spaces(question))


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _matches_any(question: Column, patterns: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | question.rlike(_unicode(pattern))
    return test


def _first_capture(question: Column, patterns: tuple[str, ...]) -> Column:
    """First non-empty capture, without the signs around it; null when there is none."""
    return F.coalesce(
        *[
            F.nullif(
                F.btrim(F.regexp_extract(question, _unicode(p), 1), F.lit(EDGE_SIGNS)), F.lit("")
            )
            for p in patterns
        ]
    )


def asks_for_people_with_skill(q: Column) -> Column:
    return contains_any(q, PERSON_TERMS) & (
        contains_any(q, SKILL_TERMS) | _matches_any(q, SKILL_PATTERNS)
    )


def route_rules(q: Column) -> list[tuple[str, float, bool, Column]]:
    """(route, confidence, returns filters, condition) in order of precedence."""
    generic_skill = contains_any(q, GENERIC_SKILL_TERMS) | _matches_any(q, EXPERIENCE_PATTERNS)
    return [
        ("skill_lookup", 0.96, True, asks_for_people_with_skill(q)),
        *[(route, sure, False, contains_any(q, terms)) for route, sure, terms in REPORT_ROUTES],
        ("skill_lookup", 0.88, True, generic_skill),
        ("profile_search", 0.93, True, contains_any(q, PROFILE_TERMS)),
        ("document_search", 0.95, True, contains_any(q, DOCUMENT_TERMS)),
        ("unknown", 0.25, True, F.lit(True)),
    ]


def classify_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds route, confidence and the filters found in the question.

    The position of the first rule that holds is found once; route, confidence and the right
    to return filters are looked up from it.
    """
    rules = route_rules(F.col("_q"))
    position = F.lit(len(rules))
    for n, (*_, condition) in reversed(list(enumerate(rules, start=1))):
        position = F.when(condition, F.lit(n)).otherwise(position)

    def looked_up(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_rule"))

    q = F.col("_q")
    fewer = _first_capture(q, FEWER_PROJECTS_PATTERNS)
    none = contains_any(q, NO_PROJECT_TERMS)
    found = {
        "skill_query": _first_capture(q, SKILL_QUERY_PATTERNS),
        "availability": F.when(contains_any(q, NEXT_MONTH_TERMS), "next_month").when(
            contains_any(q, ON_BENCH_TERMS), "bench"
        ),
        "active_projects_operator": F.when(fewer.isNotNull(), "lt").when(none, "eq"),
        "active_projects_value": F.when(fewer.isNotNull(), fewer.try_cast("bigint")).when(
            none, F.lit(0).cast("bigint")
        ),
        "group_filter": _first_capture(q, GROUP_PATTERNS),
    }
    return (
        questions.withColumn("_q", normalised(F.col(question)))
        .withColumn("_rule", position)
        .select(
            *[f"`{c}`" for c in questions.columns],
            looked_up([r[0] for r in rules]).alias("route"),
            looked_up([r[1] for r in rules]).alias("confidence"),
            *[
                F.when(looked_up([r[2] for r in rules]), value).alias(name)
                for name, value in found.items()
            ],
        )
    )


def _first_contained(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(text.contains(word), F.lit(word)).otherwise(found)
    return found


def experience_keyword(question: Column) -> Column:
    return _first_contained(F.lower(question), EXPERIENCE_KEYWORDS)


def skill_keyword(question: Column) -> Column:
    return _first_contained(F.lower(question), SKILL_KEYWORDS)


def skill_levels(question: Column) -> Column:
    """array<string> of the acceptable levels."""
    levels = F.array(*[F.lit(v) for v in DEFAULT_LEVELS])
    for word, accepted in reversed(LEVELS):
        levels = F.when(
            F.lower(question).contains(word), F.array(*[F.lit(v) for v in accepted])
        ).otherwise(levels)
    return levels
