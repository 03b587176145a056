"""People finding, skills, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.text import name_key
from crewcast.operators import filters
from crewcast.plans import people
from crewcast.sources.profiles import derived_profiles
from crewcast.sources.star_schema import AS_OF, StarSchema
from duckcheck.case import Case, case
from duckcheck.report_cases import _calendar

TERMS = ["widget", "blue"]


def _find(s: StarSchema) -> DataFrame:
    return people.find_people(
        _calendar(s),
        AS_OF,
        availability="next_month",
        active_projects={"operator": "lt", "value": 3},
        group=" mach",
    )


def _profile_hits(s: StarSchema) -> DataFrame:
    """One document row per technology of a person, as search hits carry them."""
    return s.technologies().select(
        F.col("_row_id").alias("id"),
        F.upper("EmployeeName").alias("consultant_name"),
        F.col("TechnologyName").alias("title"),
    )


def _available_skilled(s: StarSchema) -> DataFrame:
    available = people.bench_on_date(_calendar(s), "1998-07-23", AS_OF)
    experience = derived_profiles(s).experience.select(
        F.col("EmployeeName").alias("Employee"), "Industry", "Period"
    )
    return people.available_with_skill_and_experience(
        available,
        s.technologies().select(
            F.col("EmployeeName").alias("Employee"), "TechnologyName", "Vendor", "Knowledge_Level"
        ),
        "Widget",
        ["advanced", "expert"],
        experience,
        "banking",
    )


def _replayed(s: StarSchema) -> DataFrame:
    return filters.replay_skill_filter(
        s.technologies(),
        {
            "replay_supported": True,
            "report_name": "technologies",
            "filters": {"search_terms": TERMS, "exclude_no_knowledge": False, "current_employees_only": True},
        },
    )


def _name_keys(s: StarSchema) -> DataFrame:
    names = s.table("documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return names.groupBy(name_key(F.col("word")).alias("key")).agg(F.count("*").alias("words"))


PEOPLE_SQL = """
SELECT "Group", Consultant_Name, min(Expected_Availability_Date) AS Expected_Availability_Date,
       max(Active_Projects) AS Active_Projects
FROM tracker_long WHERE {0} GROUP BY "Group", Consultant_Name"""
NEXT_MONTH = "WeekStart >= DATE '1998-08-01' AND WeekStart < DATE '1998-09-01' AND CalendarStatus IN ('BENCH', 'PARTLY_BOOKED')"
ON_BENCH = "WeekStart = DATE '1998-07-20' AND CalendarStatus = 'BENCH'"
NAME_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
FOUND_SQL = (
    PEOPLE_SQL.format(NEXT_MONTH)
    + " HAVING max(Active_Projects) < 3 AND contains(lower(trim(\"Group\")), 'mach')"
)
BENCH_ON_DATE_SQL = """
SELECT Consultant_Name, "Group", strftime(Expected_Availability_Date, '%Y-%m-%d') AS Expected_Availability_Date,
       CalendarValue AS "1998-07-20", '1998-07-20' AS Matched_Week, 'Bench value found in Consultant Tracker' AS Reason
FROM tracker_long WHERE WeekStart = DATE '1998-07-20' AND CalendarValue = 'B'"""

CASES: dict[str, Case] = {
    "bench_on_date": case(
        lambda s: people.bench_on_date(_calendar(s), "1998-07-23", AS_OF), BENCH_ON_DATE_SQL
    ),
    "future_bench": case(
        lambda s: people.future_bench(_calendar(s), "1998-10-01"),
        """
        SELECT Consultant_Name, CAST(NULL AS VARCHAR) AS Team, CAST(NULL AS VARCHAR) AS "Level", "Group",
               strftime(min(Expected_Availability_Date), '%Y-%m-%d') AS Expected_Availability_Date,
               strftime(min(WeekStart), '%Y-%m-%d') AS First_Bench_Week, 'B' AS Status
        FROM tracker_long WHERE WeekStart >= DATE '1998-10-01' AND CalendarValue = 'B'
        GROUP BY "Group", Consultant_Name""",
    ),
    "available_next_month": case(
        lambda s: people.available_next_month(_calendar(s), AS_OF), PEOPLE_SQL.format(NEXT_MONTH)
    ),
    "currently_bench": case(
        lambda s: people.currently_bench(_calendar(s), AS_OF), PEOPLE_SQL.format(ON_BENCH)
    ),
    "find_people": case(_find, FOUND_SQL),
    "people_with_few_projects": case(
        lambda s: people.find_people(
            _calendar(s), AS_OF, active_projects={"operator": "gte", "value": 2}
        ),
        PEOPLE_SQL.format("TRUE") + " HAVING max(Active_Projects) >= 2",
    ),
    "documents_of_people": case(
        lambda s: people.documents_of(_profile_hits(s), _find(s)),
        f"""
        SELECT _row_id AS id, upper(EmployeeName) AS consultant_name, TechnologyName AS title FROM technologies
        WHERE {NAME_KEY.format('EmployeeName')} IN
              (SELECT {NAME_KEY.format('Consultant_Name')} FROM ({FOUND_SQL}))""",
    ),
    "people_of_documents": case(
        lambda s: people.workforce_context(people.people_of(_find(s), _profile_hits(s)), "next_month"),
        f"""
        SELECT "Group", Consultant_Name,
               'Verified workforce information for ' || Consultant_Name || ':' || chr(10) || 'Group: ' || "Group" || chr(10)
               || 'Active projects: ' || Active_Projects || chr(10)
               || 'Availability filter verified: the consultant has at least one BENCH or PARTLY_BOOKED week during next month.' AS context
        FROM ({FOUND_SQL})
        WHERE {NAME_KEY.format('Consultant_Name')} IN (SELECT {NAME_KEY.format('EmployeeName')} FROM technologies)""",
    ),
    "available_with_skill_and_experience": case(
        _available_skilled,
        f"""
        SELECT a.* , t.EmployeeName AS Employee_availability, t.TechnologyName, t.Vendor, t.Knowledge_Level,
               e.EmployeeName AS Employee_profile, e.Industry, e.Period
        FROM ({BENCH_ON_DATE_SQL}) a
        JOIN (SELECT EmployeeName, TechnologyName, Vendor, Knowledge_Level FROM technologies
              WHERE contains(lower(TechnologyName), 'widget') AND Knowledge_Level IN ('Advanced', 'Expert')) t
          ON lower(trim(a.Consultant_Name)) = lower(trim(t.EmployeeName))
        JOIN (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS EmployeeName, 'Banking' AS Industry,
                     CAST(year(o_orderdate) AS VARCHAR) AS Period
              FROM orders WHERE o_orderkey % 3 = 0) e
          ON lower(trim(a.Consultant_Name)) = lower(trim(e.EmployeeName))""",
    ),
    "skill_lookup": case(
        lambda s: filters.skill_matches(s.technologies(), TERMS), "SELECT * FROM skill_rows"
    ),
    "skill_lookup_head_count": case(
        lambda s: filters.skill_matches(s.technologies(), TERMS).agg(
            F.countDistinct("EmployeeName").alias("employee_count"), F.count("*").alias("match_count")
        ),
        "SELECT count(DISTINCT EmployeeName) AS employee_count, count(*) AS match_count FROM skill_rows",
    ),
    "replayed_skill_filter": case(
        _replayed,
        """
        SELECT DISTINCT EmployeeName, TechnologyName, Vendor, Knowledge_Level, Type FROM technologies
        WHERE Status = 'Current' AND (contains(lower(TechnologyName), 'widget') OR contains(lower(TechnologyName), 'blue'))""",
    ),
    "known_skills": case(
        lambda s: filters.known_rows(s.technologies()),
        "SELECT * FROM technologies WHERE Status = 'Current' AND Knowledge_Level <> 'No knowledge'",
    ),
    "rows_mentioning": case(
        lambda s: filters.rows_mentioning(s.technologies().drop("_row_id"), "Brand#2", "economy"),
        """
        SELECT * EXCLUDE (_row_id) FROM technologies
        WHERE contains(lower(EmployeeName || '|' || TechnologyName || '|' || Vendor || '|' || Type || '|' || Knowledge_Level || '|' || Status), 'brand#2')
           OR contains(lower(EmployeeName || '|' || TechnologyName || '|' || Vendor || '|' || Type || '|' || Knowledge_Level || '|' || Status), 'economy')""",
    ),
    "filtered_documents": case(
        lambda s: s.table("documents")
        .filter(
            filters.equality_filter(
                s.table("documents"), {"lang": ["de", "fr"], "source": "src2", "n_chars": None}
            )
        )
        .select("doc_id", "lang", "source"),
        "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src2'",
    ),
    "name_keys": case(
        _name_keys,
        """
        SELECT regexp_replace(lower(strip_accents(word)), '[^a-z0-9]+', '', 'g') AS key, count(*) AS words
        FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL""",
    ),
}
