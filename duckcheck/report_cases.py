"""Extracts, cleaning, calendar and reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions import dates as dt
from crewcast.functions import numbers as num
from crewcast.operators import assignments as asg
from crewcast.operators import quality, reshape, weekly
from crewcast.plans import (
    bench_status,
    calendar,
    consultant_tracker,
    partial_assignments,
    project_tracker,
    refresh,
    utilisation,
)
from crewcast.sources import extracts, master, report_store, shared_storage
from crewcast.sources.star_schema import AS_OF, StarSchema
from duckcheck.case import Case, case
from duckcheck.tables import AS_OF as RUN_DATE
from duckcheck.tables import HISTORY, WEEKS, d


def _calendar(s: StarSchema) -> DataFrame:
    return calendar.consultant_calendar(s.master(), AS_OF)


def _eligible(s: StarSchema) -> DataFrame:
    return asg.eligible_assignments(s.master().assignments, AS_OF)


def _messy(s: StarSchema) -> master.MasterData:
    """Base tables as untidy text, to be normalised."""
    key = F.col("ActivityAssignment_Id").cast("bigint")
    raw = s.assignments().withColumns(
        {
            "Level": F.when(key % 5 == 0, None).otherwise(F.concat(F.lit("\t"), "Level", F.lit("  "))),
            "Assignment_Start": F.when(key % 7 == 0, "n/a").otherwise(F.col("Assignment_Start").cast("string")),
            "Is_Active_Assignment": F.when(key % 3 == 0, "1").when(key % 3 == 1, "yes"),
        }
    )
    time = s.time_entries().withColumns(
        {
            "Logged_Hours": F.when(F.col("Logged_Hours") > 30, "many").otherwise(F.col("Logged_Hours").cast("string")),
            "WeekStart": F.concat(F.col("WeekStart").cast("string"), F.lit("")),
            "ActivityAssignment_Id": F.concat(F.lit(" "), "ActivityAssignment_Id"),
        }
    )
    leave = s.leave().withColumns(
        {
            "Leave_Hours": F.when(F.col("Leave_Hours") > 40, "x").otherwise(F.col("Leave_Hours").cast("string")),
            "Leave_Info": F.when(F.col("Leave_Hours") > 40, None).otherwise(F.concat("Leave_Info", F.lit("\n"))),
        }
    )
    return master.MasterData.of(raw, time, leave)


def _tracker_export(s: StarSchema) -> DataFrame:
    return reshape.export_columns(
        consultant_tracker.consultant_tracker(_calendar(s), AS_OF).withColumn(
            "as_of", F.lit(AS_OF).cast("date")
        )
    )


def _csv_round_trip(s: StarSchema) -> DataFrame:
    path = shared_storage.fresh_path(s.spark, "bench-csv")
    report = bench_status.bench_status(s.master(), AS_OF)
    report_store.export_csv(report, path)
    return s.spark.read.schema(report.schema).option("header", True).csv(path)


def _stored_report(s: StarSchema) -> DataFrame:
    store = report_store.ReportStore(s.spark, shared_storage.fresh_path(s.spark, "reports"))
    store.save("partial_assignments", partial_assignments.partial_assignments(s.master(), AS_OF))
    return store.load(" Partial_Assignments ")


def _refresh(s: StarSchema) -> DataFrame:
    folder = shared_storage.fresh_path(s.spark, "refresh")
    refresh.refresh_reports(s.spark, s.master(), folder, AS_OF)
    store = report_store.ReportStore(s.spark, folder)
    names = ("bench_status", "consultant_tracker", "partial_assignments", "project_tracker", "utilisation", "utilisation_detailed")
    counts = [
        store.load(n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("report"), "row_count")
        for n in names
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def _submission(s: StarSchema) -> DataFrame:
    return project_tracker.assignment_history(s.master().time_entries, AS_OF).select(
        "ActivityAssignment_Id", "Submission"
    )


def _raw_leave(s: StarSchema) -> DataFrame:
    return extracts.weekly_leave_extract(
        s.raw_forecast_entry(), s.raw_assignment(), s.raw_resource(), s.raw_activity(), AS_OF
    )


def _capacity(s: StarSchema) -> DataFrame:
    hours = F.col("Logged_Hours") * 1.3
    return s.time_entries().select(
        "ActivityAssignment_Id",
        "WeekStart",
        num.share_of_week(hours).alias("share"),
        num.extract_capacity(F.col("Logged_Hours")).alias("stored"),
        num.fixed_text(hours, 2).alias("two_places"),
        num.fixed_text(F.col("Logged_Hours") / 128, 6).alias("six_places"),
    )


def _week_starts(s: StarSchema) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return (
        s.table("orders")
        .select(day.alias("day"))
        .distinct()
        .select(
            "day",
            dt.monday(F.col("day")).alias("monday"),
            dt.extract_week_start(F.col("day")).alias("extract_week"),
        )
    )


def _parsed_dates(s: StarSchema) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    formats = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "MM-dd-yyyy"]
    text = F.lit("soon")
    for n, fmt in enumerate(formats):
        text = F.when(key % 6 == n, F.date_format(day, fmt)).otherwise(text)
    return s.table("orders").select(
        "o_orderkey", text.alias("text"), dt.parse_date(text).alias("parsed"),
        F.array_join(dt.dates_in_text(F.concat(F.lit("From "), text, F.lit(" or 2026-07-01?"))), ",").alias("found"),
    )


def _status_rows(s: StarSchema) -> DataFrame:
    wide = consultant_tracker.consultant_tracker(_calendar(s), AS_OF)
    return reshape.status_rows(wide, ["Group", "Consultant_Name"])


def _colours(s: StarSchema) -> DataFrame:
    return (
        _calendar(s)
        .groupBy(calendar.status_colour(F.col("CalendarStatus")).alias("colour"))
        .agg(F.count("*").alias("cells"))
    )


def _pivot(value: str, weeks=WEEKS, suffix: str = "", prefix: str = "") -> str:
    return ", ".join(
        f"max(CASE WHEN WeekStart = {d(w)} THEN {value} END) AS \"{prefix}{w}{suffix}\"" for w in weeks
    )


TRACKER_SQL = f"""
SELECT "Group", Consultant_Name, strftime(min(Expected_Availability_Date), '%Y-%m-%d') AS Expected_Availability_Date,
       max(Active_Projects) AS Active_Projects, {_pivot('CalendarValue')}, {_pivot('CalendarStatus', suffix='__STATUS')}
FROM tracker_long GROUP BY "Group", Consultant_Name"""

BENCH_SQL = f"""
SELECT Consultant_Name, "Level", Job_Title, "Group", Location, "Last Project",
       strftime(last_end, '%Y-%m-%d') AS "Last Assignment End",
       CAST(floor(({d(RUN_DATE)} - last_end) / 7.0) AS BIGINT) AS "Bench Weeks", '' AS "Possible Next Assignment"
FROM numbered n
LEFT JOIN (
    SELECT Resource_Id, Project_Name AS "Last Project", Assignment_End AS last_end FROM (
        SELECT *, row_number() OVER (PARTITION BY Resource_Id
            ORDER BY Assignment_End DESC, Assignment_Start DESC, Project_Name DESC, ActivityAssignment_Id DESC) AS k
        FROM eligible WHERE Assignment_End < {d(RUN_DATE)}) WHERE k = 1) l ON l.Resource_Id = n.Resource_Id
WHERE rn = 1 AND n.Resource_Id NOT IN (
    SELECT Resource_Id FROM eligible
    WHERE Assignment_Start <= {d(RUN_DATE)} AND (Assignment_End IS NULL OR Assignment_End >= {d(RUN_DATE)}))"""

PARTIAL_SQL = """
SELECT Resource_Id AS "Resource ID", Consultant_Name AS "Resource name", "Level", "Group", Project_Name AS Client,
       count(*) AS "Weeks assigned to project (<100% billable)",
       round_even(sum(Logged_Hours) / count(*) / 40.0::DOUBLE * 100 * 100, 0) / 100 AS "Time (%)"
FROM partial_weeks GROUP BY Resource_Id, Consultant_Name, "Level", "Group", Project_Name, PROJECT_ID"""

_IN_HISTORY = f"WeekStart >= DATE '1997-07-20' AND WeekStart < {d(RUN_DATE)}"
PROJECT_SQL = f"""
SELECT Consultant_Name, "Level", Job_Title, Location, Project_Name, Project_Type,
       coalesce(s.Submission, 'Inactive') AS Submission, Project_Status, Assignment_Start, Assignment_End,
       {', '.join(f'coalesce(t."h{w}", 0) AS "Logged_Hours_{w}", coalesce(l."l{w}", {chr(39)}0 hours{chr(39)}) AS "Leave_{w}", coalesce(t."d{w}", 0) AS "Consumed_Days_{w}"' for w in HISTORY)}
FROM assignments a
LEFT JOIN (SELECT ActivityAssignment_Id, {_pivot('Logged_Hours', HISTORY, prefix='h')}, {_pivot('Consumed_Days', HISTORY, prefix='d')}
           FROM time_entries WHERE {_IN_HISTORY} GROUP BY ActivityAssignment_Id) t USING (ActivityAssignment_Id)
LEFT JOIN (SELECT Resource_Id, {_pivot('Leave_Info', HISTORY, prefix='l')}
           FROM leave WHERE {_IN_HISTORY} GROUP BY Resource_Id) l ON l.Resource_Id = a.Resource_Id
LEFT JOIN (SELECT ActivityAssignment_Id,
                  CASE WHEN count(DISTINCT WeekStart) = 3 THEN 'Active' ELSE 'Inactive' END AS Submission
           FROM time_entries WHERE WeekStart >= {d(RUN_DATE - timedelta(weeks=3))} AND WeekStart < {d(RUN_DATE)} AND Logged_Hours > 0
           GROUP BY ActivityAssignment_Id) s USING (ActivityAssignment_Id)
WHERE trim(Consultant_Name) <> '' AND trim(Project_Name) <> ''"""

UTILISATION_SQL = f"SELECT Utilisation, {_pivot('MetricValue')} FROM metrics GROUP BY Utilisation"
DETAIL_SQL = f"""
SELECT Consultant_Name, "Level", "Group", Location, {_pivot('CalendarValue')}
FROM calendar GROUP BY Consultant_Name, "Level", "Group", Location"""

CALENDAR_COLUMNS = """Resource_Id, Consultant_Name, "Level", "Group", Job_Title, Location, Expected_Availability_Date,
    Active_Projects, WeekStart, Logged_Hours, Consumed_Days, Capacity, Leave_Hours, Leave_Info, Is_Leave,
    Has_Future_Assignment, CalendarStatus, CalendarCapacity, CalendarValue"""

_TSQL_WEEK = "DATE '1900-01-01' + CAST(7 * floor(({0} - DATE '1900-01-01' + 1) / 7.0) AS INT)"

CASES: dict[str, Case] = {
    "assignment_extract": case(
        lambda s: extracts.assignment_extract(
            s.raw_resource(), s.raw_user(), s.raw_employee(), s.raw_assignment(), s.raw_activity(),
            s.raw_project(), AS_OF,
        ),
        f"""
        SELECT r.Id AS Resource_Id, aa.Id AS ActivityAssignment_Id, DISPLAY_NAME AS Consultant_Name,
               JOB_LEVEL AS "Level", JOB_TITLE AS Job_Title, DEPARTMENT AS "Group", OFFICE_LOCATION AS Location,
               ra.Id AS ResourceActivity_Id, ra.Name AS Activity, p.PROJECT_ID, PROJECT_NAME AS Project_Name,
               PROJECT_TYPE AS Project_Type, PROJECT_STATUS AS Project_Status, StartDate AS Assignment_Start,
               EndDate AS Assignment_End,
               CAST(CASE WHEN StartDate <= {d(RUN_DATE)} AND coalesce(EndDate, DATE '9999-12-31') >= {d(RUN_DATE)}
                          AND p.PROJECT_ID IS NOT NULL THEN 1 ELSE 0 END AS INT) AS Is_Active_Assignment
        FROM raw_resource r LEFT JOIN raw_user u ON u.Id = r.usr
        LEFT JOIN raw_employee e ON e.INTEGRATION_ID = u.Username
        LEFT JOIN raw_assignment aa ON aa.Resource = r.Id
        LEFT JOIN raw_activity ra ON ra.Id = aa.ResourcedActivity
        LEFT JOIN raw_project p ON p.PROJECT_ID = ra.Id
        WHERE DISPLAY_NAME IS NOT NULL""",
    ),
    "weekly_time_extract": case(
        lambda s: extracts.weekly_time_extract(s.raw_time_entry(), s.raw_time_period(), AS_OF),
        f"""
        SELECT ActivityAssignment AS ActivityAssignment_Id, {_TSQL_WEEK.format('EndDate')} AS WeekStart,
               sum(coalesce(EntryUnits, 0)) AS Logged_Hours, sum(coalesce(EntryUnits, 0)) / 8 AS Consumed_Days,
               CAST(round(least(greatest(CAST(sum(coalesce(EntryUnits, 0)) AS DECIMAL(12,4)), 0), 40) * 0.025, 2) AS DECIMAL(10,2)) AS Capacity
        FROM raw_time_entry te JOIN raw_time_period tp ON tp.Id = te.TimePeriod
        WHERE ActivityAssignment IS NOT NULL AND EndDate >= DATE '1997-07-20' AND EndDate <= DATE '1998-12-31'
        GROUP BY ALL""",
    ),
    "weekly_leave_extract": case(
        _raw_leave,
        f"""
        WITH_TYPES AS (
        SELECT r.Id AS Resource_Id, {_TSQL_WEEK.format('f.StartDate')} AS WeekStart,
               coalesce(nullif(trim(ra.Name), ''), nullif(trim(aa.Name), ''), 'Leave') AS Leave_Type,
               sum(EntryUnits) AS Leave_Hours
        FROM raw_forecast_entry f LEFT JOIN raw_assignment aa ON aa.Id = f.ActivityAssignment
        LEFT JOIN raw_resource r ON r.Id = aa.Resource LEFT JOIN raw_activity ra ON ra.Id = aa.ResourcedActivity
        WHERE f.StartDate BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND coalesce(EntryUnits, 0) > 0
          AND regexp_matches(lower(coalesce(ra.Name, '') || '|' || coalesce(aa.Name, '')), 'leave|holiday|vacation|annual')
        GROUP BY ALL)
        SELECT Resource_Id, WeekStart, CAST(sum(Leave_Hours) AS DECIMAL(18,2)) AS Leave_Hours,
               string_agg(CAST(CAST(Leave_Hours AS DECIMAL(18,2)) AS VARCHAR) || ' hours (' || Leave_Type || ')', ', ' ORDER BY Leave_Type) AS Leave_Info
        FROM WITH_TYPES GROUP BY Resource_Id, WeekStart""",
    ),
    "normalised_assignments": case(
        lambda s: _messy(s).assignments,
        """
        SELECT * REPLACE (
            CASE WHEN CAST(ActivityAssignment_Id AS BIGINT) % 5 = 0 THEN '' ELSE "Level" END AS "Level",
            CASE WHEN CAST(ActivityAssignment_Id AS BIGINT) % 7 <> 0 THEN Assignment_Start END AS Assignment_Start,
            CAST(CASE WHEN CAST(ActivityAssignment_Id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS Is_Active_Assignment)
        FROM assignments""",
    ),
    "normalised_time_entries": case(
        lambda s: _messy(s).time_entries,
        """
        SELECT ActivityAssignment_Id, WeekStart, CASE WHEN Logged_Hours > 30 THEN 0 ELSE Logged_Hours END AS Logged_Hours,
               Consumed_Days, 0.0::DOUBLE AS Capacity
        FROM time_entries""",
    ),
    "normalised_leave": case(
        lambda s: _messy(s).leave,
        """
        SELECT Resource_Id, WeekStart,
               CAST(CASE WHEN Leave_Hours > 40 THEN 0 ELSE Leave_Hours END AS DECIMAL(18,2)) AS Leave_Hours,
               CASE WHEN Leave_Hours > 40 THEN '' ELSE Leave_Info END AS Leave_Info
        FROM leave""",
    ),
    "master_summary": case(
        lambda s: s.master().summary(),
        """
        SELECT count(*) AS assignment_rows, (SELECT count(*) FROM time_entries) AS time_entry_rows,
               (SELECT count(*) FROM leave) AS leave_rows, count(DISTINCT Consultant_Name) AS consultants,
               count(DISTINCT nullif(Project_Name, '')) AS projects
        FROM assignments""",
    ),
    "duplicate_keys": case(
        lambda s: quality.duplicate_keys(s.table("lineitem"), ["l_orderkey", "l_linenumber"]),
        """
        SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
        GROUP BY ALL HAVING count(*) > 1""",
    ),
    "eligible_assignments": case(lambda s: _eligible(s), "SELECT * FROM eligible"),
    "eligible_resource_ids": case(
        lambda s: asg.eligible_resource_ids(s.master().assignments, AS_OF),
        "SELECT DISTINCT Resource_Id FROM eligible",
    ),
    "assignment_activity": case(
        lambda s: s.master().assignments.select(
            "ActivityAssignment_Id",
            asg.active_on(AS_OF).alias("on_date"),
            asg.active_in_week(AS_OF).alias("in_week"),
        ),
        f"""
        SELECT ActivityAssignment_Id,
               Assignment_Start <= {d(RUN_DATE)} AND (Assignment_End IS NULL OR Assignment_End >= {d(RUN_DATE)})
                   AND trim(Project_Name) <> '' AS on_date,
               Assignment_Start <= {d(RUN_DATE + timedelta(days=6))} AND (Assignment_End IS NULL OR Assignment_End >= {d(RUN_DATE)})
                   AND trim(Project_Name) <> '' AS in_week
        FROM assignments""",
    ),
    "active_project_counts": case(
        lambda s: asg.active_project_counts(_eligible(s), AS_OF),
        "SELECT Resource_Id, Active_Projects FROM active_projects",
    ),
    "person_directory": case(
        lambda s: asg.person_directory(_eligible(s), AS_OF).drop("_future_weeks"),
        "SELECT * FROM directory",
    ),
    "future_assignment_weeks": case(
        lambda s: asg.future_assignment_weeks(_eligible(s), AS_OF),
        "SELECT *, TRUE AS Has_Future_Assignment FROM future_weeks",
    ),
    "resource_weekly_time": case(
        lambda s: weekly.resource_weekly_time(s.master().time_entries, _eligible(s)),
        "SELECT * FROM resource_time",
    ),
    "resource_weekly_leave": case(
        lambda s: weekly.resource_weekly_leave(s.master().leave),
        """
        SELECT Resource_Id, WeekStart, CAST(Leave_Hours AS DECIMAL(28,2)) AS Leave_Hours, Leave_Info, Is_Leave
        FROM resource_leave""",
    ),
    "consultant_calendar": case(_calendar, f"SELECT {CALENDAR_COLUMNS} FROM calendar"),
    "calendar_diagnostics": case(
        lambda s: quality.calendar_diagnostics(_calendar(s)),
        """
        SELECT 'status' AS "check", CalendarStatus AS detail, count(*) AS row_count FROM calendar GROUP BY ALL
        UNION ALL
        SELECT 'duplicate person-week', '', CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT)
        FROM (SELECT count(*) AS n FROM calendar GROUP BY Resource_Id, WeekStart)
        UNION ALL
        SELECT 'capacity outside 0-1', '', count(*) FILTER (WHERE CalendarCapacity < 0 OR CalendarCapacity > 1) FROM calendar""",
    ),
    "calendar_colours": case(
        _colours,
        """
        SELECT CASE CalendarStatus WHEN 'BOOKED' THEN 'RED' WHEN 'UNCONFIRMED' THEN 'ORANGE'
                    WHEN 'PARTLY_BOOKED' THEN 'LIGHT_ORANGE' WHEN 'ON_LEAVE' THEN 'YELLOW' ELSE 'PURPLE' END AS colour,
               count(*) AS cells
        FROM calendar GROUP BY ALL""",
    ),
    "tracker_weeks": case(
        lambda s: consultant_tracker.tracker_weeks(_calendar(s)), "SELECT * FROM tracker_long"
    ),
    "consultant_tracker": case(
        lambda s: consultant_tracker.consultant_tracker(_calendar(s), AS_OF), TRACKER_SQL
    ),
    "tracker_export": case(
        _tracker_export,
        f"""
        SELECT "Group", Consultant_Name, strftime(min(Expected_Availability_Date), '%Y-%m-%d') AS Expected_Availability_Date,
               max(Active_Projects) AS Active_Projects, '1998-07-20' AS as_of, {_pivot('CalendarValue')}
        FROM tracker_long GROUP BY "Group", Consultant_Name""",
    ),
    "tracker_status_rows": case(
        _status_rows, 'SELECT "Group", Consultant_Name, WeekStart, CalendarStatus FROM tracker_long'
    ),
    "weekly_utilisation": case(
        lambda s: utilisation.weekly_utilisation(_calendar(s)),
        """
        SELECT WeekStart, booked AS "Booked", unconfirmed AS "Unconfirmed", partly AS "Partly Booked", on_leave AS "On Leave",
               bench AS "Bench", booked_capacity AS "Booked Capacity", maximum AS "Maximum Capacity",
               CAST(booked_capacity AS DOUBLE) / nullif(maximum, 0) AS "Forecasted Allocation"
        FROM weekly_use""",
    ),
    "weekly_metrics": case(
        lambda s: utilisation.weekly_metrics(_calendar(s)), "SELECT * FROM metrics"
    ),
    "utilisation": case(lambda s: utilisation.utilisation(_calendar(s), AS_OF), UTILISATION_SQL),
    "utilisation_detailed": case(
        lambda s: utilisation.utilisation_detailed(_calendar(s), AS_OF), DETAIL_SQL
    ),
    "bench_status": case(lambda s: bench_status.bench_status(s.master(), AS_OF), BENCH_SQL),
    "partial_weeks": case(
        lambda s: partial_assignments.partial_weeks(s.master(), AS_OF), "SELECT * FROM partial_weeks"
    ),
    "partial_assignments": case(
        lambda s: partial_assignments.partial_assignments(s.master(), AS_OF), PARTIAL_SQL
    ),
    "submission_status": case(
        _submission,
        f"""
        SELECT ActivityAssignment_Id,
               CASE WHEN count(DISTINCT CASE WHEN WeekStart >= {d(RUN_DATE - timedelta(weeks=3))} AND Logged_Hours > 0
                                             THEN WeekStart END) = 3 THEN 'Active' ELSE 'Inactive' END AS Submission
        FROM time_entries WHERE {_IN_HISTORY} GROUP BY ActivityAssignment_Id""",
    ),
    "combined_leave": case(
        lambda s: project_tracker.combined_leave(
            s.master().leave.unionByName(s.master().leave.withColumn("Leave_Info", F.lit(" None ")))
            .unionByName(s.master().leave.withColumn("Leave_Info", F.lit("A day")))
        ),
        """
        SELECT Resource_Id, WeekStart, string_agg(DISTINCT info, ', ' ORDER BY info) AS Leave_Info
        FROM (SELECT Resource_Id, WeekStart, unnest([Leave_Info, 'A day']) AS info FROM leave) GROUP BY ALL""",
    ),
    "project_tracker": case(
        lambda s: project_tracker.project_tracker(s.master(), AS_OF), PROJECT_SQL
    ),
    "refresh_reports": case(
        _refresh,
        f"""
        SELECT 'bench_status' AS report, count(*) AS row_count FROM ({BENCH_SQL})
        UNION ALL SELECT 'consultant_tracker', count(*) FROM (SELECT DISTINCT "Group", Consultant_Name FROM tracker_long)
        UNION ALL SELECT 'partial_assignments', count(*) FROM ({PARTIAL_SQL})
        UNION ALL SELECT 'project_tracker', count(*) FROM assignments WHERE Project_Name <> ''
        UNION ALL SELECT 'utilisation', 8
        UNION ALL SELECT 'utilisation_detailed', count(*) FROM (SELECT DISTINCT Consultant_Name, "Level", "Group", Location FROM calendar)""",
    ),
    "stored_report": case(_stored_report, PARTIAL_SQL),
    "csv_export": case(
        _csv_round_trip,
        f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS \"Possible Next Assignment\") FROM ({BENCH_SQL})",
    ),
    "capacity_rounding": case(
        _capacity,
        """
        SELECT ActivityAssignment_Id, WeekStart,
               round_even(least(greatest(Logged_Hours * 1.3::DOUBLE / 40, 0), 1) * 100, 0) / 100 AS share,
               CAST(round(least(CAST(Logged_Hours AS DECIMAL(12,4)), 40) * 0.025, 2) AS DECIMAL(10,2)) AS stored,
               printf('%.2f', round_even(Logged_Hours * 1.3::DOUBLE * 100, 0) / 100) AS two_places,
               printf('%.6f', Logged_Hours / 128) AS six_places
        FROM time_entries""",
    ),
    "week_starts": case(
        _week_starts,
        f"""
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday,
               {_TSQL_WEEK.format('CAST(o_orderdate AS DATE)')} AS extract_week
        FROM orders""",
    ),
    "parsed_dates": case(
        _parsed_dates,
        """
        SELECT o_orderkey, text, parsed,
               CASE WHEN o_orderkey % 6 IN (1, 2, 3, 4) THEN '2026-07-01,' || strftime(parsed, '%Y-%m-%d')
                    WHEN o_orderkey % 6 = 0 THEN text || ',2026-07-01' ELSE '2026-07-01' END AS found
        FROM (SELECT o_orderkey, text, CAST(coalesce(try_strptime(text, '%Y-%m-%d'), try_strptime(text, '%d/%m/%Y'),
                     try_strptime(text, '%m/%d/%Y'), try_strptime(text, '%d-%m-%Y'), try_strptime(text, '%m-%d-%Y')) AS DATE) AS parsed
              FROM (SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                           WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
                           WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%m-%d-%Y')
                           ELSE 'soon' END AS text FROM orders))""",
    ),
}
