"""Roll-ups of head counts."""

from __future__ import annotations

from crewcast.plans.head_counts import utilisation_rollup
from duckcheck.case import Case, case
from duckcheck.report_cases import _calendar

_SETS = (
    'WeekStart, "Group", "Level", CalendarStatus', 'WeekStart, "Group", CalendarStatus', "WeekStart, CalendarStatus",
    'Month, "Group", "Level", CalendarStatus', 'Month, "Group", CalendarStatus', 'Month, "Group"', "Month, CalendarStatus",
    '"Group", "Level"', '"Group", CalendarStatus', "CalendarStatus", "",
)
ROLLUP_SQL = f"""
SELECT WeekStart, Month, "Group", "Level", CalendarStatus,
       concat_ws(',', CASE WHEN grouping(Month) = 0 THEN 'Month' END, CASE WHEN grouping(WeekStart) = 0 THEN 'WeekStart' END,
                 CASE WHEN grouping("Group") = 0 THEN 'Group' END, CASE WHEN grouping("Level") = 0 THEN 'Level' END,
                 CASE WHEN grouping(CalendarStatus) = 0 THEN 'CalendarStatus' END) AS grouped_by,
       count(DISTINCT Resource_Id) AS people
FROM (SELECT *, CAST(date_trunc('month', WeekStart) AS DATE) AS Month FROM calendar)
GROUP BY GROUPING SETS ({', '.join(f'({columns})' for columns in _SETS)})"""

CASES: dict[str, Case] = {
    "utilisation_rollup": case(lambda s: utilisation_rollup(_calendar(s)), ROLLUP_SQL),
}
