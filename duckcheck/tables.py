"""Derived tables and intermediate results as SQL, combined with WITH."""

from __future__ import annotations

import re
from datetime import date, timedelta

AS_OF = date(1998, 7, 20)
FIRST_WEEK, LAST_WEEK = date(1998, 1, 5), date(1998, 12, 28)
WEEKS = [FIRST_WEEK + timedelta(days=7 * n) for n in range((LAST_WEEK - FIRST_WEEK).days // 7 + 1)]
HISTORY = [AS_OF - timedelta(days=7 * n) for n in range(1, 53)]


def d(day: date) -> str:
    return f"DATE '{day.isoformat()}'"


LEVEL = "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Junior' WHEN 1 THEN 'Senior' ELSE 'Lead' END"
STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"

TABLES: dict[str, str] = {
    # -- base tables ---------------------------------------------------------------------
    "assignments": f"""
        SELECT CAST(o_custkey AS VARCHAR) AS Resource_Id,
               CAST(o_orderkey AS VARCHAR) AS ActivityAssignment_Id,
               c_name AS Consultant_Name, {LEVEL} AS "Level",
               CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS Job_Title,
               c_mktsegment AS "Group",
               CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS Location,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS PROJECT_ID,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Project ' || o_orderpriority END AS Project_Name,
               o_orderstatus AS Project_Type,
               CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Planned' END AS Project_Status,
               CAST(o_orderdate AS DATE) AS Assignment_Start,
               CASE WHEN o_orderkey % 17 <> 0
                    THEN CAST(o_orderdate AS DATE) + CAST(7 * (1 + o_orderkey % 40) AS INT) END AS Assignment_End,
               CAST(0 AS INT) AS Is_Active_Assignment
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "entry_dates": """
        SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
               CAST(o_orderdate AS DATE) + CAST(7 * (l_linenumber - 1) + l_partkey % 7 AS INT) AS worked
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "time_entries": """
        SELECT CAST(l_orderkey AS VARCHAR) AS ActivityAssignment_Id,
               CAST(date_trunc('week', worked) AS DATE) AS WeekStart,
               sum(l_quantity / 2) AS Logged_Hours, sum(l_quantity / 2) / 8 AS Consumed_Days
        FROM entry_dates GROUP BY ALL""",
    "leave_by_type": """
        SELECT CAST(user_id AS VARCHAR) AS Resource_Id,
               CAST(date_trunc('week', DATE '1998-01-01' + CAST(event_id % 365 AS INT)) AS DATE) AS WeekStart,
               event_type AS Leave_Type,
               sum(CAST(least(value, 40) AS DECIMAL(18,2))) AS Leave_Hours
        FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL""",
    "leave": """
        SELECT Resource_Id, WeekStart, CAST(sum(Leave_Hours) AS DECIMAL(18,2)) AS Leave_Hours,
               string_agg(CAST(CAST(Leave_Hours AS DECIMAL(18,2)) AS VARCHAR) || ' hours (' || Leave_Type || ')',
                          ', ' ORDER BY Leave_Type) AS Leave_Info
        FROM leave_by_type GROUP BY ALL""",
    # -- calendar ------------------------------------------------------------------------
    "eligible": f"""
        SELECT * FROM assignments
        WHERE trim(Consultant_Name) <> '' AND trim(Project_Name) <> ''
          AND Assignment_Start <= DATE '1998-12-31'
          AND (Assignment_End IS NULL OR Assignment_End >= DATE '1998-01-01')""",
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY Resource_Id
                    ORDER BY coalesce(Assignment_End, DATE '9999-12-31') DESC, Assignment_Start DESC,
                             Project_Name DESC, ActivityAssignment_Id DESC) AS rn
        FROM eligible""",
    "directory": """
        SELECT Resource_Id,
               max(CASE WHEN rn = 1 THEN Consultant_Name END) AS Consultant_Name,
               max(CASE WHEN rn = 1 THEN "Level" END) AS "Level",
               max(CASE WHEN rn = 1 THEN "Group" END) AS "Group",
               arg_min(Job_Title, rn) FILTER (WHERE Job_Title IS NOT NULL) AS Job_Title,
               arg_min(Location, rn) FILTER (WHERE Location IS NOT NULL) AS Location,
               max(Assignment_End) AS Expected_Availability_Date
        FROM numbered GROUP BY Resource_Id""",
    "active_projects": f"""
        SELECT Resource_Id, count(DISTINCT PROJECT_ID) AS Active_Projects
        FROM eligible
        WHERE Assignment_Start <= {d(AS_OF)} AND (Assignment_End IS NULL OR Assignment_End >= {d(AS_OF)})
        GROUP BY Resource_Id HAVING count(PROJECT_ID) > 0""",
    "weeks": f"""
        SELECT CAST(w AS DATE) AS WeekStart
        FROM generate_series(TIMESTAMP '{FIRST_WEEK}', TIMESTAMP '{LAST_WEEK}', INTERVAL 7 DAY) AS t(w)""",
    "future_weeks": f"""
        SELECT DISTINCT Resource_Id, WeekStart
        FROM eligible JOIN weeks
          ON Assignment_Start <= WeekStart + 6 AND (Assignment_End IS NULL OR Assignment_End >= WeekStart)
        WHERE WeekStart > {d(AS_OF)}""",
    "resource_time": """
        SELECT Resource_Id, WeekStart, sum(Logged_Hours) AS Logged_Hours, sum(Consumed_Days) AS Consumed_Days,
               round_even(least(greatest(sum(Logged_Hours) / 40, 0), 1) * 100, 0) / 100 AS Capacity
        FROM time_entries JOIN (SELECT DISTINCT ActivityAssignment_Id, Resource_Id FROM eligible)
             USING (ActivityAssignment_Id)
        GROUP BY ALL""",
    "resource_leave": """
        SELECT Resource_Id, WeekStart, sum(Leave_Hours) AS Leave_Hours, min(Leave_Info) AS Leave_Info,
               sum(Leave_Hours) > 0 AS Is_Leave
        FROM leave GROUP BY ALL""",
    "calendar_base": """
        SELECT p.*, coalesce(CAST(a.Active_Projects AS INT), 0) AS Active_Projects, w.WeekStart,
               coalesce(t.Logged_Hours, 0) AS Logged_Hours, coalesce(t.Consumed_Days, 0) AS Consumed_Days,
               coalesce(t.Capacity, 0) AS Capacity,
               coalesce(CAST(l.Leave_Hours AS DOUBLE), 0) AS Leave_Hours,
               coalesce(l.Leave_Info, '') AS Leave_Info, coalesce(l.Is_Leave, FALSE) AS Is_Leave,
               f.Resource_Id IS NOT NULL AS Has_Future_Assignment
        FROM directory p CROSS JOIN weeks w
        LEFT JOIN active_projects a ON a.Resource_Id = p.Resource_Id
        LEFT JOIN resource_time t ON t.Resource_Id = p.Resource_Id AND t.WeekStart = w.WeekStart
        LEFT JOIN resource_leave l ON l.Resource_Id = p.Resource_Id AND l.WeekStart = w.WeekStart
        LEFT JOIN future_weeks f ON f.Resource_Id = p.Resource_Id AND f.WeekStart = w.WeekStart""",
    "calendar_status": """
        SELECT *, CASE WHEN Is_Leave THEN 'ON_LEAVE' WHEN Capacity >= 1 THEN 'BOOKED'
                       WHEN Capacity > 0 THEN 'PARTLY_BOOKED' WHEN Has_Future_Assignment THEN 'UNCONFIRMED'
                       ELSE 'BENCH' END AS CalendarStatus
        FROM calendar_base""",
    "calendar": """
        SELECT *, CASE CalendarStatus WHEN 'UNCONFIRMED' THEN 1.0::DOUBLE WHEN 'BOOKED' THEN Capacity
                       WHEN 'PARTLY_BOOKED' THEN Capacity ELSE 0.0::DOUBLE END AS CalendarCapacity,
               CASE CalendarStatus WHEN 'UNCONFIRMED' THEN '1.00' WHEN 'BOOKED' THEN printf('%.2f', Capacity)
                       WHEN 'PARTLY_BOOKED' THEN printf('%.2f', Capacity) WHEN 'ON_LEAVE' THEN 'L'
                       ELSE 'B' END AS CalendarValue
        FROM calendar_status""",
    "tracker_long": """
        SELECT "Group", Consultant_Name, WeekStart,
               arg_min(CalendarValue, Resource_Id) AS CalendarValue,
               arg_min(CalendarStatus, Resource_Id) AS CalendarStatus,
               min(Expected_Availability_Date) AS Expected_Availability_Date,
               max(Active_Projects) AS Active_Projects
        FROM calendar GROUP BY "Group", Consultant_Name, WeekStart""",
    "weekly_use": """
        SELECT WeekStart,
               count_if(CalendarStatus = 'BOOKED')::BIGINT AS booked,
               count_if(CalendarStatus = 'UNCONFIRMED')::BIGINT AS unconfirmed,
               count_if(CalendarStatus = 'PARTLY_BOOKED')::BIGINT AS partly,
               count_if(CalendarStatus = 'ON_LEAVE')::BIGINT AS on_leave,
               count_if(CalendarStatus = 'BENCH')::BIGINT AS bench,
               CAST(sum(CASE WHEN CalendarStatus IN ('BOOKED', 'PARTLY_BOOKED')
                             THEN CAST(CalendarCapacity AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS booked_capacity,
               count_if(CalendarStatus <> 'ON_LEAVE')::BIGINT AS maximum
        FROM calendar GROUP BY WeekStart""",
    "metrics": """
        SELECT WeekStart, u.n AS MetricOrder, u.name AS Utilisation, u.v AS MetricValue
        FROM (SELECT WeekStart, unnest([
                {'n': 1, 'name': 'Booked', 'v': CAST(booked AS VARCHAR)},
                {'n': 2, 'name': 'Unconfirmed', 'v': CAST(unconfirmed AS VARCHAR)},
                {'n': 3, 'name': 'Partly Booked', 'v': CAST(partly AS VARCHAR)},
                {'n': 4, 'name': 'On Leave', 'v': CAST(on_leave AS VARCHAR)},
                {'n': 5, 'name': 'Bench', 'v': CAST(bench AS VARCHAR)},
                {'n': 6, 'name': 'Booked Capacity', 'v': printf('%.2f', CAST(booked_capacity AS DOUBLE))},
                {'n': 7, 'name': 'Maximum Capacity', 'v': printf('%.2f', CAST(maximum AS DOUBLE))},
                {'n': 8, 'name': 'Forecasted Allocation',
                 'v': CASE WHEN maximum > 0 THEN printf('%.6f', CAST(booked_capacity AS DOUBLE) / maximum) END}]) AS u
              FROM weekly_use)""",
    "partial_weeks": f"""
        SELECT Resource_Id, Consultant_Name, "Level", "Group", Project_Name, PROJECT_ID, WeekStart,
               sum(Logged_Hours) AS Logged_Hours
        FROM eligible JOIN time_entries USING (ActivityAssignment_Id)
        WHERE PROJECT_ID IS NOT NULL AND Assignment_Start <= {d(AS_OF)}
          AND (Assignment_End IS NULL OR Assignment_End >= {d(AS_OF)})
          AND WeekStart >= {d(AS_OF - timedelta(weeks=52))} AND WeekStart < {d(AS_OF)}
        GROUP BY ALL HAVING sum(Logged_Hours) > 0 AND sum(Logged_Hours) < 40""",
    # -- raw tables ----------------------------------------------------------------------
    "raw_resource": "SELECT CAST(c_custkey AS VARCHAR) AS Id, 'u' || c_custkey AS usr FROM customer",
    "raw_user": """
        SELECT 'u' || c_custkey AS Id, 'login' || c_custkey AS Username
        FROM customer WHERE c_custkey % 29 <> 0""",
    "raw_employee": f"""
        SELECT 'login' || c_custkey AS INTEGRATION_ID,
               CASE WHEN c_custkey % 31 <> 0 THEN c_name END AS DISPLAY_NAME, {LEVEL} AS JOB_LEVEL,
               c_mktsegment AS JOB_TITLE, c_mktsegment AS DEPARTMENT, n_name AS OFFICE_LOCATION
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "raw_assignment": """
        SELECT CAST(o_orderkey AS VARCHAR) AS Id,
               CASE WHEN o_orderkey % 6 = 0 THEN 'Annual absence' ELSE 'Client work' END AS Name,
               CAST(o_custkey AS VARCHAR) AS Resource,
               CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS ResourcedActivity,
               CAST(o_orderdate AS DATE) AS StartDate,
               CASE WHEN o_orderkey % 17 <> 0
                    THEN CAST(o_orderdate AS DATE) + CAST(7 * (1 + o_orderkey % 40) AS INT) END AS EndDate
        FROM orders""",
    "raw_activity": """
        SELECT DISTINCT o_orderpriority AS Id,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'Parental LEAVE' WHEN '2' THEN ' '
                    ELSE 'Activity ' || o_orderpriority END AS Name
        FROM orders""",
    "raw_project": """
        SELECT DISTINCT o_orderpriority AS PROJECT_ID, 'Project ' || o_orderpriority AS PROJECT_NAME,
               'Client' AS PROJECT_TYPE, 'Open' AS PROJECT_STATUS
        FROM orders WHERE left(o_orderpriority, 1) <> '5'""",
    "raw_time_entry": """
        SELECT CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS ActivityAssignment,
               'P' || worked AS TimePeriod,
               CASE WHEN l_linenumber <> 7 THEN l_quantity / 2 END AS EntryUnits
        FROM entry_dates""",
    "raw_time_period": "SELECT DISTINCT 'P' || worked AS Id, worked AS EndDate FROM entry_dates",
    "raw_forecast_entry": """
        SELECT CAST(event_id AS VARCHAR) AS ActivityAssignment,
               DATE '1997-12-01' + CAST(event_id % 420 AS INT) AS StartDate,
               CASE WHEN event_id % 8 <> 0 THEN CAST(least(value, 40) AS DECIMAL(18,2)) END AS EntryUnits
        FROM events""",
    # -- skills, search, logs --------------------------------------------------------------
    "technologies": """
        SELECT min(l_orderkey * 1000000 + l_partkey) AS _row_id,
               replace(s_name, 'Supplier', 'Customer') AS EmployeeName, p_name AS TechnologyName,
               p_brand AS Vendor, p_type AS Type,
               CASE max(l_linenumber) % 4 WHEN 0 THEN 'No knowledge' WHEN 1 THEN 'Basic'
                    WHEN 2 THEN 'Advanced' ELSE 'Expert' END AS Knowledge_Level,
               CASE WHEN s_suppkey % 10 = 0 THEN 'Former' ELSE 'Current' END AS Status
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY s_suppkey, s_name, p_name, p_brand, p_type""",
    "skill_rows": """
        SELECT DISTINCT EmployeeName, TechnologyName, Vendor, Knowledge_Level, Type FROM technologies
        WHERE Status = 'Current' AND Knowledge_Level <> 'No knowledge'
          AND (contains(lower(TechnologyName), 'widget') OR contains(lower(TechnologyName), 'blue'))""",
    "questions": """
        SELECT 'chat-' || conv_id || '-' || turn AS question_id, text AS question
        FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT 'part-' || p_partkey, CASE CAST(p_partkey % 14 AS INT)
            WHEN 0 THEN 'Who knows ' || p_name || ' and is on bench?'
            WHEN 1 THEN 'Which consultants have ' || p_name || ' experience  in the BUILDING group?'
            WHEN 2 THEN 'Who is on bench for ' || p_name || '?'
            WHEN 3 THEN 'Show the consultant tracker for ' || p_name
            WHEN 4 THEN 'Partly assigned people on ' || p_name
            WHEN 5 THEN 'Detailed  utilisation of ' || p_name
            WHEN 6 THEN 'Utilization of ' || p_name || ' this year'
            WHEN 7 THEN 'List projects using ' || p_name
            WHEN 8 THEN 'Skills with ' || p_name || ', expertise in ' || p_name
            WHEN 9 THEN 'Tell me about ' || p_name || ' with fewer than 3 active projects'
            WHEN 10 THEN 'What does the ' || p_name || ' policy say?'
            WHEN 11 THEN 'Who is skilled in ' || p_name || ' and available next month with no active projects?'
            WHEN 12 THEN 'Is anyone certified in ' || p_name || ', please!'
            ELSE '  Anything else on ' || p_name || ' from the MACHINERY group on 2026-07-01 or 13/02/2026? ' END
        FROM part""",
    "search_documents": """
        SELECT doc_id AS id, 'Document ' || lang AS title, text AS content, source AS consultant_name,
               lang AS source_type, embedding
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "search_queries": """
        SELECT item_id AS query_id, text AS query, embedding
        FROM benchmark LEFT JOIN embeddings ON vec_id = item_id""",
    "query_terms": """
        SELECT DISTINCT query_id, unnest(regexp_split_to_array(trim(lower(query)), '\\s+')) AS term
        FROM search_queries""",
    "keyword_scores": """
        SELECT query_id, id, CAST(count(*) AS INT) AS score
        FROM search_documents JOIN query_terms
          ON term <> '' AND contains(lower(title || ' ' || content || ' ' || consultant_name), term)
        GROUP BY ALL""",
    "keyword_ranked": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
        FROM keyword_scores""",
    "vector_ranked": """
        SELECT query_id, id, score,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
        FROM (SELECT q.query_id, v.id,
                     round_even(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * 1e6, 0) / 1e6 + 0.0::DOUBLE AS score
              FROM search_documents v JOIN search_queries q ON v.embedding IS NOT NULL AND q.embedding IS NOT NULL)""",
    "messages": """
        SELECT conv_id AS conversation_id, 'owner' || (conv_id % 10) AS user_id, turn, role, text AS content,
               CASE WHEN role = 'assistant' THEN CASE CAST(turn % 5 AS INT)
                    WHEN 1 THEN 'bench' WHEN 3 THEN 'utilisation' WHEN 4 THEN 'unknown' END END AS route,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created_at,
               conv_id % 9 = 0 AS is_archived
        FROM conversations""",
    "conversation_rows": """
        SELECT conversation_id, min(user_id) AS user_id,
               coalesce(CASE WHEN length(first_text) <= 60 THEN first_text
                             ELSE rtrim(substring(first_text, 1, 59)) || '…' END, 'New conversation') AS title,
               last_route, min(created_at) AS created_at, max(created_at) AS updated_at,
               count(*) AS message_count, bool_or(is_archived) AS is_archived
        FROM messages
        LEFT JOIN (SELECT conversation_id,
                          trim(regexp_replace(arg_min(content, turn) FILTER (WHERE role = 'user'), '\\s+', ' ', 'g')) AS first_text,
                          arg_max(route, turn) FILTER (WHERE route IS NOT NULL) AS last_route
                   FROM messages GROUP BY conversation_id) USING (conversation_id)
        GROUP BY conversation_id, first_text, last_route""",
    "audit": """
        SELECT event_id AS _line, CAST(ts AS TIMESTAMP) AS "timestamp",
               CASE WHEN event_type = 'error' THEN 'chat_request_failed' ELSE 'chat_request_completed' END AS event_type,
               'r' || event_id AS request_id,
               CASE WHEN event_id % 11 <> 0 THEN 'owner' || user_id END AS user_id,
               CASE WHEN event_id % 6 <> 0 THEN 'Question about ' || event_type END AS question,
               CASE WHEN event_id % 5 <> 0 THEN event_type END AS route,
               CASE WHEN event_id % 9 <> 0 THEN value END AS response_time_ms,
               event_type <> 'error' AS success
        FROM events WHERE event_id % 13 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0""",
}


def query(body: str) -> str:
    """Puts the tables that the body needs, and the ones these need, in front of it."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in TABLES:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(TABLES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in ordered)
    # A body may bring tables of its own: "NAME AS (...) SELECT ...".
    joint = "," if re.match(r"\s*\w+ AS \(", body) else ""
    return f"WITH {ctes}{joint}\n{body}"
