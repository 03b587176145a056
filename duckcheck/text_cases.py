"""Chunks, profile documents, retrieval, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import dates_in_text
from crewcast.functions.text import skill_terms
from crewcast.operators import retrieval
from crewcast.operators.chunking import chunk_rows
from crewcast.plans import profile_documents as prof
from crewcast.plans import questions
from crewcast.sources import report_store, shared_storage
from crewcast.sources.profiles import derived_profiles
from crewcast.sources.star_schema import StarSchema
from duckcheck import question_phrases as phrases
from duckcheck.case import Case, case

DIMENSIONS = 64
STAMP = "2024-01-01 00:00:00"


def _profiles(s: StarSchema) -> DataFrame:
    return prof.profile_documents(derived_profiles(s), "profiles")


def _index_rows(s: StarSchema) -> DataFrame:
    documents = s.search_documents()
    rows = prof.index_rows(
        documents.withColumns(
            {
                "id": F.col("id").cast("string"),
                "skills": F.concat(F.lit(" Spark, ,"), "source_type"),
                "is_active": F.when(F.col("id") % 2 == 0, " Yes").otherwise("no"),
                "row_number": F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("id").cast("string")),
            }
        ),
        F.lit(STAMP).cast("timestamp"),
        documents.select(F.col("id").cast("string").alias("id"), "content_vector"),
    )
    return rows


def _indexed(s: StarSchema) -> DataFrame:
    """Indexes the rows of even ids, then all rows of ids from 10 on: the second run replaces and adds."""
    path = shared_storage.fresh_path(s.spark, "index")
    rows = _index_rows(s).filter("trim(content) <> ''")
    report_store.index_documents(rows.filter("cast(id AS bigint) % 2 = 0").withColumn("title", F.lit("old")), path)
    report_store.index_documents(rows.filter("cast(id AS bigint) >= 10"), path)
    vector = F.aggregate("content_vector", F.lit(0).cast("bigint"), lambda total, x: total + F.floor(x.cast("double") * 1000))
    return s.spark.read.parquet(path).groupBy("record_type", "is_active").agg(
        F.count("*").alias("documents"),
        F.sum(F.size("skills")).alias("skills"),
        F.count_if(F.coalesce(F.col("title") == "old", F.lit(False))).alias("old_rows"),
        F.sum(vector).alias("vectors"),
    )


def _keyword(s: StarSchema, **options) -> DataFrame:
    return retrieval.keyword_search(s.search_texts(), s.search_queries(), **options)


def _hits(s: StarSchema) -> DataFrame:
    hits = _keyword(s, top_k=30)
    return hits.join(
        s.search_texts().drop("source_type"), "id"
    )


def _context(s: StarSchema) -> DataFrame:
    best = retrieval.best_per_person(_hits(s))
    return best.select("query_id", "position", retrieval.document_context(best).alias("context"))


def _question_parts(s: StarSchema) -> DataFrame:
    q = F.col("question")
    return s.questions().select(
        "question_id",
        F.array_join(skill_terms(q), "|").alias("terms"),
        F.array_join(dates_in_text(q), "|").alias("dates"),
        questions.experience_keyword(q).alias("experience_keyword"),
        questions.skill_keyword(q).alias("skill_keyword"),
        F.array_join(questions.skill_levels(q), "|").alias("levels"),
    )


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


def _matches(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


def _capture(patterns) -> str:
    parts = [f"nullif(trim(regexp_extract(q, '{p}', 1), ' ?,.!'), '')" for p in patterns]
    return f"coalesce({', '.join(parts)})"


def _first_word(column: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{w}') THEN '{w}'" for w in words) + " END"


_RULES = [
    (
        f"{_any('q', phrases.PERSON_TERMS)} AND ({_any('q', phrases.SKILL_TERMS)} OR {_matches('q', phrases.SKILL_PATTERNS)})",
        "skill_lookup", 0.96, True,
    ),
    *[(_any("q", terms), route, sure, False) for route, sure, terms in phrases.REPORT_ROUTES],
    (
        f"{_any('q', phrases.GENERIC_SKILL_TERMS)} OR {_matches('q', phrases.EXPERIENCE_PATTERNS)}",
        "skill_lookup", 0.88, True,
    ),
    (_any("q", phrases.PROFILE_TERMS), "profile_search", 0.93, True),
    (_any("q", phrases.DOCUMENT_TERMS), "document_search", 0.95, True),
    ("TRUE", "unknown", 0.25, True),
]
_FEWER = _capture(phrases.FEWER_PROJECTS_PATTERNS)
_NONE = _any("q", phrases.NO_PROJECT_TERMS)
ROUTES_SQL = f"""
SELECT question_id, question, route, confidence,
       CASE WHEN filtered THEN skill_query END AS skill_query, CASE WHEN filtered THEN availability END AS availability,
       CASE WHEN filtered THEN operator END AS active_projects_operator,
       CASE WHEN filtered THEN value END AS active_projects_value, CASE WHEN filtered THEN grp END AS group_filter
FROM (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _, _ in _RULES)} END AS route,
             CAST(CASE {' '.join(f"WHEN {c} THEN {s}" for c, _, s, _ in _RULES)} END AS DOUBLE) AS confidence,
             CASE {' '.join(f"WHEN {c} THEN {f}" for c, _, _, f in _RULES)} END AS filtered,
             {_capture(phrases.SKILL_QUERY_PATTERNS)} AS skill_query,
             CASE WHEN {_any('q', phrases.NEXT_MONTH_TERMS)} THEN 'next_month'
                  WHEN {_any('q', phrases.ON_BENCH_TERMS)} THEN 'bench' END AS availability,
             CASE WHEN {_FEWER} IS NOT NULL THEN 'lt' WHEN {_NONE} THEN 'eq' END AS operator,
             CASE WHEN {_FEWER} IS NOT NULL THEN CAST({_FEWER} AS BIGINT) WHEN {_NONE} THEN 0 END AS value,
             {_capture(phrases.GROUP_PATTERNS)} AS grp
      FROM (SELECT question_id, question, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS q FROM questions))"""

_STOP = ", ".join(
    f"'{w}'" for w in ("consultant", "consultants", "employee", "employees", "experience", "experienced", "find",
                        "has", "have", "know", "knows", "me", "show", "skill", "skills", "someone", "who", "with")
)

CHUNKS_SQL = """
SELECT {keys}, CAST(n + 1 AS INT) AS chunk_number, substring({text}, CAST(n * {step} + 1 AS BIGINT), {size}) AS chunk
FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(length({text}) - {size}, 0) / {step}.0) AS BIGINT))) AS n
      FROM {source} WHERE length({text}) > 0)"""


def _clean(column: str) -> str:
    text = f"trim(regexp_replace(CAST({column} AS VARCHAR), '\\s+', ' ', 'g'))"
    return f"CASE WHEN {column} IS NULL OR lower({text}) IN ('nan', 'none', 'nat') THEN '' ELSE {text} END"


def _label(label: str, column: str) -> str:
    return f"'{label}: ' || nullif({_clean(column)}, '')"


def _distinct_lines(source: str, section: str, skill: str = "''") -> str:
    """First of each line per person ignoring case."""
    return f"""
    SELECT '{section}' AS section, person, arg_min(line, rid) AS line, min(rid) AS rid
    FROM (SELECT lower(trim(name)) AS person, line, rid FROM ({source}) WHERE line IS NOT NULL AND line <> '')
    GROUP BY person, lower(line)"""


def _skills(source: str, section: str) -> str:
    return f"""
    SELECT '{section}' AS section, person, list(skill ORDER BY rid) AS skills
    FROM (SELECT person, arg_min(skill, rid) AS skill, min(rid) AS rid
          FROM (SELECT lower(trim(name)) AS person, skill, rid FROM ({source}) WHERE skill <> '')
          GROUP BY person, lower(skill)) GROUP BY person"""


_PERSON = "'Customer#' || lpad(CAST({0} AS VARCHAR), 9, '0')"
_ORDERS = f"(SELECT *, {_PERSON.format('o_custkey')} AS name, o_orderkey AS rid, CASE WHEN o_orderkey % 19 = 0 THEN 'Former' WHEN o_orderkey % 7 <> 0 THEN 'current' END AS status FROM orders)"
_CURRENT = "(status IS NULL OR status = 'current')"
_TECH = """
    SELECT EmployeeName AS name, _row_id AS rid, TechnologyName AS skill,
           TechnologyName || ' — ' || Knowledge_Level || '; Vendor: ' || Vendor || '; Category: ' || Type AS line
    FROM technologies WHERE Status = 'Current' AND Knowledge_Level <> 'No knowledge'"""
_EXPERTISE = f"""
    SELECT upper({_PERSON.format('user_id')}) AS name, event_id AS rid, event_type || ' ' || (event_id % 6) AS skill,
           event_type || ' ' || (event_id % 6) || ' — Advanced' AS line
    FROM events WHERE event_id % 9 NOT IN (0, 1)"""
_BUSINESS = f"""
    SELECT name, rid, 'Skill ' || o_orderpriority AS skill,
           'Skill ' || o_orderpriority || ' — Expert; Category: ' || o_orderstatus AS line
    FROM {_ORDERS} WHERE o_orderkey % 5 <> 0 AND {_CURRENT}"""
_EXPERIENCE = f"""
    SELECT name, rid, concat_ws(chr(10), 'Company: Company ' || o_orderpriority,
           'Industry: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Banking' ELSE 'Retail' END,
           'Period: ' || year(o_orderdate), 'Duration in months: ' || (o_orderkey % 24),
           'Project title: Title ' || o_orderkey, 'Description: Built things for ' || o_orderstatus) AS line, o_orderkey
    FROM {_ORDERS} WHERE {_CURRENT}"""
_EXPERIENCE_SKILLS = f"""
    SELECT name, unnest([{{'c': 1, 's': 'Tool ' || (o_orderkey % 5)}}, {{'c': 2, 's': 'tool ' || (o_orderkey % 7)}},
                         {{'c': 3, 's': CASE WHEN o_orderkey % 2 = 0 THEN 'Spark' ELSE '' END}}, {{'c': 6, 's': 'SQL'}}]) AS t, rid
    FROM ({_EXPERIENCE})"""
PROFILE_SQL = f"""
employees AS (
    SELECT c_name, title, c_custkey, c_mktsegment, n_name,
           row_number() OVER (PARTITION BY c_name ORDER BY rid DESC) AS k
    FROM (SELECT *, c_custkey AS rid, c_mktsegment AS title FROM customer
          UNION ALL SELECT *, c_custkey + 1000000000, 'Lead ' || c_mktsegment FROM customer WHERE c_custkey % 50 = 7)
    JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0),
people AS (SELECT *, lower(c_name) AS person FROM employees WHERE k = 1),
lines AS (
    SELECT 'Overview' AS section, person, concat_ws(chr(10), 'Employee name: ' || c_name, 'Job title: ' || title,
           CASE WHEN c_custkey % 3 <> 0 THEN 'Job level: Senior' END, 'Group: ' || c_mktsegment, 'Office: ' || n_name,
           'Working model: Hybrid', 'Working location: ' || n_name || ' site',
           'Years of service: ' || printf('%.1f', round_even((c_custkey % 40) / 4.0::DOUBLE * 10, 0) / 10),
           'Employment start date: ' || strftime(DATE '2010-01-01' + CAST(c_custkey % 3000 AS INT), '%Y-%m-%d')) AS line,
           0 AS rid FROM people
    UNION ALL
    SELECT 'Short profile', lower(name), concat_ws(chr(10), 'Summary: Worked on order ' || o_orderkey,
           CASE WHEN o_orderkey % 4 <> 0 THEN 'Customer: ' || o_orderpriority END,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'Project: ' || o_orderstatus END), rid FROM {_ORDERS}
    UNION ALL {_distinct_lines(_TECH, 'Technologies')}
    UNION ALL {_distinct_lines(_EXPERTISE, 'Technical expertise')}
    UNION ALL {_distinct_lines(_BUSINESS, 'Business expertise')}
    UNION ALL SELECT 'Professional experience', lower(name), line, rid FROM ({_EXPERIENCE})
    UNION ALL SELECT 'Academic qualifications', lower(c_name), 'BSc ' || c_mktsegment, c_custkey FROM customer WHERE c_custkey % 8 <> 0
    UNION ALL {_distinct_lines(f"SELECT name, rid, concat_ws(' — ', 'Training ' || o_orderpriority, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, CAST(year(o_orderdate) AS VARCHAR)) AS line FROM {_ORDERS} WHERE {_CURRENT}", 'Trainings')}
    UNION ALL {_distinct_lines(f"SELECT {_PERSON.format('l_suppkey')} AS name, min((l_orderkey * 1000000 + l_partkey) * 100 + year(l_shipdate) % 100) AS rid, 'Certified ' || p_brand || ' — ' || p_type || ' — ' || year(l_shipdate) AS line FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand, p_type, year(l_shipdate)", 'Certifications')}
    UNION ALL SELECT 'Languages', lower(c_name), 'Language ' || n_name || CASE WHEN c_custkey % 2 = 0 THEN ' — C1' ELSE '' END, c_custkey
              FROM customer JOIN nation ON c_nationkey = n_nationkey),
skills AS (
    {_skills(_TECH, 'Technologies')} UNION ALL {_skills(_EXPERTISE, 'Technical expertise')}
    UNION ALL {_skills(_BUSINESS, 'Business expertise')}
    UNION ALL {_skills(f"SELECT name, t.s AS skill, t.c * 1000000000000 + rid AS rid FROM ({_EXPERIENCE_SKILLS})", 'Professional experience')}),
texts AS (
    SELECT p.person, p.c_name, p.c_custkey, p.c_mktsegment, p.n_name, section,
           'Consultant: ' || p.c_name || chr(10) || 'Section: ' || section || chr(10) || chr(10)
           || CASE WHEN section IN ('Short profile', 'Professional experience')
                   THEN string_agg(line, E'\\n\\n' ORDER BY rid) ELSE string_agg(line, E'\\n' ORDER BY rid) END AS body
    FROM lines JOIN people p USING (person) GROUP BY p.person, p.c_name, p.c_custkey, p.c_mktsegment, p.n_name, section),
chunks AS ({CHUNKS_SQL.format(keys='person, c_name, c_custkey, c_mktsegment, n_name, section', text='body', source='texts', size=5000, step=4700)})
SELECT sha256(c_name || '|' || c.section || '|' || chunk_number) AS id, chunk AS content, c_name || ' — ' || c.section AS title,
       'profile_generator' AS source_type, 'profiles' AS source_file, c_name AS consultant_name,
       'consultant_profile' AS record_type, 'p' || c_custkey || '@example.com' AS consultant_id,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Senior' END AS "level", c_mktsegment AS "group", n_name AS office,
       TRUE AS is_active, coalesce(k.skills, []) AS skills, c.section AS sheet_name,
       sha256(c_name || '|' || c.section || '|' || chunk_number) AS chunk_id, chunk_number AS row_number
FROM chunks c LEFT JOIN skills k ON k.person = c.person AND k.section = c.section"""

_BEST_SQL = """
SELECT query_id, arg_max(id, -rank) FILTER (WHERE score = top) AS id, CAST(min(rank) AS INT) AS position
FROM (SELECT *, max(score) OVER (PARTITION BY query_id, lower(trim(consultant_name))) AS top
      FROM keyword_ranked JOIN search_documents USING (id) WHERE rank <= 30)
GROUP BY query_id, lower(trim(consultant_name))"""

CASES: dict[str, Case] = {
    "chunked_documents": case(
        lambda s: chunk_rows(s.table("documents").select("doc_id", "text"), "text"),
        CHUNKS_SQL.format(keys="doc_id", text="text", source="documents", size=1200, step=1050),
    ),
    "profile_documents": case(_profiles, PROFILE_SQL),
    "current_employees": case(
        lambda s: prof.current_employees(derived_profiles(s).employees).select(
            F.col("Employee Name").alias("name"), F.col("Job Title").alias("title"), "Email"
        ),
        """
        SELECT c_name AS name, CASE WHEN c_custkey % 50 = 7 THEN 'Lead ' || c_mktsegment ELSE c_mktsegment END AS title,
               'p' || c_custkey || '@example.com' AS Email
        FROM customer WHERE c_custkey % 13 <> 0""",
    ),
    "index_rows": case(
        lambda s: _index_rows(s).drop("content_vector"),
        f"""
        SELECT CAST(id AS VARCHAR) AS id, 'document_chunk' AS record_type, consultant_name, title, content,
               ['Spark', source_type] AS skills, CAST(NULL AS VARCHAR) AS consultant_id, CAST(NULL AS VARCHAR) AS "level",
               CAST(NULL AS VARCHAR) AS "group", CAST(NULL AS VARCHAR) AS client, CAST(NULL AS VARCHAR) AS sheet_name,
               source_type, CAST(NULL AS VARCHAR) AS source_file,
               CASE WHEN id % 3 <> 0 THEN CAST(id AS INT) END AS row_number, CAST(NULL AS INT) AS page_number,
               CAST(id AS VARCHAR) AS chunk_id, id % 2 = 0 AS is_active, TIMESTAMP '{STAMP}' AS last_modified
        FROM search_documents""",
    ),
    "indexed_documents": case(
        _indexed,
        """
        SELECT 'document_chunk' AS record_type, id % 2 = 0 AS is_active, count(*) AS documents, 2 * count(*) AS skills,
               count(*) FILTER (id < 10) AS old_rows,
               CAST(sum(list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000)))) AS BIGINT) AS vectors
        FROM search_documents WHERE trim(content) <> '' AND (id >= 10 OR id % 2 = 0) GROUP BY ALL""",
    ),
    "keyword_search": case(
        lambda s: _keyword(s, top_k=30), "SELECT * FROM keyword_ranked WHERE rank <= 30"
    ),
    "keyword_search_all": case(
        lambda s: _keyword(s, filters={"source_type": "en"}),
        """
        SELECT query_id, id, score
        FROM keyword_scores JOIN search_documents USING (id) WHERE source_type = 'en'""",
    ),
    "keyword_search_blocks": case(
        lambda s: _keyword(s, top_k=30, block_rows=15), "SELECT * FROM keyword_ranked WHERE rank <= 30"
    ),
    "vector_search_blocks": case(
        lambda s: retrieval.vector_search(
            s.search_documents(), s.search_queries(), dimensions=DIMENSIONS, block_rows=15
        ),
        "SELECT * FROM vector_ranked WHERE rank <= 30",
    ),
    "vector_search": case(
        lambda s: retrieval.vector_search(
            s.search_documents(), s.search_queries(), dimensions=DIMENSIONS
        ),
        "SELECT * FROM vector_ranked WHERE rank <= 30",
    ),
    "hybrid_search": case(
        lambda s: retrieval.hybrid_search(
            s.search_documents(), s.search_queries(), dimensions=DIMENSIONS, top_k=10
        ),
        """
        SELECT * FROM (
            SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
            FROM (SELECT query_id, id, round_even(sum(1.0::DOUBLE / (60 + rank)) * 1e6, 0) / 1e6 AS score
                  FROM (SELECT query_id, id, rank FROM keyword_ranked WHERE rank <= 30
                        UNION ALL SELECT query_id, id, rank FROM vector_ranked WHERE rank <= 30) GROUP BY query_id, id))
        WHERE rank <= 10""",
    ),
    "best_hit_per_person": case(
        lambda s: retrieval.best_per_person(_hits(s)).select("query_id", "id", "position"), _BEST_SQL
    ),
    "answer_context": case(
        _context,
        f"""
        SELECT query_id, position, 'Consultant: ' || consultant_name || chr(10) || 'Title: ' || title || chr(10) || 'Content:' || chr(10) || content AS context
        FROM ({_BEST_SQL}) JOIN search_documents USING (id)""",
    ),
    "question_routes": case(lambda s: questions.classify_questions(s.questions()), ROUTES_SQL),
    "question_parts": case(
        _question_parts,
        f"""
        SELECT question_id,
               array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(question, '\\s+', ' ', 'g')), ' '),
                               lambda w: lower(trim(w, '?,.!:;()[]{{}}'))), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), '|') AS terms,
               CASE WHEN contains(question, '13/02/2026') THEN '2026-07-01|2026-02-13' ELSE '' END AS dates,
               {_first_word('lower(question)', phrases.EXPERIENCE_KEYWORDS)} AS experience_keyword,
               {_first_word('lower(question)', phrases.SKILL_KEYWORDS)} AS skill_keyword,
               CASE WHEN contains(lower(question), 'expert') THEN 'expert'
                    WHEN contains(lower(question), 'advanced') THEN 'advanced|expert'
                    WHEN contains(lower(question), 'intermediate') THEN 'intermediate|advanced|expert'
                    WHEN contains(lower(question), 'basic') THEN 'basic|intermediate|advanced|expert'
                    ELSE 'advanced|expert' END AS levels
        FROM questions""",
    ),
}
