import pytest
from pyspark.sql import functions as F

from crewcast.operators import filters
from crewcast.plans import people, questions
from crewcast.plans.calendar import consultant_calendar
from tests.workforce import AS_OF, assignment, hours, leave, master

ROUTES = [
    ("Who is on bench?", "bench", 0.99),
    ("Who knows Azure?", "skill_lookup", 0.96),
    ("What does the leave policy say?", "document_search", 0.95),
    ("Show profile experience in Azure", "profile_search", 0.93),
    ("What does the Azure policy document say?", "document_search", 0.95),
    ("Show the CONSULTANT   tracker", "consultant_tracker", 0.99),
    ("partially assigned people", "partial_assignments", 0.98),
    ("detailed utilization please", "utilisation_detailed", 0.98),
    ("utilisation", "utilisation", 0.97),
    ("list projects", "project_tracker", 0.90),
    ("which technologies do we have", "skill_lookup", 0.88),
    ("tell me about Ann", "profile_search", 0.93),
    ("the whole team knows nothing", "skill_lookup", 0.96),  # 'who' inside 'whole'
    ("hello", "unknown", 0.25),
    ("Şu an kim boşta", "bench", 0.99),
]


@pytest.fixture(scope="module")
def classify(spark):
    def run(*texts):
        df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, question string")
        return questions.classify_questions(df).orderBy("n").collect()

    return run


def test_routes(classify):
    found = classify(*[q for q, _, _ in ROUTES])
    assert [(r.question, r.route, r.confidence) for r in found] == ROUTES


def test_filters(classify):
    rows = classify(
        "Who knows Azure and is on bench?",
        "Which consultants have data engineering experience in the Data & AI group, free next month?",
        "Who is skilled in dbt? under 2 active projects",
        "anyone certified in , expertise in Spark! with no active projects",
        "Who is on bench?",
        "profile from the Sales group",
    )
    got = [(r.skill_query, r.availability, r.active_projects_operator, r.active_projects_value, r.group_filter) for r in rows]
    assert got == [
        ("azure", "bench", None, None, None),
        ("data engineering", "next_month", None, None, "data & ai"),
        ("dbt", None, "lt", 2, None),
        ("spark! with no active projects", None, "eq", 0, None),
        (None, None, None, None, None),
        (None, None, None, None, "sales"),
    ]


def test_keywords(spark):
    df = spark.createDataFrame([("Expert in Power BI for retail banking",), ("basic email",), ("x",)], "q string")
    q = F.col("q")
    got = df.select(questions.skill_keyword(q), questions.experience_keyword(q), questions.skill_levels(q)).collect()
    assert [tuple(r) for r in got] == [
        ("power bi", "banking", ["expert"]),
        ("ai", None, ["basic", "intermediate", "advanced", "expert"]),
        (None, None, ["advanced", "expert"]),
    ]


@pytest.fixture(scope="module")
def calendar(spark):
    data = master(
        spark,
        [
            assignment("1", "a1", "2026-01-01", "2026-07-25", name="José Ünal"),
            assignment("2", "a2", "2026-01-01", None, name="Ann", Group="Sales"),
            assignment("2", "a3", "2026-01-01", None, name="Ann", Group="Sales", project_id="P2"),
            assignment("3", "a4", "2026-01-01", None, name="Bob"),
        ],
        [hours("a2", "2026-07-20", 40), hours("a4", "2026-07-20", 20), hours("a4", "2026-08-03", 20)],
        [leave("2", "2026-08-03", 8)],
    )
    return consultant_calendar(data, AS_OF).cache()


def names(df):
    return sorted(r["Consultant_Name"] for r in df.collect())


def test_availability(calendar):
    assert names(people.available_next_month(calendar, AS_OF)) == ["Bob", "José Ünal"]
    assert names(people.currently_bench(calendar, AS_OF)) == ["José Ünal"]
    assert names(people.available_next_month(calendar, "2026-12-05")) == []
    assert names(people.currently_bench(calendar, "2026-01-02")) == ["Ann", "Bob", "José Ünal"]


def test_bench_on_date_and_first_bench_week(calendar):
    on_date = people.bench_on_date(calendar, "2026-07-22", AS_OF).collect()
    assert [(r["Consultant_Name"], r["2026-07-20"], r["Matched_Week"]) for r in on_date] == [("José Ünal", "B", "2026-07-20")]
    first = {r["Consultant_Name"]: r["First_Bench_Week"] for r in people.future_bench(calendar, "2026-07-01").collect()}
    assert first == {"José Ünal": "2026-07-06", "Ann": "2026-07-06", "Bob": "2026-07-06"}
    later = {r["Consultant_Name"]: r["First_Bench_Week"] for r in people.future_bench(calendar, "2026-07-15").collect()}
    assert later == {"José Ünal": "2026-07-20"}


def test_find_people(calendar):
    find = lambda **f: names(people.find_people(calendar, AS_OF, **f))
    assert find() == ["Ann", "Bob", "José Ünal"]
    assert find(active_projects={"operator": "gte", "value": 2}) == ["Ann"]
    assert find(active_projects={"operator": "around", "value": 2}) == ["Ann", "Bob", "José Ünal"]
    assert find(group=" SAL") == ["Ann"] and find(group="s.l") == []
    assert find(availability="next_month", active_projects={"operator": "lt", "value": 2}, group="data") == ["Bob", "José Ünal"]


def test_documents_of_people(spark, calendar):
    documents = spark.createDataFrame([("1", "jose unal"), ("2", "ANN"), ("3", None), ("4", "-")], "id string, consultant_name string")
    bench = people.currently_bench(calendar, AS_OF)
    assert [r.id for r in people.documents_of(documents, bench).collect()] == ["1"]
    context = people.workforce_context(people.people_of(bench, documents), "bench").first()["context"]
    assert context == (
        "Verified workforce information for José Ünal:\nGroup: Data\nActive projects: 1\n"
        "Availability filter verified: the consultant is currently BENCH."
    )


SKILLS = [
    ("Ann", "Azure SQL", "Microsoft", "Expert", "Current"),
    ("Ann", "Azure SQL", "Microsoft", "Expert", " current "),
    ("Bob", "AZURE", "Microsoft", " No Knowledge ", "Current"),
    ("Cid", "azure", "Microsoft", None, "Current"),
    ("Dan", "azure", "Microsoft", "Basic", "Former"),
    ("Eve", "Spark", "Apache", "none", None),
]


@pytest.fixture(scope="module")
def skills(spark):
    return spark.createDataFrame(SKILLS, "EmployeeName string, TechnologyName string, Vendor string, Knowledge_Level string, Status string")


def test_skill_lookup_and_replay(skills):
    found = lambda df: [r.EmployeeName for r in df.collect()]
    assert found(filters.skill_matches(skills, ["azure"])) == ["Ann"]
    assert found(filters.known_rows(skills)) == ["Ann", "Ann"]
    saved = {"replay_supported": True, "report_name": "technologies", "filters": {"search_terms": ["AZURE "]}}
    assert found(filters.replay_skill_filter(skills, saved)) == ["Ann", "Bob", "Cid", "Dan"]
    assert found(filters.replay_skill_filter(skills, {**saved, "replay_supported": False})) == []
    assert len(found(filters.replay_skill_filter(skills, {**saved, "filters": None}))) == 5
    assert filters.replay_skill_filter(skills, {**saved, "report_name": "languages"}) is skills


def test_rows_mentioning_stays_inside_cells(spark):
    df = spark.createDataFrame([("ab", "cd"), ("x", "bc")], "a string, b string")
    assert filters.rows_mentioning(df, "bc").count() == 1
    assert filters.rows_mentioning(df, "").count() == 0
    assert filters.technology_rows(df, "X", ["B"]).count() == 1


def test_same_people(spark):
    left = spark.createDataFrame([(" Ann", "d1"), ("Bob", "d2")], "Consultant_Name string, `Group` string")
    right = spark.createDataFrame([("ANN ", "s1"), ("ann", "s2")], "Employee string, `Group` string")
    joined = filters.same_people(left, right)
    assert sorted(joined.columns) == ["Consultant_Name", "Employee", "Group_availability", "Group_profile"]
    assert joined.count() == 2
    with pytest.raises(ValueError, match="no name column"):
        filters.same_people(left, right.drop("Employee"))
