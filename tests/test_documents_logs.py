from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crewcast.operators.chunking import assemble_chunks, chunk_rows
from crewcast.operators.numbering import number_rows
from crewcast.operators.quality import message_violations
from crewcast.plans import logs
from crewcast.plans.profile_documents import profile_documents
from crewcast.sources.audit_log import load_audit_events
from crewcast.sources.profiles import ProfileTables
from crewcast.streaming import feeds


def chunks_of(text, size, overlap):
    """Plain statement of the rule: steps of size - overlap until a chunk reaches the end."""
    starts = range(0, max(len(text) - overlap, 1), size - overlap)
    return [text[s : s + size] for s in starts] if text else []


@pytest.mark.parametrize("length, count", [(0, 0), (1, 1), (1200, 1), (1201, 2), (2250, 2), (2251, 3)])
def test_chunk_counts(spark, length, count):
    df = spark.createDataFrame([("x" * length,)], "text string")
    assert chunk_rows(df, "text").count() == count


def test_chunks_of_non_ascii_text(spark):
    text = "".join(chr(0x61 + n % 26) + "é" for n in range(3000))
    found = chunk_rows(spark.createDataFrame([(text,)], "text string"), "text", chunk_size=700, overlap=100)
    assert [r.chunk for r in found.orderBy("chunk_number").collect()] == chunks_of(text, 700, 100)
    for bad in ({"chunk_size": 0}, {"chunk_size": 5, "overlap": 5}, {"overlap": -1}):
        with pytest.raises(ValueError):
            chunk_rows(found, "chunk", **bad)


@pytest.mark.parametrize("bucket", [20, 150, 100_000])
def test_assembled_chunks_equal_chunks_of_the_whole_text(spark, bucket):
    """One key holds most pieces, and the pieces lie in many ranges."""
    pieces, texts = [], {}
    for key, count in (("hot", 900), ("small", 2), ("one", 1)):
        for n in range(count):
            pieces.append((key, n * 5 % 4001, f"\n{key} line {n} " + "é" * (n % 23)))
        ordered = sorted((p for p in pieces if p[0] == key), key=lambda p: p[1])
        texts[key] = f"<{key}>" + "".join(p[2] for p in ordered)
    pieces = list({(k, o): (k, o, t) for k, o, t in pieces}.values())
    for key in texts:
        ordered = sorted((p for p in pieces if p[0] == key), key=lambda p: p[1])
        texts[key] = f"<{key}>" + "".join(p[2] for p in ordered)
    df = spark.createDataFrame(pieces, "k string, o bigint, p string")
    prefix = F.concat(F.lit("<"), "k", F.lit(">"))
    found = assemble_chunks(df, ["k"], "o", "p", prefix, chunk_size=50, overlap=15, rows_per_range=bucket)
    got = {}
    for r in found.orderBy("k", "chunk_number").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {k: chunks_of(t, 50, 15) for k, t in texts.items()}


def test_profile_documents(spark):
    def table(rows, schema):
        return spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], f"_row_id bigint, {schema}")

    employee = "`Employee Name` string, `Employment status` string, Email string, `Job Title` string, `Job level` string, `Group` string, `Function` string, Office string, `Working model` string, `Working location` string, `Years of service` double, `Employment start date` string"
    skill = "EmployeeName string, {0} string, Category string, Knowledge_Level string, Status string"
    tables = ProfileTables(
        employees=table(
            [
                (" Ann Straße", "Current", "a@x", "Old", "nan", "Data", None, "Paris", None, None, 2.25, "2020-01-02"),
                ("Ann Straße ", " CURRENT", "a@x", "Lead", "nan", "Data", None, "Paris", None, "a  b", 2.25, "2020-01-02"),
                ("Bob", "Left", "b@x", "Lead", "", "", "", "", "", "", None, None),
                ("None", "current", "c@x", "Lead", "", "", "", "", "", "", None, None),
            ],
            employee,
        ),
        short_profiles=table([("ann STRASSE", "Hello   there", "nan", None), ("Bob", "x", "", "")], "`Consultant Name` string, Summary string, Customer string, Project string"),
        technologies=table(
            [
                ("Ann Straße", "Spark", "Apache", "Engine", "Expert", "Current"),
                ("ANN STRASSE", "SPARK", "apache", "ENGINE", "expert", None),
                ("Ann Straße", "Azure", None, "", "Basic", "current"),
                ("Ann Straße", "Java", None, "", " No knowledge", "current"),
                ("Ann Straße", "Go", None, "", None, "current"),
                ("Ann Straße", "Rust", None, "", "Expert", "Former"),
                ("Ann Straße", " ", None, "", "Expert", "Current"),
            ],
            "EmployeeName string, TechnologyName string, Vendor string, Type string, Knowledge_Level string, Status string",
        ),
        technical_expertise=table([], skill.format("TechnicalExpertiseName")),
        business_expertise=table([("Ann Straße", "Sales", "Soft", "Basic", None)], skill.format("BusinessSkill")),
        experience=table(
            [
                ("Ann Straße", "A", "C", "T2", "t1", "Current"), ("Ann Straße", "B", None, "T3", "T1", None),
                ("Ann Straße", None, None, None, None, None),
            ],
            "EmployeeName string, CompanyName string, CustomerName string, Technology1 string, Technology2 string, Status string",
        ).withColumns({c: F.lit(None).cast("string") for c in ("Industry", "Period", "Duration in months", "Project title", "Project", "All technologies")}),
        academic=table([], "EmployeeName string, `Academic qualification` string, Status string"),
        trainings=table([("Ann Straße", "T", None, "2020", None)], "`Employee name` string, Training string, Vendor string, Year string, Status string"),
        certifications=table([], "`Employee name` string, Certification string, Vendor string, Year string, Status string"),
        languages=table([("Ann Straße", "French", "C1", "current")], "`Employee name` string, Language string, Level string, Status string"),
    )
    rows = {r["sheet_name"]: r for r in profile_documents(tables, "file").collect()}
    head = "Consultant: Ann Straße\nSection: {0}\n\n"
    assert {n: r["content"].removeprefix(head.format(n)) for n, r in rows.items()} == {
        "Overview": "Employee name: Ann Straße\nJob title: Lead\nGroup: Data\nOffice: Paris\nWorking location: a b\nYears of service: 2.2\nEmployment start date: 2020-01-02",
        "Short profile": "Summary: Hello there",
        "Technologies": "Spark — Expert; Vendor: Apache; Category: Engine\nAzure — Basic",
        "Business expertise": "Sales — Basic; Category: Soft",
        "Professional experience": "Company: A\nCustomer: C\n\nCompany: B",
        "Trainings": "T — 2020",
        "Languages": "French — C1",
    }
    assert rows["Technologies"]["skills"] == ["Spark", "Azure"]
    assert rows["Professional experience"]["skills"] == ["T2", "T3", "t1"]
    assert rows["Overview"]["skills"] == [] and rows["Overview"]["level"] == ""
    import hashlib

    assert rows["Overview"]["id"] == hashlib.sha256("Ann Straße|Overview|1".encode()).hexdigest()


def test_numbering_over_ranges(spark):
    df = spark.range(0, 1000).selectExpr("if(id < 900, 'hot', 'cold') AS k", "id * id * id AS o")
    numbered = number_rows(df, ["k"], "o", "n", rows_per_range=10)
    assert numbered.filter("n = if(k = 'hot', round(cbrt(o)) + 1, round(cbrt(o)) - 899)").count() == 1000


def test_numbering_keeps_nulls_at_every_size(spark):
    rows = [(k, o, f"{k}{o}{n}") for k, count in (("hot", 60), (None, 30), ("cold", 2)) for n in range(count) for o in (n % 20 if n % 7 else None,)]
    df = spark.createDataFrame(rows, "k string, o bigint, t string")
    results = [sorted(map(str, number_rows(df, ["k"], "o", "n", ties=["t"], rows_per_range=most).collect())) for most in (5, 40, 1000)]
    assert len(results[0]) == len(rows) and results[0] == results[1] == results[2]
    numbers = sorted(r.n for r in number_rows(df, ["k"], "o", "n", rows_per_range=5).filter("k IS NULL").collect())
    assert numbers == list(range(1, 31))


def test_chunks_keep_pieces_without_order(spark):
    df = spark.createDataFrame([("a", None, "null one "), ("a", 2, "three"), ("a", 1, "two "), (None, 1, "x")], "k string, o bigint, p string")
    for bucket in (1, 100):
        found = assemble_chunks(df, ["k"], "o", "p", F.lit(""), chunk_size=50, overlap=5, rows_per_range=bucket)
        assert {r.k: r.chunk for r in found.collect()} == {"a": "null one two three", None: "x"}


MESSAGES = [
    (1, "u1", 0, "system", "be nice", None, 0), (1, "u1", 1, "user", "  Who is\non bench?  ", None, 1),
    (1, "u1", 2, "assistant", "Ann", "bench", 2), (1, "u1", 3, "assistant", "?", None, 3),
    (2, "u1", 0, "assistant", "hi", None, 90), (3, "u2", 0, "user", "x", "unknown", 5),
]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(c, u, t, r, x, route, datetime(2026, 7, 20, 8, minute % 60), False) for c, u, t, r, x, route, minute in MESSAGES]
    return spark.createDataFrame(rows, "conversation_id bigint, user_id string, turn bigint, role string, content string, route string, created_at timestamp, is_archived boolean")


def test_conversations(messages):
    summary = {r.conversation_id: r for r in logs.conversation_summary(messages).collect()}
    assert (summary[1].title, summary[1].last_route, summary[1].message_count) == ("Who is on bench?", "bench", 4)
    assert (summary[2].title, summary[2].last_route) == ("New conversation", None)
    conversations = logs.conversation_summary(messages)
    assert [r.conversation_id for r in logs.list_conversations(conversations, "u1").collect()] == [2, 1]
    assert logs.list_conversations(conversations, "u1", limit=0).count() == 0
    recent = logs.recent_conversations(conversations, "2026-07-21", limit=1).collect()
    assert sorted((r.user_id, r.conversation_id, r.label) for r in recent) == [("u1", 2, "Yesterday"), ("u2", 3, "Yesterday")]
    numbered = logs.number_messages(messages)
    assert [r.sequence_number for r in logs.list_messages(numbered, 1, "u1").collect()] == [1, 2, 3, 4]
    assert logs.list_messages(numbered, 1, "u2").count() == 0


def test_violations(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "robot", " "), (2, 0, None, None)], "conversation_id bigint, turn bigint, role string, content string")
    found = sorted((r.conversation_id, r.problem) for r in message_violations(df).collect())
    assert found == [(1, "blank content"), (1, "repeated number"), (1, "unknown role"), (2, "blank content"), (2, "unknown role")]


LOG = """
{"timestamp": "2026-07-20T08:00:00+00:00", "event_type": "chat_request_completed", "request_id": "r1", "route": "bench", "response_time_ms": 92, "success": true, "sources": ["a"]}

not json
{"timestamp": "2026-07-20T09:00:00+00:00", "event_type": "chat_request_completed", "request_id": "r2", "response_time_ms": "fast", "success": true}
{"timestamp": "2026-07-20T10:00:00+00:00", "event_type": "chat_request_failed", "request_id": "r3", "response_time_ms": 5, "success": false
{"timestamp": "later", "event_type": "chat_request_failed", "request_id": "r4", "success": false, "response_time_ms": 7}
{"event_type": "startup"}
{"timestamp": "2026-07-20T11:00:00+00:00", "event_type": "chat_request_completed", "request_id": "r5", "route": "bench", "response_time_ms": 125, "user_id": "u"}
"""


def test_audit_log(spark, tmp_path):
    path = tmp_path / "audit.log"
    path.write_text(LOG, encoding="utf-8")
    events = load_audit_events(spark, str(path))
    assert [r.request_id for r in events.collect()] == ["r5", "r2", "r1", "r4"]
    assert [r.request_id for r in load_audit_events(spark, str(path), limit=2).collect()] == ["r5", "r2"]
    assert logs.audit_summary(events).first().asDict() == {
        "total_requests": 4, "successful_requests": 3, "failed_requests": 1, "average_response_time": "108 ms",
    }
    assert [tuple(r) for r in logs.requests_by_route(events).collect()] == [("bench", 2), (None, 1)]
    table = {r["request_id"]: r for r in logs.request_table(events).collect()}
    assert (table["r2"]["Response Time"], table["r2"]["User"], table["r2"]["Success"]) == ("- ms", "Unknown user", "✅")
    assert (table["r5"]["Response Time"], table["r5"]["Success"], table["r5"]["Route"]) == ("125 ms", "❌", "bench")
    empty = events.limit(0)
    assert logs.audit_summary(empty).first()["average_response_time"] == "0 ms"


def test_streams_continue_from_their_checkpoint(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "timestamp timestamp, route string"

    def arrive(*events):
        rows = [(datetime.fromisoformat(t), r) for t, r in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        result = feeds.run_available(feeds.request_counts(stream), target, state)
        return sorted((str(r.window_start)[:10], r.route, r.request_count) for r in result.collect())

    arrive(("2026-07-20 08:00", "bench"), ("2026-07-20 09:00", "bench"), ("2026-07-21 08:00", "bench"))
    assert run() == [("2026-07-20", "bench", 2)]
    arrive(("2026-07-22 08:00", "bench"), ("2026-07-20 10:00", "bench"))  # the second is too late
    assert run() == [("2026-07-20", "bench", 2), ("2026-07-21", "bench", 1)]


def test_weekly_hours_start_on_monday(spark, tmp_path):
    schema = "ActivityAssignment_Id string, ts timestamp, hours double"
    rows = [("a", datetime(2026, 7, 13), 4.0), ("a", datetime(2026, 7, 19, 23), 4.0), ("a", datetime(2026, 8, 30), 1.0)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    result = feeds.run_available(feeds.weekly_hours(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(str(r.WeekStart), r.Logged_Hours, r.Consumed_Days) for r in result.collect()] == [("2026-07-13", 8.0, 1.0)]


def test_profile_tables_are_read_back(spark, tmp_path):
    from dataclasses import fields

    from crewcast.sources.profiles import derived_profiles
    from crewcast.sources.star_schema import StarSchema

    derived = derived_profiles(StarSchema(spark, "/root/testdata/sf0.001"))
    for field in fields(ProfileTables):
        getattr(derived, field.name).write.option("header", True).csv(str(tmp_path / field.name))
    stored = ProfileTables.read(spark, str(tmp_path), "csv")
    assert stored.employees.schema["_row_id"].dataType.typeName() == "long"
    assert stored.languages.count() == derived.languages.count()
    assert stored.employees.first()["Employee Name"].strip().startswith("Customer#")
