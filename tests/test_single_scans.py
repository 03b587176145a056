"""Tables are read as often as the work needs, whatever the number of sections."""

from pyspark.sql import functions as F

from crewcast.operators.chunking import assemble_chunks
from crewcast.plans import profile_documents as plan
from crewcast.plans.profile_documents import profile_documents
from crewcast.sources.profiles import ProfileTables
from crewcast.sources.shared_storage import written


def counted(spark, df, column):
    """df, whose column passes a function that counts its rows, and the count."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(value):
        seen.add(1)
        return value

    return df.withColumn(column, count.asNondeterministic()(F.col(column))), seen


def profile_tables(spark, technologies):
    def empty(columns):
        return spark.createDataFrame([], f"_row_id bigint, {columns}")

    employee = ("Employee Name", "Employment status", "Email", "Job Title", "Job level", "Group", "Function", "Office", "Working model", "Working location", "Years of service", "Employment start date")
    people = [(n, name, "Current", f"{name}@x", *[None] * 9) for n, name in enumerate(("Ann", "ANN", "Bob"))]
    experience = ("EmployeeName", "CompanyName", "CustomerName", "Industry", "Period", "Duration in months", "Project title", "Project", "All technologies", "Technology1", "Status")
    text = lambda names: ", ".join(f"`{c}` string" for c in names)
    return ProfileTables(
        employees=spark.createDataFrame(people, f"_row_id bigint, {text(employee)}"),
        short_profiles=empty(text(["Consultant Name", "Summary", "Customer", "Project"])),
        technologies=technologies,
        technical_expertise=empty(text(["EmployeeName", "TechnicalExpertiseName", "Knowledge_Level", "Status"])),
        business_expertise=empty(text(["EmployeeName", "BusinessSkill", "Category", "Knowledge_Level", "Status"])),
        experience=empty(text(experience)),
        academic=empty(text(["EmployeeName", "Academic qualification", "Status"])),
        trainings=empty(text(["Employee name", "Training", "Vendor", "Year", "Status"])),
        certifications=empty(text(["Employee name", "Certification", "Vendor", "Year", "Status"])),
        languages=empty(text(["Employee name", "Language", "Level", "Status"])),
    )


def test_lines_of_profiles_are_stored_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(plan, "written", lambda df, path: stored.append(df.columns) or written(df, path))
    rows = [(3, "ann", "SPARK"), (1, "ann", "Spark"), (2, "ann", "spark"), (1, "ann", "Spark"), (None, "ann", "Go"), (4, "bob", "SPARK"), (9, "ann", "straße"), (8, "ann", "STRASSE")]
    technologies = spark.createDataFrame(rows, "_row_id bigint, EmployeeName string, TechnologyName string").withColumns(
        {"Vendor": F.lit(None).cast("string"), "Type": F.lit(None).cast("string"), "Knowledge_Level": F.lit("Expert"), "Status": F.lit("Current")}
    )
    found = profile_documents(profile_tables(spark, technologies), "file").filter("sheet_name = 'Technologies'").collect()
    texts = {r.consultant_name: r.content.split("\n\n")[1] for r in found}
    assert texts["Ann"].strip().split("\n") == ["Spark — Expert", "STRASSE — Expert"] and texts["Bob"] == "SPARK — Expert"
    assert sum("line" in columns or "piece" in columns for columns in stored) == 1


def test_skill_tables_are_read_once(spark):
    rows = [(1, "ann", "Spark"), (2, "Ann", "SPARK"), (3, "bob", "Go"), (4, None, "Go"), (4, "ann", "a — Expert"), (5, "ann", "A")]
    technologies = spark.createDataFrame(rows, "_row_id bigint, EmployeeName string, TechnologyName string").withColumns(
        {"Vendor": F.lit(None).cast("string"), "Type": F.lit(None).cast("string"), "Knowledge_Level": F.lit("Expert"), "Status": F.lit("Current")}
    )
    technologies, seen = counted(spark, technologies, "TechnologyName")
    found = profile_documents(profile_tables(spark, technologies), "file").filter("sheet_name = 'Technologies'").collect()
    assert seen.value == len(rows)
    # Names that differ in case only share their sections and keep their own details.
    texts = {r.consultant_name: (r.consultant_id, r.content.split("\n\n")[1], r.skills) for r in found}
    ann = ("Spark — Expert\na — Expert — Expert\nA — Expert", ["Spark", "a — Expert", "A"])
    assert texts == {"Ann": ("Ann@x", *ann), "ANN": ("ANN@x", *ann), "Bob": ("Bob@x", "Go — Expert", ["Go"])}


def test_chunks_of_small_and_large_keys(spark):
    rows = [("a", n, "x" * (n % 7)) for n in range(40)] + [("b", n, f"{n:03}") for n in range(9)] + [(None, 0, ""), ("c", 0, None), ("c", 1, "last")]
    pieces = spark.createDataFrame(rows, "k string, n bigint, piece string")
    for most in (100, 5):
        got = assemble_chunks(pieces, ["k"], "n", "piece", F.concat(F.lit("<"), F.coalesce("k", F.lit("-")), F.lit(">")), chunk_size=11, overlap=4, rows_per_range=most)
        texts = {}
        for r in got.orderBy("chunk_number").collect():
            texts[r.k] = texts[r.k] + r.chunk[4:] if r.k in texts else r.chunk
        assert texts == {k: f"<{k or '-'}>" + "".join(p or "" for key, _, p in rows if key == k) for k in ("a", "b", None, "c")}
