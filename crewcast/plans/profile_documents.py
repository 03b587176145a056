"""Profile tables → search documents, one set of chunks per person and section."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewcast.functions.dates import iso_text
from crewcast.functions.numbers import fixed_text
from crewcast.functions.text import (
    casefold,
    clean_text,
    document_id,
    known_text,
    labelled,
    null_if_blank,
    optional_int,
    skill_list,
    strip,
    truthy,
)
from crewcast.operators.chunking import assemble_chunks
from crewcast.operators.filters import current_rows, known_rows
from crewcast.sources.profiles import ProfileTables
from crewcast.sources.shared_storage import fresh_path, written

# Size and overlap of profile chunks, and the source they are filed under.
PROFILE_CHUNK, PROFILE_OVERLAP = 5000, 300
PROFILE_SOURCE = "profile_generator"
EXPERIENCE_TECHNOLOGIES = tuple(f"Technology{n}" for n in range(1, 7))
DASH = " — "
#: Parts into which the lines of a person's section are dealt. Without influence on results.
LINE_PARTS = 16


def current_employees(employees: DataFrame) -> DataFrame:
    """Current people with a name; the last row of each name."""
    columns = [c for c in employees.columns if c != "Employee Name"]
    return (
        employees.withColumn("Employee Name", strip(F.col("Employee Name")))
        .filter(
            (F.lower(strip(F.col("Employment status"))) == "current")
            & F.col("Employee Name").isNotNull()
        )
        .groupBy("Employee Name")
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "_row_id").alias("_row"))
        .select("`Employee Name`", "_row.*")
    )


def _people(employees: DataFrame) -> DataFrame:
    """Employees with the cleaned name their documents carry and the key sections join on."""
    name = clean_text(F.col("Employee Name"))
    return (
        current_employees(employees)
        .withColumn("consultant_name", name)
        .filter((name != "") & (name == F.col("Employee Name")))
        .withColumn("_person", casefold(name))
    )


def overview_lines(people: DataFrame) -> DataFrame:
    # A value that is no number or date is shown as it is written.
    years = F.coalesce(fixed_text(F.col("Years of service").try_cast("double"), 1), clean_text(F.col("Years of service")))
    started = F.col("Employment start date")
    started = F.coalesce(iso_text(started.try_cast("date")), clean_text(started))
    fields = [
        labelled("Employee name", F.col("Employee Name")),
        labelled("Job title", F.col("Job Title")),
        labelled("Job level", F.col("Job level")),
        labelled("Group", F.col("Group")),
        labelled("Function", F.col("Function")),
        labelled("Office", F.col("Office")),
        labelled("Working model", F.col("Working model")),
        labelled("Working location", F.col("Working location")),
        labelled("Years of service", years),
        labelled("Employment start date", started),
    ]
    return people.select("_person", F.lit(0).cast("bigint").alias("_row_id"), F.concat_ws("\n", *fields).alias("line"))


def _lines(df: DataFrame, name: str, line: Column, skill: Column | None = None) -> DataFrame:
    """(_person, _row_id, line, skill) of a section table; empty lines dropped.

    A filter on a projected line would be pushed below the projection and build the line twice;
    it stays above a generator.
    """
    person = casefold(strip(F.col(name).cast("string"))).alias("_person")
    skill = F.lit(None).cast("string") if skill is None else skill
    cell = F.array(F.struct(line.alias("line"), skill.alias("skill")))
    return df.select(person, "_row_id", F.inline(cell)).filter("line <> ''")


def first_of_each(spelled: DataFrame, value: str, order: Column) -> DataFrame:
    """(_person, section, value, _order): distinct values ignoring case; the first spelling and position stay.

    Give each spelling once, with its smallest position, so that few rows are left to be folded
    and sorted. They are dealt out before they are sorted, as folding leaves nearly all of them.
    """
    keys = ["_person", "section", "_folded"]
    folded = spelled.select("_person", "section", value, order.alias("_order"), casefold(F.col(value)).alias("_folded"))
    return folded.repartition(*keys).groupBy(*keys).agg(
        F.min_by(value, "_order").alias(value), F.min("_order").alias("_order")
    ).drop("_folded")


def marked_spellings(repeated: DataFrame) -> DataFrame:
    """(_person, section, line, skill, _row_id, _first): distinct spellings with their smallest position.

    _first says whether a spelling is the first of its line, ignoring case. Rows move once, dealt by person, section
    and a small number of the folded line, and neither the folded text nor single spellings move again.
    """
    keys = ["_person", "section", "_part"]
    folded = casefold(F.col("line"))
    dealt = repeated.withColumn("_part", F.pmod(F.xxhash64(folded), F.lit(LINE_PARTS)).cast("int")).repartition(*keys)
    # Equal spellings are reduced by their smallest position alone, in a hash aggregate.
    spelled = dealt.groupBy(*keys, "line", "skill").agg(F.min("_row_id").alias("_row_id"))
    order = [F.col("_row_id").asc_nulls_last(), "line", "skill"]
    nth = F.row_number().over(Window.partitionBy(*keys, "_folded").orderBy(*order))
    return spelled.withColumn("_folded", folded).withColumn("_first", nth == 1).drop("_folded", "_part")


def short_profile_lines(df: DataFrame) -> DataFrame:
    parts = [labelled(label, F.col(label)) for label in ("Summary", "Customer", "Project")]
    return _lines(df, "Consultant Name", F.concat_ws("\n", *parts))


def _with_details(name: Column, *details: Column) -> Column:
    """'name — detail; detail'; null for an empty name."""
    present = F.nullif(F.concat_ws("; ", *details), F.lit(""))
    return F.concat(known_text(name), F.coalesce(F.concat(F.lit(DASH), present), F.lit("")))


def _level() -> Column:
    return known_text(F.col("Knowledge_Level"))


def technology_lines(df: DataFrame) -> DataFrame:
    line = _with_details(
        F.col("TechnologyName"),
        _level(),
        labelled("Vendor", F.col("Vendor")),
        labelled("Category", F.col("Type")),
    )
    return _lines(known_rows(df), "EmployeeName", line, clean_text(F.col("TechnologyName")))


def knowledge_lines(df: DataFrame, name: str, category: str | None = None) -> DataFrame:
    details = [_level()] + ([labelled("Category", F.col(category))] if category else [])
    return _lines(known_rows(df), "EmployeeName", _with_details(F.col(name), *details), clean_text(F.col(name)))


def experience_lines(df: DataFrame) -> DataFrame:
    labels = (
        ("Company", "CompanyName"), ("Customer", "CustomerName"), ("Industry", "Industry"),
        ("Period", "Period"), ("Duration in months", "Duration in months"),
        ("Project title", "Project title"), ("Description", "Project"),
        ("Technologies", "All technologies"),
    )
    parts = [labelled(label, F.col(column)) for label, column in labels]
    return _lines(current_rows(df), "EmployeeName", F.concat_ws("\n", *parts))


def simple_lines(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    values = [known_text(F.col(c)) for c in columns]
    return _lines(current_rows(df), name, F.concat_ws(DASH, *values))


def experience_skills(df: DataFrame) -> DataFrame:
    """All of the first technology column come first, then all of the second, and so on."""
    present = [c for c in EXPERIENCE_TECHNOLOGIES if c in df.columns]
    cells = F.array(*[F.struct(F.lit(n).alias("_column"), clean_text(F.col(c)).alias("skill")) for n, c in enumerate(present)])
    person = casefold(strip(F.col("EmployeeName").cast("string"))).alias("_person")
    return current_rows(df).select(person, "_row_id", F.inline(cells)).filter("skill <> ''")


def _skills(named: DataFrame) -> DataFrame:
    """(_person, skills): per section the distinct names in order of column and row."""
    spelled = named.groupBy("_person", "section", "skill", "_column").agg(F.min("_row_id").alias("_row_id"))
    distinct = first_of_each(spelled, "skill", F.struct("_column", "_row_id"))
    ordered = F.sort_array(F.collect_list(F.struct("_order", "skill")))
    sections = distinct.groupBy("_person", "section").agg(ordered["skill"].alias("skills"))
    return sections.groupBy("_person").agg(F.map_from_entries(F.collect_list(F.struct("section", "skills"))).alias("_skills"))


def _of_sections(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("section", F.lit(name)) for name, df in tables.items()])


def profile_documents(tables: ProfileTables, source_file: str) -> DataFrame:
    """All section documents of the current employees.

    The rows of the section tables are read once; lines and skills are both made from their
    distinct spellings. The lines are reduced to distinct ones per name before they meet the
    employees, and the sections' texts are cut into chunks without ever being built whole. Lines
    lie by person from there on, so that chunks meet their person where they are made.
    """
    spark = tables.employees.sparkSession
    people = _people(tables.employees)
    people = written(people, fresh_path(spark, "profile-people"))
    experience = "Professional experience"
    repeated = _of_sections(
        {
            "Technologies": technology_lines(tables.technologies),
            "Technical expertise": knowledge_lines(tables.technical_expertise, "TechnicalExpertiseName"),
            "Business expertise": knowledge_lines(tables.business_expertise, "BusinessSkill", "Category"),
            "Academic qualifications": simple_lines(tables.academic, "EmployeeName", ["Academic qualification"]),
            "Trainings": simple_lines(tables.trainings, "Employee name", ["Training", "Vendor", "Year"]),
            "Certifications": simple_lines(tables.certifications, "Employee name", ["Certification", "Vendor", "Year"]),
            "Languages": simple_lines(tables.languages, "Employee name", ["Language", "Level"]),
        }
    )
    spelled = written(marked_spellings(repeated), fresh_path(spark, "profile-spellings"))
    # As everywhere, a line without a position is no text.
    line = F.when(F.col("_row_id").isNotNull(), F.col("line"))
    once = spelled.filter("_first").select("_person", "section", line.alias("line"), "_row_id")
    # Every line stands for itself here.
    single = _of_sections(
        {
            "Overview": overview_lines(people),
            "Short profile": short_profile_lines(tables.short_profiles).drop("skill"),
            experience: experience_lines(tables.experience).drop("skill"),
        }
    )
    # Every piece starts with its section's separator; the header adds what is missing to an
    # empty line between header and first line.
    wide_gap = F.col("section").isin("Short profile", experience)
    separator = F.when(wide_gap, "\n\n").otherwise("\n")
    pieces = single.unionByName(once).select(
        "_person", "section", "_row_id", F.concat(separator, "line").alias("piece")
    )
    header = F.concat(
        F.lit("Consultant: "), "consultant_name", F.lit("\nSection: "), "section",
        F.when(wide_gap, "").otherwise("\n"),
    )
    chunks = assemble_chunks(
        pieces.repartition("_person").join(people.select("_person", "consultant_name"), "_person"),
        ["_person", "consultant_name", "section"],
        "_row_id",
        "piece",
        header,
        chunk_size=PROFILE_CHUNK,
        overlap=PROFILE_OVERLAP,
    )
    details = F.struct(
        clean_text(F.col("Email")).alias("consultant_id"),
        clean_text(F.col("Job level")).alias("level"),
        clean_text(F.col("Group")).alias("group"),
        clean_text(F.col("Office")).alias("office"),
    )
    # Names that differ in case only are one person to the sections.
    named = people.groupBy("_person").agg(F.map_from_entries(F.collect_list(F.struct("consultant_name", details))).alias("_details"))
    skills = spelled.filter("skill is not null").select("_person", "section", "_row_id", "skill", F.lit(0).alias("_column"))
    skills = skills.unionByName(_of_sections({experience: experience_skills(tables.experience)}))
    identity = document_id(F.col("consultant_name"), F.col("section"), F.col("chunk_number"))
    own = F.element_at("_details", F.col("consultant_name"))
    return (
        chunks.join(named.join(_skills(skills), "_person", "left"), "_person")
        .select(
            identity.alias("id"),
            F.col("chunk").alias("content"),
            F.concat("consultant_name", F.lit(DASH), "section").alias("title"),
            F.lit(PROFILE_SOURCE).alias("source_type"),
            F.lit(source_file).alias("source_file"),
            "consultant_name",
            F.lit("consultant_profile").alias("record_type"),
            *[own[c].alias(c) for c in ("consultant_id", "level", "group", "office")],
            F.lit(True).alias("is_active"),
            F.coalesce(F.try_element_at("_skills", F.col("section")), F.array().cast("array<string>")).alias("skills"),
            F.col("section").alias("sheet_name"),
            identity.alias("chunk_id"),
            F.col("chunk_number").alias("row_number"),
        )
    )


# The fields of a search index row that are plain optional text.
_INDEX_TEXT = ("consultant_id", "level", "group", "client", "sheet_name")


def index_rows(documents: DataFrame, indexed_at: Column, vectors: DataFrame | None = None) -> DataFrame:
    """The 19 fields of a search index row, with defaults for what a document lacks.

    `vectors` (id, content_vector) are made by an external model and joined where given.
    """
    have = set(documents.columns)

    def value(name: str, kind: str = "string") -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None).cast(kind)

    if "skills" not in have:
        skills = F.array().cast("array<string>")
    elif dict(documents.dtypes)["skills"] == "string":
        skills = skill_list(F.col("skills"))
    else:
        given = F.coalesce("skills", F.array().cast("array<string>"))
        skills = F.filter(F.transform(given, strip), lambda s: s != "")
    rows = documents.select(
        F.col("id"),
        F.coalesce(value("record_type"), F.lit("document_chunk")).alias("record_type"),
        value("consultant_name").alias("consultant_name"),
        value("title").alias("title"),
        F.col("content"),
        skills.alias("skills"),
        *[null_if_blank(value(c)).alias(c) for c in _INDEX_TEXT],
        value("source_type").alias("source_type"),
        value("source_file").alias("source_file"),
        optional_int(value("row_number")).alias("row_number"),
        value("page_number", "int").cast("int").alias("page_number"),
        null_if_blank(F.coalesce(value("chunk_id"), F.col("id"))).alias("chunk_id"),
        (F.coalesce(truthy(value("is_active")), F.lit(True)) if "is_active" in have else F.lit(True)).alias("is_active"),
        F.coalesce(value("last_modified", "timestamp").cast("timestamp"), indexed_at).alias("last_modified"),
    )
    if vectors is None:
        return rows.withColumn("content_vector", F.lit(None).cast("array<float>"))
    return rows.join(vectors.select("id", "content_vector"), "id", "left")
