"""The ten profile tables of the people directory."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewcast.operators.spreading import spread
from crewcast.sources.master import require_columns
from crewcast.sources.star_schema import StarSchema


@dataclass(frozen=True)
class ProfileTables:
    """Each table brings `_row_id` (bigint, unique per table), the order of its rows."""

    employees: DataFrame
    short_profiles: DataFrame
    technologies: DataFrame
    technical_expertise: DataFrame
    business_expertise: DataFrame
    experience: DataFrame
    academic: DataFrame
    trainings: DataFrame
    certifications: DataFrame
    languages: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str, file_format: str = "parquet") -> ProfileTables:
        """Tables stored as folder/<field name>, in Parquet or as CSV with a header."""
        reader = spark.read.format(file_format)
        if file_format == "csv":
            reader = reader.option("header", True).option("multiLine", True)
        tables: Mapping[str, DataFrame] = {
            f.name: require_columns(reader.load(f"{folder}/{f.name}"), ["_row_id"], f.name)
            .withColumn("_row_id", F.col("_row_id").cast("bigint"))
            for f in fields(cls)
        }
        return cls(**tables)


def _person(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def derived_profiles(star: StarSchema) -> ProfileTables:
    """Profile tables over the star schema: customers are the employees."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    customers = star.table("customer").join(
        star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = spread(star.table("orders")).withColumn("employee", _person(F.col("o_custkey")))
    events = spread(star.table("events")).withColumn("employee", _person(F.col("user_id")))
    year = F.year("o_orderdate").cast("string")

    def employee_rows(df: DataFrame, row_id, title) -> DataFrame:
        return df.select(
            row_id.alias("_row_id"),
            F.concat(F.lit(" "), "c_name").alias("Employee Name"),
            F.when(key % 13 == 0, "Left").otherwise(" Current ").alias("Employment status"),
            F.concat(F.lit("p"), key.cast("string"), F.lit("@example.com")).alias("Email"),
            title.alias("Job Title"),
            F.when(key % 3 == 0, "nan").otherwise("Senior").alias("Job level"),
            F.col("c_mktsegment").alias("Group"),
            F.lit(None).cast("string").alias("Function"),
            F.col("n_name").alias("Office"),
            F.lit("Hybrid").alias("Working model"),
            F.concat(F.col("n_name"), F.lit("   site")).alias("Working location"),
            (key % 40 / 4).alias("Years of service"),
            F.date_add(F.lit("2010-01-01").cast("date"), (key % 3000).cast("int")).alias(
                "Employment start date"
            ),
        )

    employees = employee_rows(customers, key, F.col("c_mktsegment")).unionByName(
        employee_rows(
            customers.filter(key % 50 == 7),
            key + 1000000000,
            F.concat(F.lit("Lead "), "c_mktsegment"),
        )
    )
    status = F.when(order % 19 == 0, "Former").when(order % 7 != 0, "current")
    name = F.col("employee")
    line = (F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 100 + F.year("l_shipdate") % 100
    supplies = (
        star.table("lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
        .join(star.table("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand", "p_type", F.year("l_shipdate").cast("string").alias("Year"))
        .agg(F.min(line).alias("_row_id"))
    )
    return ProfileTables(
        employees=employees,
        short_profiles=orders.select(
            order.alias("_row_id"),
            F.concat(name, F.lit(" ")).alias("Consultant Name"),
            F.concat(F.lit("Worked   on order "), order.cast("string")).alias("Summary"),
            F.when(order % 4 != 0, F.col("o_orderpriority")).alias("Customer"),
            F.when(order % 5 == 0, "None").otherwise(F.col("o_orderstatus")).alias("Project"),
        ),
        technologies=star.technologies(),
        technical_expertise=events.select(
            F.col("event_id").alias("_row_id"),
            F.upper("employee").alias("EmployeeName"),
            F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 6).cast("string")).alias(
                "TechnicalExpertiseName"
            ),
            F.when(F.col("event_id") % 9 == 0, " No Knowledge")
            .when(F.col("event_id") % 9 != 1, "Advanced")
            .alias("Knowledge_Level"),
            F.lit("Current").alias("Status"),
        ),
        business_expertise=orders.select(
            order.alias("_row_id"),
            name.alias("EmployeeName"),
            F.concat(F.lit("Skill "), "o_orderpriority").alias("BusinessSkill"),
            F.col("o_orderstatus").alias("Category"),
            F.when(order % 5 == 0, "none").otherwise("Expert").alias("Knowledge_Level"),
            status.alias("Status"),
        ),
        experience=orders.select(
            order.alias("_row_id"),
            name.alias("EmployeeName"),
            F.concat(F.lit("Company "), "o_orderpriority").alias("CompanyName"),
            F.lit(None).cast("string").alias("CustomerName"),
            F.when(order % 3 == 0, "Banking").otherwise("Retail").alias("Industry"),
            year.alias("Period"),
            (order % 24).cast("string").alias("Duration in months"),
            F.concat(F.lit("Title "), order.cast("string")).alias("Project title"),
            F.concat(F.lit("Built  things for "), "o_orderstatus").alias("Project"),
            F.lit("nan").alias("All technologies"),
            F.concat(F.lit("Tool "), (order % 5).cast("string")).alias("Technology1"),
            F.concat(F.lit("tool "), (order % 7).cast("string")).alias("Technology2"),
            F.when(order % 2 == 0, "Spark").alias("Technology3"),
            F.lit(" ").alias("Technology4"),
            F.lit(None).cast("string").alias("Technology5"),
            F.lit("SQL").alias("Technology6"),
            status.alias("Status"),
        ),
        academic=customers.select(
            key.alias("_row_id"),
            F.col("c_name").alias("EmployeeName"),
            F.concat(F.lit("BSc "), "c_mktsegment").alias("Academic qualification"),
            F.when(key % 8 == 0, "Old").alias("Status"),
        ),
        trainings=orders.select(
            order.alias("_row_id"),
            name.alias("Employee name"),
            F.concat(F.lit("Training "), "o_orderpriority").alias("Training"),
            F.when(order % 3 != 0, F.col("o_orderstatus")).alias("Vendor"),
            year.alias("Year"),
            status.alias("Status"),
        ),
        certifications=supplies.select(
            "_row_id",
            _person(F.col("l_suppkey")).alias("Employee name"),
            F.concat(F.lit("Certified "), "p_brand").alias("Certification"),
            F.col("p_type").alias("Vendor"),
            "Year",
            F.lit(None).cast("string").alias("Status"),
        ),
        languages=customers.select(
            key.alias("_row_id"),
            F.col("c_name").alias("Employee name"),
            F.concat(F.lit("Language "), "n_name").alias("Language"),
            F.when(key % 2 == 0, "C1").otherwise("").alias("Level"),
            F.lit("current").alias("Status"),
        ),
    )
