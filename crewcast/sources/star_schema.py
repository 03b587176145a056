"""Workforce tables derived from an order star schema.

The order tables stand in for a resourcing system: customers are people, orders are their
assignments, line items are time entries, events are leave and audit records. Every table here
is a lazy DataFrame over the given Parquet files and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewcast.functions.dates import monday
from crewcast.sources.extracts import weekly_leave_summary
from crewcast.sources.master import MasterData

AS_OF = "1998-07-20"


def _when_each(selector: Column, *values: str | None) -> Column:
    """values[selector] as a string column."""
    chosen = F.lit(None).cast("string")
    for n, value in reversed(list(enumerate(values))):
        chosen = F.when(selector == n, F.lit(value)).otherwise(chosen)
    return chosen


def _shift(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


class StarSchema:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- the three base tables -------------------------------------------------------------

    def assignments(self) -> DataFrame:
        order_key, cust_key = F.col("o_orderkey"), F.col("c_custkey")
        start = F.col("o_orderdate").cast("date")
        no_project = order_key % 4 == 0
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == cust_key)
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_custkey").cast("string").alias("Resource_Id"),
                order_key.cast("string").alias("ActivityAssignment_Id"),
                F.col("c_name").alias("Consultant_Name"),
                _when_each(cust_key % 3, "Junior", "Senior", "Lead").alias("Level"),
                F.when(cust_key % 7 != 0, F.col("c_mktsegment")).alias("Job_Title"),
                F.col("c_mktsegment").alias("Group"),
                F.when(cust_key % 11 != 0, F.col("n_name")).alias("Location"),
                F.when(~no_project, F.col("o_orderpriority")).alias("PROJECT_ID"),
                F.when(no_project, F.lit(""))
                .otherwise(F.concat(F.lit("Project "), "o_orderpriority"))
                .alias("Project_Name"),
                F.col("o_orderstatus").alias("Project_Type"),
                F.when(F.col("o_orderstatus") == "F", "Closed")
                .when(F.col("o_orderstatus") == "O", "Open")
                .otherwise("Planned")
                .alias("Project_Status"),
                start.alias("Assignment_Start"),
                F.when(order_key % 17 != 0, _shift(start, (order_key % 40 + 1) * 7)).alias(
                    "Assignment_End"
                ),
                F.lit(0).alias("Is_Active_Assignment"),
            )
        )

    def _entry_dates(self) -> DataFrame:
        """Line items with the day they were worked on."""
        worked = _shift(
            F.col("o_orderdate").cast("date"),
            (F.col("l_linenumber") - 1) * 7 + F.col("l_partkey") % 7,
        )
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
            .join(
                self.table("orders").select("o_orderkey", "o_orderdate"),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
            .withColumn("worked", worked)
        )

    def time_entries(self) -> DataFrame:
        return (
            self._entry_dates()
            .groupBy(
                F.col("l_orderkey").cast("string").alias("ActivityAssignment_Id"),
                monday(F.col("worked")).alias("WeekStart"),
            )
            .agg(F.sum(F.col("l_quantity") / 2).alias("Logged_Hours"))
            .withColumn("Consumed_Days", F.col("Logged_Hours") / 8)
            .withColumn("Capacity", F.lit(0.0))
        )

    def leave_by_type(self) -> DataFrame:
        day = _shift(F.lit("1998-01-01").cast("date"), F.col("event_id") % 365)
        hours = F.least(F.col("value"), F.lit(40.0)).cast("decimal(18,2)")
        return (
            self.table("events")
            .filter(F.col("event_type").isin("signup", "error"))
            .groupBy(
                F.col("user_id").cast("string").alias("Resource_Id"),
                monday(day).alias("WeekStart"),
                F.col("event_type").alias("Leave_Type"),
            )
            .agg(F.sum(hours).alias("Leave_Hours"))
        )

    def leave(self) -> DataFrame:
        return weekly_leave_summary(self.leave_by_type())

    def master(self) -> MasterData:
        return MasterData.of(self.assignments(), self.time_entries(), self.leave())

    # -- raw tables of the resourcing system ------------------------------------------------

    def raw_resource(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").cast("string").alias("Id"),
            F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("User"),
        )

    def raw_user(self) -> DataFrame:
        key = F.col("c_custkey").cast("string")
        return (
            self.table("customer")
            .filter(F.col("c_custkey") % 29 != 0)
            .select(
                F.concat(F.lit("u"), key).alias("Id"),
                F.concat(F.lit("login"), key).alias("Username"),
            )
        )

    def raw_employee(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("login"), key.cast("string")).alias("INTEGRATION_ID"),
                F.when(key % 31 != 0, F.col("c_name")).alias("DISPLAY_NAME"),
                _when_each(key % 3, "Junior", "Senior", "Lead").alias("JOB_LEVEL"),
                F.col("c_mktsegment").alias("JOB_TITLE"),
                F.col("c_mktsegment").alias("DEPARTMENT"),
                F.col("n_name").alias("OFFICE_LOCATION"),
            )
        )

    def raw_assignment(self) -> DataFrame:
        key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            key.cast("string").alias("Id"),
            F.when(key % 6 == 0, "Annual absence").otherwise("Client work").alias("Name"),
            F.col("o_custkey").cast("string").alias("Resource"),
            F.when(key % 10 != 0, F.col("o_orderpriority")).alias("ResourcedActivity"),
            start.alias("StartDate"),
            F.when(key % 17 != 0, _shift(start, (key % 40 + 1) * 7)).alias("ForecastP2EndDate"),
        )

    def _priorities(self) -> DataFrame:
        return self.table("orders").select("o_orderpriority").distinct()

    def raw_activity(self) -> DataFrame:
        name = F.when(F.col("o_orderpriority").startswith("1"), "Parental LEAVE").when(
            F.col("o_orderpriority").startswith("2"), " "
        )
        return self._priorities().select(
            F.col("o_orderpriority").alias("Id"),
            name.otherwise(F.concat(F.lit("Activity "), "o_orderpriority")).alias("Name"),
        )

    def raw_project(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        return (
            self._priorities()
            .filter(~priority.startswith("5"))
            .select(
                priority.alias("PROJECT_ID"),
                F.concat(F.lit("Project "), priority).alias("PROJECT_NAME"),
                F.lit("Client").alias("PROJECT_TYPE"),
                F.lit("Open").alias("PROJECT_STATUS"),
            )
        )

    def raw_time_entry(self) -> DataFrame:
        return self._entry_dates().select(
            F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey").cast("string")).alias(
                "ActivityAssignment"
            ),
            F.concat(F.lit("P"), F.col("worked").cast("string")).alias("TimePeriod"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 2).alias("EntryUnits"),
        )

    def raw_time_period(self) -> DataFrame:
        return (
            self._entry_dates()
            .select("worked")
            .distinct()
            .select(
                F.concat(F.lit("P"), F.col("worked").cast("string")).alias("Id"),
                F.col("worked").alias("EndDate"),
            )
        )

    def raw_forecast_entry(self) -> DataFrame:
        event_id = F.col("event_id")
        return self.table("events").select(
            event_id.cast("string").alias("ActivityAssignment"),
            _shift(F.lit("1997-12-01").cast("date"), event_id % 420).alias("TimePeriodStartDate"),
            F.when(event_id % 8 != 0, F.least(F.col("value"), F.lit(40.0)))
            .cast("decimal(18,2)")
            .alias("EntryUnits"),
        )

    # -- skills, documents, questions --------------------------------------------------------

    def technologies(self) -> DataFrame:
        level = F.max("l_linenumber") % 4
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("s_suppkey", "s_name", "p_name", "p_brand", "p_type")
            .agg(
                _when_each(level, "No knowledge", "Basic", "Advanced", "Expert").alias(
                    "Knowledge_Level"
                ),
                F.min(F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("_row_id"),
            )
            .select(
                "_row_id",
                F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("EmployeeName"),
                F.col("p_name").alias("TechnologyName"),
                F.col("p_brand").alias("Vendor"),
                F.col("p_type").alias("Type"),
                "Knowledge_Level",
                F.when(F.col("s_suppkey") % 10 == 0, "Former").otherwise("Current").alias("Status"),
            )
        )

    def questions(self) -> DataFrame:
        """Chat texts plus one templated question per part, so that every rule is reached."""
        key, name = F.col("p_partkey"), F.col("p_name")

        def ask(before: str, after: str = "") -> Column:
            return F.concat(F.lit(before), name, F.lit(after))

        templates = [
            ask("Who knows ", " and is on bench?"),
            ask("Which consultants have ", " experience  in the BUILDING group?"),
            ask("Who is on bench for ", "?"),
            ask("Show the consultant tracker for ", ""),
            ask("Partly assigned people on ", ""),
            ask("Detailed  utilisation of ", ""),
            ask("Utilization of ", " this year"),
            ask("List projects using ", ""),
            ask("Skills with ", ", expertise in ") + F.lit(""),
            ask("Tell me about ", " with fewer than 3 active projects"),
            ask("What does the ", " policy say?"),
            ask("Who is skilled in ", " and available next month with no active projects?"),
            ask("Is anyone certified in ", ", please!"),
            ask("  Anything else on ", " from the MACHINERY group on 2026-07-01 or 13/02/2026? "),
        ]
        templates[8] = F.concat(F.lit("Skills with "), name, F.lit(", expertise in "), name)
        text = templates[-1]
        for n, template in enumerate(templates[:-1]):
            text = F.when(key % len(templates) == n, template).otherwise(text)
        asked = self.table("part").select(
            F.concat(F.lit("part-"), key.cast("string")).alias("question_id"),
            text.alias("question"),
        )
        chat = (
            self.table("conversations")
            .filter(F.col("role") == "user")
            .select(
                F.concat_ws("-", F.lit("chat"), "conv_id", "turn").alias("question_id"),
                F.col("text").alias("question"),
            )
        )
        return chat.unionByName(asked)

    def search_texts(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.concat(F.lit("Document "), "lang").alias("title"),
            F.col("text").alias("content"),
            F.col("source").alias("consultant_name"),
            F.col("lang").alias("source_type"),
        )

    def search_documents(self) -> DataFrame:
        """Documents as search rows, with their vector where one exists."""
        vectors = self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("content_vector")
        )
        return self.search_texts().join(vectors, "id", "left")

    def search_queries(self) -> DataFrame:
        vectors = self.table("embeddings").select(
            F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector")
        )
        return (
            self.table("benchmark")
            .join(vectors, "item_id", "left")
            .select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "query_vector")
        )

    # -- chat and audit logs -----------------------------------------------------------------

    def messages(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        started = F.lit("2024-01-01 00:00:00").cast("timestamp")
        seconds = (conv * 3600 + turn * 60).cast("bigint")
        return self.table("conversations").select(
            conv.alias("conversation_id"),
            F.concat(F.lit("owner"), (conv % 10).cast("string")).alias("user_id"),
            turn.alias("turn"),
            "role",
            F.col("text").alias("content"),
            F.when(F.col("role") == "assistant", _when_each(turn % 5, None, "bench", None, "utilisation", "unknown"))
            .alias("route"),
            F.timestamp_seconds(F.unix_timestamp(started) + seconds).alias("created_at"),
            (conv % 9 == 0).alias("is_archived"),
        )

    def audit_lines(self) -> DataFrame:
        """Log lines as text: JSON events, blank lines and broken lines."""
        event_id, kind = F.col("event_id"), F.col("event_type")
        failed = kind == "error"
        record = F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
                F.when(event_id % 13 == 0, "startup")
                .when(failed, "chat_request_failed")
                .otherwise("chat_request_completed")
                .alias("event_type"),
                F.concat(F.lit("r"), event_id.cast("string")).alias("request_id"),
                F.when(event_id % 11 != 0, F.concat(F.lit("owner"), F.col("user_id").cast("string")))
                .alias("user_id"),
                F.when(event_id % 6 != 0, F.concat(F.lit("Question about "), kind)).alias("question"),
                F.when(event_id % 5 != 0, kind).alias("route"),
                F.when(event_id % 9 != 0, F.col("value")).alias("response_time_ms"),
                (~failed).alias("success"),
            )
        )
        line = (
            F.when(event_id % 97 == 0, "   ")
            .when(event_id % 89 == 0, F.substring(record, 1, 40))
            .otherwise(record)
        )
        return self.table("events").select(event_id.alias("_line"), line.alias("value"))
