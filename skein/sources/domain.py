"""The domain tables (jobs, activities, areas, invoices, chunks) over the driver's star schema.

The mapping is fixed: orders are jobs, lines are activities and areas, documents are chunks. Lines have no key of their own, so
activity ids number the lines of an order in the order of all their columns; wholly equal lines may swap ids, which no result shows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.tables import table

LINE_COLUMNS = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def type_name(part, supp):
    """The activity type of a line."""
    kind = part % 5
    return (
        F.when(kind == 0, "Quote").when(kind == 1, "Measure").when(kind == 2, "Template").when(kind == 3, "Follow Up")
        .when(supp % 3 == 0, "Install").when(supp % 3 == 1, "Invoice").otherwise("Repair")
    )


def notes(part, supp, order, price, shipped):
    """The note of a line: payment lines, tagged numbers among dates and amounts, and plain ones."""
    text = order.cast("string")
    return (
        F.when(part % 97 == 0, F.concat(F.lit("Payment received — invoice #"), text))
        .when(part % 89 == 0, F.concat(F.lit("check-bot: order "), text, F.lit(" paid")))
        .when(part % 7 == 0, F.concat(F.lit("invoice "), text, F.lit(" for $ "), part.cast("string"), F.lit(" on "), F.date_format(shipped, "yyyy-MM-dd"), F.lit(", see # "), (order + 1).cast("string"), F.lit(".")))
        .when(part % 11 == 0, F.lit(""))
        .when(part % 13 != 0, F.concat(F.lit("Spoke with the client about part "), part.cast("string"), F.lit("/"), supp.cast("string")))
    )


class Domain:
    """The domain tables of one folder, each as a lazy DataFrame that reads the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def jobs(self) -> DataFrame:
        customer = self.raw("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        nation = self.raw("nation").select("n_nationkey", "n_name")
        o = self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return o.select(
            F.col("o_orderkey").alias("job_id"), F.col("c_name").alias("job_name"), F.concat(F.lit("Account "), F.col("o_custkey").cast("string")).alias("account_name"),
            F.col("o_orderpriority").alias("salesperson"), F.col("n_name").alias("city"), F.col("n_name").alias("city_normalized"),
            F.col("c_mktsegment").alias("process_name"), F.col("o_orderstatus").alias("job_status_name"), F.col("o_orderdate").cast("date").alias("creation_date"),
        )

    def _lines(self, lines: DataFrame) -> list:
        c = F.col
        return [
            c("l_orderkey").alias("job_id"), type_name(c("l_partkey"), c("l_suppkey")).alias("type_name"),
            F.when(c("l_returnflag") != "A", c("l_shipdate").cast("date")).alias("activity_date"), c("l_linestatus").alias("status_name"),
            notes(c("l_partkey"), c("l_suppkey"), c("l_orderkey"), c("l_extendedprice"), c("l_shipdate")).alias("notes"),
            c("l_suppkey").alias("crew_id"), F.when(c("l_linenumber") % 4 == 0, F.concat(F.lit("Phase "), c("l_linenumber").cast("string"))).alias("phase"),
        ]

    @cached_property
    def activities(self) -> DataFrame:
        """Without ids: no sort, so filters and column pruning reach the scan."""
        lines = self.raw("lineitem")
        return lines.select(*self._lines(lines))

    @cached_property
    def keyed_activities(self) -> DataFrame:
        """Activities with activity_id: 1000 times the job plus the line's place."""
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))
        lines = self.raw("lineitem").withColumn("activity_id", F.col("l_orderkey") * 1000 + place)
        return lines.select("activity_id", *self._lines(lines))

    @cached_property
    def staffed_activities(self) -> DataFrame:
        """Activities with their ids and the list of their assignees' names, found beside the line before it is numbered."""
        supplier = lambda n: self.raw("supplier").select(F.col("s_suppkey").alias(f"s{n}"), F.col("s_name").alias(f"name{n}"))
        lines = self.raw("lineitem").join(supplier(1), F.col("l_suppkey") == F.col("s1"), "left").join(supplier(2), (F.col("l_suppkey") % 2 == 0) & (F.col("l_suppkey") % 10 == F.col("s2")), "left")
        names = F.array_sort(F.array_distinct(F.array_compact(F.array("name1", "name2"))))
        lines = lines.withColumn("assignees", F.nullif(F.array_join(names, ", "), F.lit("")))
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))
        return lines.withColumn("activity_id", F.col("l_orderkey") * 1000 + place).select("activity_id", *self._lines(lines), "assignees")

    @cached_property
    def assignees(self) -> DataFrame:
        """(activity_id, assignee_name): the line's supplier, and a second one for every line of an even supplier."""
        acts = self.keyed_activities.select("activity_id", F.explode(F.when(F.col("crew_id") % 2 == 0, F.array("crew_id", F.col("crew_id") % 10)).otherwise(F.array("crew_id"))).alias("s"))
        supplier = self.raw("supplier").select(F.col("s_suppkey"), F.col("s_name").alias("assignee_name"))
        return acts.join(supplier, F.col("s") == F.col("s_suppkey")).select("activity_id", "assignee_name").distinct()

    @cached_property
    def job_areas(self) -> DataFrame:
        part = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        supplier = self.raw("supplier").select("s_suppkey", "s_name")
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
            F.col("l_orderkey").alias("job_id"), F.concat(F.lit("Area "), F.col("l_linenumber").cast("string")).alias("area_name"), F.col("p_type").alias("room_type"), F.col("l_quantity").alias("sq_ft"),
            F.col("p_name").alias("material_name"), F.col("s_name").alias("supplier"), F.col("p_brand").alias("edge"),
            F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" in"))).alias("backsplash"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("sink "), F.col("p_size").cast("string"))).alias("sink"),
        )

    @cached_property
    def areas(self) -> DataFrame:
        """Job and square feet alone, which need no join to part."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("sq_ft"))

    @cached_property
    def invoices(self) -> DataFrame:
        customer, total = self.raw("customer").select("c_custkey", "c_name"), F.col("o_totalprice").cast("decimal(18,2)")
        return self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
            F.col("o_orderkey").cast("string").alias("doc_number"), F.col("c_name").alias("customer_name"), F.col("o_orderdate").cast("date").alias("txn_date"), total.alias("total_amt"),
            F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(total).cast("decimal(18,2)").alias("balance"), F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("job_id"), F.col("text").alias("raw_text"), F.concat_ws("; ", F.concat(F.lit("language "), "lang"), F.concat(F.lit("source "), "source")).alias("facts"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")

    @cached_property
    def questions(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
