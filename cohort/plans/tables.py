"""Input tables of the registered queries, derived from the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.operators.prepare import Dataset, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def gradebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items, read as a student with three subjects.

    Line items are aggregated before the join, so only one row per order meets the orders.
    """
    def best(flag: str):
        return F.lit(2) * F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))

    finished = F.count_if(F.col("l_linestatus") == "F")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.floor(F.lit(100.0) * finished / F.count("*")).cast("double").alias("attendance"),
        best("A").alias("algebra"), best("N").alias("networks"), best("R").alias("rhetoric"),
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"]).select(
        F.concat(F.lit("Order#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("student_name"),
        F.col("o_orderkey").alias("roll"),
        F.col("o_orderpriority").alias("department"),
        F.year("o_orderdate").alias("year"),
        "attendance", "algebra", "networks", "rhetoric",
    )


def prepared_gradebook(spark: SparkSession, sf_dir: str) -> Dataset:
    """The prepared gradebook. Its rows, an aggregate and a join, are made once and written."""
    return prepare(gradebook(spark, sf_dir), write=True)


def mixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their value as text and a known share of cells that are no numbers."""
    key, value = F.col("event_id"), F.col("value").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(key % 4 == 0, "absent").otherwise(value).alias("mostly_num"),
        F.when(key % 10 < 3, "x").otherwise(value).alias("edge_num"),
        F.when(key % 2 == 0, "x").otherwise(value).alias("few_num"),
        "event_type",
        F.lit(None).cast("string").alias("blank"),
    )
