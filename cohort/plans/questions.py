"""Questions for the router: sample questions, and texts of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.plans.tables import table

# Sample questions, in their usual order.
SAMPLE_QUESTIONS = [
    "Which department has the highest average marks?",
    "Show me students with attendance below 75%",
    "Who are the top 5 students overall?",
    "Predict performance for student John",
    "What is the average score in Mathematics?",
    "Compare department-wise attendance",
    "Summarise the dataset",
    "Which department has highest marks?",
    "Show students with low attendance",
    "Analyse subject performance",
    "Give me an overview",
    "How many are there?",
    "Tell me about my account",
    "My account",
]


def sample_questions(spark: SparkSession) -> DataFrame:
    """The sample questions as query_id, text."""
    rows = [(f"sample:{i:02d}", text) for i, text in enumerate(SAMPLE_QUESTIONS)]
    return spark.createDataFrame(rows, "query_id string, text string")


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample questions, one question per department, and every user message of the conversations."""
    # every order priority is a department of the gradebook, so orders alone give the names
    ordered = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"
    )
    groups = ordered.select(F.col("o_orderpriority").alias("department")).distinct().select(
        F.concat(F.lit("group:"), "department").alias("query_id"),
        F.concat(F.lit("Compare algebra and grade of "), "department").alias("text"),
    )
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("query_id"), "text"
    )
    return sample_questions(spark).unionByName(groups).unionByName(said)
