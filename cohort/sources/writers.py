"""Writing tables and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohort.functions.exprs import col


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write a table as a folder of CSV files with headers, or of Parquet files."""
    if fmt == "csv":
        df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("Unsupported file type. Use CSV or Parquet.")


def preview(df: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """The first n rows by the given keys."""
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def preview_text(df: DataFrame, keys: Sequence[str], n: int = 50) -> DataFrame:
    """The first n rows as CSV lines; the header is line 0."""
    spark = df.sparkSession
    header = spark.range(1).select(
        F.lit(0).alias("line"), F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)])).alias("text")
    )
    first = preview(df, keys, n)
    body = first.agg(F.array_sort(F.collect_list(F.struct(
        *[col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.to_csv(F.struct(*[col(c) for c in df.columns])).alias("text")
    ))).alias("rows")).select(F.posexplode("rows").alias("line", "row"))
    return header.unionByName(body.select((F.col("line") + 1).alias("line"), F.col("row.text").alias("text")))
