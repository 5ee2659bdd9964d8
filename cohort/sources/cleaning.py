"""Header and blank cleaning, typing of text columns, and the shape report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohort.functions.exprs import col
from cohort.operators.prepare import check_name_clash, is_integer_text, is_long_id_text, numeric_text

BOOLEAN = r"^(?i:true|false)$"


def clean_names(names: Sequence[str]) -> list[tuple[int, str]]:
    """Position and stripped name of every column that is kept: later duplicates go."""
    first: dict[str, int] = {}
    for i, name in enumerate(names):
        first.setdefault(name.strip(), i)
    return [(i, name) for name, i in first.items()]


def clean_headers(df: DataFrame) -> DataFrame:
    """Strip column names and keep the first of several equal ones."""
    kept = clean_names(df.columns)
    check_name_clash([n for _, n in kept], df.sparkSession.conf.get("spark.sql.caseSensitive") == "true")
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_position.select(*[F.col(f"c{i}").alias(name) for i, name in kept])


def _any_present(df: DataFrame) -> Column:
    return F.coalesce(*[F.when(col(c).isNotNull(), True) for c in df.columns], F.lit(False))


def drop_blank(df: DataFrame) -> DataFrame:
    """Drop rows without any value, then columns without any value; one counting pass."""
    counts = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    kept = [c for c, n in zip(df.columns, counts) if n]
    if not kept:
        raise ValueError("The table has no values.")
    # a row whose kept columns are all null has no value at all
    return df.select(*[col(c) for c in kept]).where(_any_present(df.select(*[col(c) for c in kept])))


def typed_from_text(df: DataFrame) -> DataFrame:
    """Type text columns whose values all parse, and drop blank rows and columns; one counting pass.

    Whole numbers without a gap become long, other numbers double, true/false boolean; whole numbers beyond a long stay text.
    """
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [
            F.count(col(c)).alias(f"present_{i}"),
            F.count(numeric_text(col(c))).alias(f"numbers_{i}"),
            F.count_if(is_integer_text(col(c))).alias(f"whole_{i}"),
            F.count_if(is_long_id_text(col(c))).alias(f"beyond_{i}"),
            F.count_if(col(c).rlike(BOOLEAN)).alias(f"booleans_{i}"),
        ]
    found = df.agg(*aggs).first()
    rows = found["rows"]
    if not rows:
        raise ValueError("The file appears to be empty.")
    out = []
    for i, c in enumerate(df.columns):
        present = found[f"present_{i}"]
        if not present:
            continue
        value = col(c)
        if found[f"whole_{i}"] == rows:
            value = F.trim(value).try_cast("long")
        elif found[f"numbers_{i}"] == present and not found[f"beyond_{i}"]:
            value = numeric_text(value)
        elif found[f"booleans_{i}"] == present:
            value = value.try_cast("boolean")
        out.append(value.alias(c))
    if not out:
        raise ValueError("The table has no values.")
    return df.where(_any_present(df)).select(*out)


def dataset_profile(df: DataFrame) -> DataFrame:
    """Column, type, present values and rows of a table, from one aggregate."""
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.count(col(f.name)).alias("non_null"),
            F.count("*").alias("rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def text_schema(names: Sequence[str], raw: str | None = None) -> T.StructType:
    """All-text schema, with an extra column for the raw record."""
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([raw] if raw else [])]])
