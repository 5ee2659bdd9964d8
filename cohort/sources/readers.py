"""Reading CSV, JSON and Parquet tables of unknown shape."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohort.fixed_values import MISSING_CELLS
from cohort.session import shared_folder, written
from cohort.sources.cleaning import clean_headers, clean_names, drop_blank, text_schema, typed_from_text
from cohort.sources.csv_records import broken_records, first_lines, first_records, plain_line
from cohort.sources.json_records import array_elements, nested_cells

RAW = "__raw_record"
PARTS_OF_A_SPLIT = 4     # of nested JSON, in which its rows meet
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    encoding: str = "auto",
    orient: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a file, folder or glob into a typed table without blank rows and columns.

    encoding "auto" reads CSV files that are not UTF-8 as ISO-8859-1. orient tells how a JSON document is laid out: records, columns or
    index. Quoted CSV cells may hold line breaks; files that have some are found in the pass that reads the headers, and are
    read by many tasks, too. multi_line=False takes every line for a record, True treats every file as one with breaks.
    """
    fmt = fmt or next((f for end, f in FORMATS.items() if path.lower().endswith(end)), None)
    if fmt == "csv":
        return typed_from_text(read_csv(spark, path, encoding, multi_line))
    if fmt == "json":
        return _read_json(spark, path, orient)
    if fmt == "jsonl":
        return _finish(_in_first_record_order(spark.read.json(path, mode="FAILFAST"), spark.read.text(path), "$"))
    if fmt == "parquet":
        return _finish(spark.read.parquet(path))
    raise ValueError("Unsupported file type. Use CSV, JSON or Parquet.")


def _finish(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("The file appears to be empty.")
    return drop_blank(clean_headers(df))


# CSV -----------------------------------------------------------------------------------------------------------------

def _names(header: str) -> list[str]:
    names = next(csv.reader([header.lstrip("﻿")]))
    out: list[str] = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        fresh, n = name, 0
        while fresh in out:         # exact repeats get a number, as table readers commonly do
            n += 1
            fresh = f"{name}.{n}"
        out.append(fresh)
    return out


def _text(value: Column, encoding: str) -> Column:
    return F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1" if encoding == "auto" else encoding))


def _kinds(files: DataFrame) -> list[tuple[str, str, list[str] | None]]:
    """Header, charset and files of each kind, in the order of their first files; no list of files for the only kind.

    Only one short row per file comes back, and only when there is more than one kind.
    """
    kinds = files.groupBy("header", "charset").agg(F.min("file").alias("first")).orderBy("first").collect()
    if len(kinds) == 1:
        return [(kinds[0]["header"], kinds[0]["charset"], None)]
    found: dict[tuple, list[str]] = {(k["header"], k["charset"]): [] for k in kinds}
    for r in files.select("header", "charset", "file").toLocalIterator():
        found[r["header"], r["charset"]].append(r["file"])
    return [(header, charset, sorted(names)) for (header, charset), names in found.items()]


def _files(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, header, charset, plain) of all files that are not blank, from one pass.

    A header is the first line of a file that is not blank. plain: no line leaves a quoted cell open.
    """
    text = _text(F.col("value"), encoding)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.struct(text.alias("text"), (F.trim(text) != "").alias("shown"), F.is_valid_utf8("value").alias("valid"),
                 plain_line(F.col("value")).alias("plain")).alias("line"))
    # texts are no values that a hash aggregate holds: over lines it would sort each split, over a row for each split it is small
    found = lines.mapInArrow(first_lines, "file string, block long, header string, valid boolean, plain boolean")
    files = found.groupBy("file").agg(
        F.min_by("header", F.when(F.col("header").isNotNull(), F.col("block"))).alias("header"), F.bool_and("valid").alias("valid"),
        F.count("header").alias("shown"), F.bool_and("plain").alias("plain"))
    charset = F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1") if encoding == "auto" else F.lit(encoding)
    return files.where("shown > 0").select("file", "header", charset.alias("charset"), "plain")


def _parse_options(names: list[str]) -> dict:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "quote": '"', "escape": '"', "maxColumns": str(max(20480, len(names) + 1))}


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    """The kept columns of parsed rows; rows with too many fields are left out, missing cells are null."""
    # the parser hands over the raw text of rows whose field count differs from the header's; separators inside
    # quotes do not count
    unquoted = F.regexp_replace(RAW, r'"[^"]*+(?:""[^"]*+)*+"', "")
    extra = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) >= len(names)
    # the length test is always true: it keeps one data column in every scan, which the reader insists on
    df = df.where((F.col(RAW).isNull() | ~extra) & (F.coalesce(F.length("c0"), F.lit(0)) >= 0))
    return df.select(*[F.when(~F.col(f"c{i}").isin(MISSING_CELLS), F.col(f"c{i}")).alias(name) for i, name in clean_names(names)])


def _read_lines(spark: SparkSession, header: str, charset: str, files: list[str]) -> DataFrame:
    """Files in which every line is a record."""
    names = _names(header)
    # rows are judged by all their fields, whatever columns a query needs
    return _cells(spark.read.schema(text_schema([f"c{i}" for i in range(len(names))], RAW)).options(
        header=True, enforceSchema=True, encoding=charset, columnPruning=False, **_parse_options(names)).csv(files), names)


def _read_broken(spark: SparkSession, files: list[str], encoding: str) -> list[DataFrame]:
    """Files with line breaks in quoted cells, one frame for each kind."""
    records = broken_records(spark, files).withColumn("value", F.col("text").cast("string"))
    shown = records.where(F.trim("value") != "").withColumn("text", _text(F.col("value"), encoding))
    first = shown.select("file", "block", "seq", "text", F.is_valid_utf8("value").alias("valid")).mapInArrow(
        first_records, "file string, block long, seq long, header string, valid boolean")
    per_file = first.groupBy("file").agg(
        F.min_by("header", F.struct("block", "seq")).alias("header"), F.min(F.struct("block", "seq")).alias("first"),
        F.bool_and("valid").alias("valid"))
    charset = F.when(F.col("valid"), "UTF-8").otherwise("ISO-8859-1") if encoding == "auto" else F.lit(encoding)
    known = written(per_file.withColumn("charset", charset), "headers")
    # one row for each file, so that a file of any size stays in its splits
    body = shown.join(F.broadcast(known.select("file", "first", "charset", "header")), "file").where(F.struct("block", "seq") != F.col("first"))
    parts = []
    for header, charset_name, _ in _kinds(known):
        names = _names(header)
        own = body.where((F.col("header") == header) & (F.col("charset") == charset_name))
        text = F.decode(F.col("value").cast("binary"), charset_name) if charset_name != "UTF-8" else F.col("value")
        schema = ", ".join([*[f"c{i} string" for i in range(len(names))], f"{RAW} string"])
        parts.append(_cells(own.select(F.from_csv(text, schema, _parse_options(names)).alias("row")).select("row.*"), names))
    return parts


def read_csv(spark: SparkSession, path: str, encoding: str = "auto", multi_line: bool | None = None) -> DataFrame:
    """All-text CSV scan: short rows are padded, rows with too many fields are left out, missing cells are null.

    Every file is read by its own header; columns that a file lacks are null in its rows.
    """
    files = _files(spark, path, encoding).persist()
    try:
        plain = files.where(F.lit(True) if multi_line is False else F.lit(False) if multi_line else F.col("plain"))
        broken = [] if multi_line is False else [unquote(r["file"]) for r in (files if multi_line else files.where(~F.col("plain"))).select("file").collect()]
        kinds = _kinds(plain) if plain.take(1) else []
        if not kinds and not broken:
            raise ValueError("The file appears to be empty.")
        if broken and kinds and kinds[0][2] is None:
            kinds = [(*kinds[0][:2], sorted(r["file"] for r in plain.select("file").toLocalIterator()))]
    finally:
        files.unpersist()
    parts = [_read_lines(spark, header, charset, [path] if names is None else [unquote(n) for n in names]) for header, charset, names in kinds]
    if broken:
        parts += _read_broken(spark, sorted(broken), encoding)
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df


# JSON ----------------------------------------------------------------------------------------------------------------

def _in_first_record_order(df: DataFrame, text: DataFrame, path: str) -> DataFrame:
    """Columns in the order of the first record, the others after them (the reader sorts them by name)."""
    keys = text.select(F.json_object_keys(F.get_json_object("value", path)).alias("keys"))
    first = keys.where(F.col("keys").isNotNull()).first()
    order = [k for k in (first["keys"] if first else []) if k in df.columns]
    order += [c for c in df.columns if c not in order]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in order])


def _read_json(spark: SparkSession, path: str, orient: str | None) -> DataFrame:
    # a document may be one line, so only what stands before its first comma is looked at
    begin = F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", ""))
    start = spark.read.option("lineSep", ",").text(path).select(F.substring(begin, 1, 1).alias("c")).where("c <> ''").first()
    if start is None:
        raise ValueError("The file appears to be empty.")
    if start[0] not in "[{":
        raise ValueError("Cannot interpret JSON structure as a table.")
    orient = orient or ("records" if start[0] == "[" else "columns")
    if orient == "records":
        return _finish(_read_array(spark, path))
    if orient in ("columns", "index"):
        return typed_from_text(clean_headers(_read_nested_json(spark, path, orient)))
    raise ValueError("Cannot interpret JSON structure as a table.")


def _read_array(spark: SparkSession, path: str) -> DataFrame:
    """The elements of arrays, written once as one element a line, which Spark reads in splits."""
    elements = array_elements(spark, path)
    lines = shared_folder(spark, "elements")
    elements.select("value").write.text(lines)
    df = spark.read.json(lines, mode="FAILFAST")
    return _in_first_record_order(df, elements.orderBy("file", "block", "seq").limit(1), "$") if df.columns else df


def _read_nested_json(spark: SparkSession, path: str, orient: str) -> DataFrame:
    """A document of the form {column: {row: cell}} or {column: [cell]}, or with rows outside (index)."""
    cells = nested_cells(spark, path)
    inner = F.coalesce("inner", F.col("place").cast("string"))
    row, name, order = (inner, F.col("outer"), "outer_place") if orient == "columns" else (F.col("outer"), inner, "place")
    cells = cells.select("file", row.alias("row"), name.alias("name"), F.col(order).alias("order"), "value")
    # column names are metadata: one short list
    found = cells.groupBy("name").agg(F.min("order").alias("order")).orderBy("order", "name").collect()
    if not found:
        raise ValueError("Cannot interpret JSON structure as a table.")
    names = [r["name"] for r in found]
    # rows meet in parts that grow with the documents in number, not in size; before the aggregate, so that it sorts texts once
    scan = spark.read.option("lineSep", ",").text(path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_OF_A_SPLIT * scan.rdd.getNumPartitions())
    return cells.repartition(n, "file", "row").groupBy("file", "row").pivot("name", names).agg(F.first("value", ignorenulls=True)).drop("file", "row")
