"""A corpus pipeline over documents: quality rules, line dedup, near-duplicates, decontamination, tokens.

Every stage reads whole texts of any length, takes a null or empty text as one without words, keeps rows with null ids unless their own
text is rejected, judges repeated rows alike, and gives an empty table for an empty table. All but the last keep the columns of
documents, whatever else they are called; the last reads the id and the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohort.llm import bpe, decontaminate, fertility, line_dedup, simhash
from cohort.plans.tables import table
from cohort.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of their script. A text without words has too few of them and goes."""
    return fertility.keep_fertile(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines only in the document with the smallest id; n_chars follows the new text, which may be empty. Lines of
    rows without an id give way to those of any other document."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash fingerprints of three-word shingles that three bits or fewer link."""
    return simhash.keep_first(docs, distance=3, words=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. A text without words contains none; without items every document stays."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the text they decode to; none for an empty text."""
    return bpe.digests(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

# fingerprints, bands of a tokeniser and BPE have no counterpart in DuckDB's SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's input; the last one is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
