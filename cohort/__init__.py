"""cohort: Spark jobs over tables of people and scores, document collections and conversation logs."""

from cohort.operators.prepare import Dataset, column_mapping, prepare
from cohort.sources.readers import load_table

__all__ = ["Dataset", "column_mapping", "load_table", "prepare"]
