"""Every registered query against its SQL on the smallest test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import database, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, con, name):
    assert difference(spark, con, sf_dir, name, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_has_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert sum(r["count"] for r in rows) == 1473
    grades = {}
    for r in rows:
        for g, n in r["grade_dist"].items():
            grades[g] = grades.get(g, 0) + n
    assert grades == {"A+": 19, "A": 129, "B": 376, "C": 387, "D": 315, "F": 247}


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from cohort.plans.oracles import STOP_WORDS

    assert sorted(STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))
