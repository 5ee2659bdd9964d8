"""Physical plans: what must and what must not be in them."""

import pytest

from cohort.operators import charts as C
from cohort.operators import conversation as H
from cohort.operators import reports as R
from cohort.operators import retrieval as V
from cohort.plans.tables import table


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", [
    "dataset_summary", "department_stats", "department_table", "top_rows", "subject_analysis", "attendance_stats",
    "low_attendance_by_department", "performance_classes", "student_names",
])
def test_reports_stay_in_the_engine(book, capsys, name):
    text = plan(getattr(R, name)(book), capsys)
    assert not any(w in text for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "PythonUDF"))


def test_compare_and_search_without_a_cross_join(book, capsys):
    for df in (R.compare(book, ["a", "b"]), R.name_search(book, "a"), C.comparison_scores(book, ["a", "b"])):
        text = plan(df, capsys)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_shapes(book, capsys):
    assert "TakeOrderedAndProject" in plan(R.top_rows(book), capsys)
    for df in (R.subject_top(book), R.compare(book, ["a", "b"])):
        assert "Partial" in plan(df, capsys).split("WindowGroupLimit", 1)[1]


def test_department_stats_shuffle_only_once_after_the_input(book, capsys):
    text = plan(R.department_stats(book.materialised()), capsys)
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_scans_read_only_the_needed_columns(book, capsys):
    text = plan(R.attendance_stats(book.materialised()), capsys)
    assert "ReadSchema: struct<attendance:double>" in text


def test_buffers_limit_before_the_shuffle(spark, sf_dir, capsys):
    text = plan(H.buffer(table(spark, sf_dir, "conversations"), 4), capsys)
    assert text.count(", Partial") == 2 and "EqualTo(role,system)" in text and "Join" not in text


def test_retrieval_keeps_the_chunks_in_place(spark, sf_dir, capsys):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "text")
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text")
    text = plan(V.tfidf_topk(V.tfidf_index(docs), docs, queries), capsys)
    assert "Join" not in text and "CartesianProduct" not in text and text.count("Exchange hashpartitioning") == 1
