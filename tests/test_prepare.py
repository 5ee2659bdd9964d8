import pytest
from pyspark.sql import functions as F

from cohort.functions import exprs as X
from cohort.operators import prepare as P
from cohort.plans.tables import gradebook


def one(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def values(ds, column):
    return [r[0] for r in ds.df.select(f"`{column}`").collect()]


def test_numeric_share_is_strict(spark):
    rows = [(str(i) if i < 7 else "x", str(i) if i < 8 else "x") for i in range(10)]
    ds = P.prepare(one(spark, "edge string, most string", rows))
    assert dict(ds.df.dtypes)["edge"] == "string" and dict(ds.df.dtypes)["most"] == "double"


def test_missing_rows_count_against_a_text_column(spark):
    rows = [("1",)] * 7 + [(None,)] * 3
    assert dict(P.prepare(one(spark, "a string", rows)).df.dtypes)["a"] == "string"


def test_number_texts(spark):
    texts = [" 12 ", "1e3", "inf", "1,000", "NaN", "1f", "1d", "+.5", "5.", "", "0x1"]
    df = one(spark, "t string", [(t,) for t in texts]).select(P.numeric_text(F.col("t")))
    assert [r[0] for r in df.collect()] == [12.0, 1000.0, float("inf"), None, None, None, None, 0.5, 5.0, None, None]


def test_whole_numbers_become_long(spark):
    ds = P.prepare(one(spark, "a string, b string", [("1", "1"), ("2", None), ("3", "3"), ("4", "4")]))
    assert dict(ds.df.dtypes) | {"Total": 0, "Average": 0, "Grade": 0} == {
        "a": "bigint", "b": "double", "Total": 0, "Average": 0, "Grade": 0}


def test_median_and_unknown(spark):
    ds = P.prepare(one(spark, "name string, algebra double", [("a", 10.0), (None, None), ("c", 40.0), ("d", float("nan"))]))
    assert values(ds, "algebra") == [10.0, 25.0, 40.0, 25.0] and values(ds, "name") == ["a", "Unknown", "c", "d"]


def test_approximate_median_stays_within_the_values(spark):
    ds = P.prepare(one(spark, "algebra double", [(1.0,), (None,), (2.0,), (3.0,)]), approx_median=True)
    assert values(ds, "algebra")[1] == 2.0


def test_booleans(spark):
    rows = [(i, True, None if i == 7 else i != 0, None if i else True) for i in range(8)]
    ds = P.prepare(one(spark, "algebra long, full boolean, most boolean, few boolean", rows))
    assert dict(ds.df.dtypes)["full"] == "boolean" and ds.subjects == ("algebra", "most")
    assert values(ds, "most") == [0.0] + [1.0] * 7 and values(ds, "few") == ["True"] + ["Unknown"] * 7


def test_alias_order_and_last_column(spark):
    assert P.detect_column(["Student", "Full Name", "name"], "student_name") == "name"
    assert P.detect_column(["Full-Name", "full name"], "student_name") == "full name"
    assert P.detect_column(["marks"], "student_name") is None


def test_role_columns_can_be_subjects(spark):
    df = one(spark, "name string, attendance_pct double, roll_no long, maths double", [("a", 50.0, 1, 60.0), ("b", 70.0, 2, 80.0)])
    ds = P.prepare(df)
    assert ds.attendance == "attendance_pct" and ds.subjects == ("attendance_pct", "roll_no", "maths")
    assert P.prepare(df, exclude_roles=True).subjects == ("maths",)


def test_subject_range(spark):
    df = one(spark, "low double, high double, fine double, none double", [(-0.5, 1.0, 0.0, None), (1.0, 150.5, 150.0, None)])
    assert P.prepare(df).subjects == ("fine",)


def test_input_grade_takes_the_year_role_and_stays(spark):
    ds = P.prepare(one(spark, "Grade string, algebra double", [("X", 95.0), (None, 20.0)]))
    assert ds.year == "Grade" and values(ds, "Grade") == ["X", "Unknown"]
    assert P.prepare(one(spark, "year long, Grade string, algebra double", [(1, "X", 1.0)])).year == "year"


def test_existing_totals_stay(spark):
    ds = P.prepare(one(spark, "algebra double, Total double, Average double", [(95.0, 1.0, 55.0)]))
    assert values(ds, "Total") == [1.0] and values(ds, "Grade") == ["D"] and ds.derived == ("Grade",)


def test_no_subjects_no_derived_columns(spark):
    assert P.prepare(one(spark, "name string", [("a",)])).df.columns == ["name"]


def test_grade_edges(spark):
    averages = [90.0, 89.99, 80.0, 70.0, 60.0, 50.0, 49.99, None, float("nan")]
    df = one(spark, "a double", [(a,) for a in averages]).select(X.grade(F.col("a")))
    assert [r[0] for r in df.collect()] == ["A+", "A", "A", "B", "C", "D", "F", "F", "F"]


def test_grade_uses_the_rounded_average(spark):
    ds = P.prepare(one(spark, "a1 double, a2 double", [(90.0, 89.992), (90.0, 89.98)]))
    assert values(ds, "Average") == [90.0, 89.99] and values(ds, "Grade") == ["A+", "A"]


def test_half_even(spark):
    row = spark.range(1).select(X.round2(F.lit(0.125)), X.one_decimal(F.lit(0.25)), X.round2(F.lit(0.135))).first()
    assert tuple(row) == (0.12, "0.2", 0.14)


def test_case_clash_is_an_error(spark):
    with pytest.raises(ValueError, match="differ only in case"):
        P.prepare(one(spark, "total double, algebra double", [(1.0, 2.0)]))


def test_prepare_is_idempotent(spark, sf_dir):
    once = P.prepare(gradebook(spark, sf_dir))
    twice = P.prepare(once.df)
    assert twice.subjects == once.subjects and twice.derived == ()
    assert twice.df.exceptAll(once.df).isEmpty() and once.df.exceptAll(twice.df).isEmpty()


def test_partitioning_does_not_matter(spark, sf_dir, book):
    for n in (1, 7):
        again = P.prepare(gradebook(spark, sf_dir).orderBy(F.rand(n)).repartition(n))
        assert again.df.exceptAll(book.df).isEmpty() and again.ranges == book.ranges


def test_materialised_rows_are_the_same(book):
    assert book.materialised().df.exceptAll(book.df).isEmpty()
