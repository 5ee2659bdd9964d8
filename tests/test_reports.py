import hashlib

import pytest

from cohort.operators import charts as C
from cohort.operators import model as M
from cohort.operators import reports as R
from cohort.operators.prepare import column_mapping, prepare

SCHEMA = "name string, roll long, dept string, attendance double, maths double, art double, music double"
ROWS = [
    ("Joanna", 3, "CS", 90.0, 80.0, 80.0, 80.0),
    ("Ann", 1, "CS", 75.0, 80.0, 80.0, 80.0),
    ("Bob.", 2, "EE", 74.9, 60.0, 70.0, 65.0),
    ("Cy", 5, "EE", 89.9, 95.0, 95.0, 95.0),
    ("Di", 4, "ME", 70.0, 65.0, 65.0, 65.0),
]


@pytest.fixture(scope="module")
def ds(spark):
    return prepare(spark.createDataFrame(ROWS, SCHEMA))


def column(df, name):
    return [r[name] for r in df.collect()]


def test_ties_go_to_the_lower_roll(ds):
    assert column(R.top_rows(ds, 3), "name") == ["Cy", "Ann", "Joanna"]
    assert column(C.subject_top_n(ds, "maths", 3), "name") == ["Cy", "Ann", "Joanna"]
    top = {(r["subject"], r["rank"]): r["name"] for r in R.subject_top(ds).collect()}
    assert top["art", 2] == "Ann" and top["art", 3] == "Joanna" and len(top) == 9


def test_band_edges_and_threshold(ds):
    row = R.attendance_stats(ds, 90).first()
    assert (row["excellent"], row["good"], row["low"], row["students_below_threshold"]) == (1, 2, 2, 4)


def test_search_is_literal_and_partial(ds):
    assert sorted(column(R.matching_rows(ds, "ANN"), "name")) == ["Ann", "Joanna"]
    assert column(R.matching_rows(ds, "."), "name") == ["Bob."]
    found = R.name_search(ds, "n", shown=1)
    assert (found.first()["name"], found.first()["match_count"], found.count()) == ("Ann", 2, 1)
    assert R.name_search(ds, "nobody").count() == 0
    with pytest.raises(ValueError):
        R.name_search(ds, "")


def test_compare(ds):
    rows = R.compare(ds, ["oanna", "Bob.", "nobody"]).collect()
    assert [(r["position"], r["student"], r["maths"]) for r in rows] == [(0, "oanna", 80.0), (1, "Bob.", 60.0)]
    assert R.compare(ds, ["Ann", "nobody"]).count() == 0
    assert R.compare(ds, ["ann", "Bob."], exact=True).count() == 0
    assert R.compare(ds, ["Ann", "Bob."], exact=True).count() == 2
    for names in (["Ann"], ["a"] * 6):
        with pytest.raises(ValueError):
            R.compare(ds, names)
    assert C.comparison_radar(ds, ["Ann", "Cy"]).count() == 6


def test_department_filter(ds):
    rows = {r["department"]: r for r in R.department_stats(ds, "e").collect()}
    assert set(rows) == {"EE", "ME"} and rows["EE"]["grade_dist"] == {"A+": 1, "C": 1}
    assert R.department_stats(ds, "zz").count() == 0


def test_input_grade_labels(spark):
    ds = prepare(spark.createDataFrame([("a", "CS", "pass", 50.0), ("b", "CS", "fail", 10.0), ("c", "EE", "pass", 70.0)],
                                       "name string, dept string, Grade string, maths double"))
    rows = {r["department"]: r["grade_dist"] for r in R.department_stats(ds).collect()}
    assert rows == {"CS": {"pass": 1, "fail": 1}, "EE": {"pass": 1}}
    assert C.grade_counts(ds).count() == 0


def test_performance_rules(ds):
    rows = {r["student"]: r["predicted_performance"] for r in R.performance_classes(ds).collect()}
    assert rows == {"Joanna": "Excellent", "Ann": "Good", "Bob.": "Good", "Cy": "Excellent", "Di": "Good"}


def test_performance_without_attendance(spark):
    ds = prepare(spark.createDataFrame([("a", 85.0), ("b", 40.0)], "name string, maths double"))
    rows = {r["student"]: r["predicted_performance"] for r in R.performance_classes(ds).collect()}
    assert rows == {"a": "Good", "b": "At Risk"}


def test_missing_roles_are_errors(spark):
    ds = prepare(spark.createDataFrame([("x",)], "colour string"))
    for call in (R.department_stats, R.subject_stats, R.attendance_stats, R.student_names, R.top_rows, C.grade_counts):
        with pytest.raises(ValueError):
            call(ds)
    assert R.dataset_summary(ds).first()["n_departments"] == 0
    assert column(column_mapping(ds), "column") == ["Not detected"] * 5 + ["None"]


def test_top_rows_without_roles_use_the_first_column(spark):
    ds = prepare(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "colour string, size double"))
    assert column(R.top_rows(ds, 1), "name") == ["y"]


def test_sums(book):
    n = book.n_rows
    assert sum(column(R.attendance_bands(book), "count")) == n
    assert sum(column(C.grade_counts(book), "count")) == n
    assert sum(column(C.attendance_histogram(book), "count")) == n
    assert sum(column(C.department_share(book), "count")) == n


def test_constant_attendance_fills_one_bin(spark):
    ds = prepare(spark.createDataFrame([("a", 75.0), ("b", 75.0)], "name string, attendance double"))
    assert column(C.attendance_histogram(ds).orderBy("bin"), "count") == [2] + [0] * 19


def test_order_and_partitions_do_not_matter(book):
    def results(ds):
        frames = [R.top_rows(ds, 7), R.name_search(ds, "order#00000"), R.subject_analysis(ds), R.department_stats(ds),
                  R.compare(ds, ["order#0000001", "9"]), C.subject_top_n(ds, "algebra")]
        return [sorted(map(str, f.collect())) for f in frames]

    expected = results(book)
    for n in (1, 13):
        assert results(book.with_df(book.df.orderBy("algebra").repartition(n))) == expected


# Model ---------------------------------------------------------------------------------------------------------------

def test_model_columns(ds, spark):
    assert M.choose_columns(ds) == ("Average", ["maths", "art", "music", "attendance"])
    assert M.choose_columns(ds, "art") == ("art", ["maths", "music", "attendance"])
    twice = prepare(spark.createDataFrame([(50.0, 60.0)], "attendance_pct double, maths double"))
    assert M.choose_columns(twice) == ("Average", ["attendance_pct", "maths"])


def test_too_few_rows(ds):
    assert M.train(ds) is None


def test_default_target_is_nearly_determined(book):
    model = M.train(book)
    row = model.metrics.first()
    assert row["r2"] > 0.999 and row["train_samples"] + row["test_samples"] == book.n_rows
    assert 0.15 < row["test_samples"] / book.n_rows < 0.25
    again = M.train(book.with_df(book.df.repartition(9))).metrics.first()
    assert again["test_samples"] == row["test_samples"] and again["r2"] == row["r2"]


def test_missing_features_count_as_zero(spark, book):
    model = M.train(book, "rhetoric")
    rows = spark.createDataFrame([(None, 10.0, 5.0), (0.0, 10.0, 5.0)], "algebra double, networks double, attendance double")
    a, b = column(model.predict(rows), "Predicted_rhetoric")
    assert a == b
    assert R.predict_performance(book, "order#000000346", model).first()["method"] == "ML regression"


def test_wide_summary_digests_the_whole_list_in_order(spark, sf_dir):
    """The list of all labels in order, which a sum over the labels does not see."""
    from cohort.plans.oracles import ORACLE_SQL
    from cohort.plans.queries import QUERIES

    rows = [(i, f"n{i}", label, float(i % 90)) for i, label in enumerate([f"D{i * 7919 % 25_000}" for i in range(25_000)] + ["é", "Z,", "D1", "D1"])]
    ds = prepare(spark.createDataFrame(rows, "roll long, name string, department string, maths double").repartition(5))
    listed = ",".join(sorted({r[2] for r in rows}, key=str.encode))
    assert [tuple(r) for r in R.department_list_md5(ds).collect()] == [(hashlib.md5(listed.encode()).hexdigest(),)]
    assert QUERIES["wide_summary"](spark, sf_dir).columns == ["total_students", "n_departments", "departments_md5"]
    assert "string_agg('D' || roll, ',' ORDER BY" in ORACLE_SQL["wide_summary"]
