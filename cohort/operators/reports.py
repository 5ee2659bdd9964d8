"""Reports over a prepared dataset. Every function returns a lazy DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohort import fixed_values as fv
from cohort.functions import exprs as X
from cohort.functions.exprs import col
from cohort.operators.prepare import Dataset

NO_DEPARTMENT, NO_ATTENDANCE, NO_SUBJECTS = fv.NO_DEPARTMENT, fv.NO_ATTENDANCE, fv.NO_SUBJECTS
NO_MARKS, NO_NAME = fv.NO_MARKS, fv.NO_NAME


def _subjects(ds: Dataset) -> tuple[str, ...]:
    if not ds.subjects:
        raise ValueError(NO_SUBJECTS)
    return ds.subjects


def _score_column(ds: Dataset) -> str:
    if "Average" in ds.df.columns:
        return "Average"
    if not ds.subjects:
        raise ValueError(NO_MARKS)
    return ds.subjects[0]


def _attendance(ds: Dataset) -> Column:
    return col(ds.attendance).cast("double") if ds.attendance else F.lit(float(fv.DEFAULT_ATTENDANCE))


def _orderable(ds: Dataset) -> list[str]:
    """All columns, for tie-breaks of full records."""
    return list(ds.df.columns)


def row_count(ds: Dataset) -> DataFrame:
    """Number of rows."""
    return ds.df.agg(F.count("*").alias("total_students"))


def department_digest(ds: Dataset) -> DataFrame:
    """One row: rows, number of departments and a digest of their labels, by partial aggregates whatever the number of labels.

    The digest is the sum over the labels of the first 32 bits of their MD5, so it does not depend on an order.
    """
    label = col(ds.need("department", NO_DEPARTMENT)).cast("string")
    labels = ds.df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    bits = F.conv(F.substring(F.md5("label"), 1, 8), 16, 10).cast("long")
    return labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_students"), F.count("label").alias("n_departments"),
                      F.coalesce(F.sum(bits), F.lit(0)).alias("departments_digest"))


def department_list_md5(ds: Dataset) -> DataFrame:
    """One row: the MD5 of all department labels in their order, joined by commas.

    Labels are sorted in ranges by many tasks, which join them to pieces. MD5 reads its text in order, so one task reads the pieces, a
    row for some thousand labels each, as a stream; the list is never held.
    """
    label = col(ds.need("department", NO_DEPARTMENT)).cast("string").alias("label")
    labels = ds.df.select(label).where("label IS NOT NULL").distinct()

    def join(batches):
        task = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            if batch.num_rows:
                joined = ",".join(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([place], pa.int64()), pa.array([joined])],
                                                 names=["task", "place", "labels"])

    def digest(batches):
        now, before = hashlib.md5(usedforsecurity=False), ""
        for batch in batches:
            for piece in batch.column(0):
                now.update(f"{before}{piece.as_py()}".encode())
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array([now.hexdigest()])], names=["md5"])

    pieces = labels.repartitionByRange("label").sortWithinPartitions("label").mapInArrow(join, "task long, place long, labels string")
    found = pieces.repartition(1).sortWithinPartitions("task", "place").select("labels").mapInArrow(digest, "md5 string")
    return found.agg(F.coalesce(F.max("md5"), F.md5(F.lit(""))).alias("departments_md5"))


def dataset_summary(ds: Dataset, list_departments: bool = True) -> DataFrame:
    """One row: sizes, column and subject names, flags and overall means.

    The department list holds every label. For tables with very many, leave it out: `departments` has them as rows,
    `department_digest` and `department_list_md5` their digests.
    """
    aggs = [
        F.count("*").alias("total_students"),
        F.lit(len(ds.df.columns)).alias("total_columns"),
        F.array(*[F.lit(c) for c in ds.df.columns]).alias("columns"),
    ]
    if not ds.department:
        aggs += [F.lit(0).cast("long").alias("n_departments"), F.array().cast("array<string>").alias("departments")]
    else:
        label = col(ds.department).cast("string")
        aggs.append(F.count_distinct(label).alias("n_departments"))
        if list_departments:
            aggs.append(F.array_sort(F.collect_set(label)).alias("departments"))
    aggs += [
        F.array(*[F.lit(c) for c in ds.subjects]).cast("array<string>").alias("subject_columns"),
        F.lit(ds.attendance is not None).alias("has_attendance"),
        F.lit(bool(ds.subjects)).alias("has_subjects"),
    ]
    if ds.subjects:
        aggs.append(X.round2(X.mean_of_means(ds.subjects)).alias("average_marks"))
    if ds.attendance:
        aggs.append(X.round2(F.avg(col(ds.attendance))).alias("average_attendance"))
    if "Average" in ds.df.columns:
        aggs.append(X.round2(F.avg("Average")).alias("class_average"))
    return ds.df.agg(*aggs)


def _in_department(ds: Dataset, department: str | None) -> tuple[DataFrame, Column]:
    dept = col(ds.need("department", NO_DEPARTMENT))
    df = ds.df.where(dept.isNotNull())
    if department:
        df = df.where(X.contains_text(dept, department))
    return df, dept.cast("string").alias("department")


def department_grades(ds: Dataset, department: str | None = None) -> DataFrame:
    """Rows per department and grade, whatever the number of labels."""
    df, dept = _in_department(ds, department)
    return df.where(F.col("Grade").isNotNull()).groupBy(dept, F.col("Grade").cast("string").alias("grade")).count()


def department_stats(ds: Dataset, department: str | None = None) -> DataFrame:
    """Per department: rows, mean of subject means, mean attendance, grade histogram.

    One shuffle of partial aggregates, and a second one for the histogram of an input Grade column, whose labels are not
    known beforehand; `department_grades` has it as rows.
    """
    df, dept = _in_department(ds, department)
    aggs = [F.count("*").alias("count")]
    if ds.subjects:
        aggs.append(X.round2(X.mean_of_means(ds.subjects)).alias("avg_marks"))
    if ds.attendance:
        aggs.append(X.round2(F.avg(col(ds.attendance))).alias("avg_attendance"))
    if "Grade" in ds.derived:
        counts = F.array(*[F.count_if(F.col("Grade") == g) for g in fv.GRADE_ORDER])
        grades = F.map_from_arrays(F.array(*[F.lit(g) for g in fv.GRADE_ORDER]), counts)
        aggs.append(F.map_filter(grades, lambda _, n: n > 0).alias("grade_dist"))
        return df.groupBy(dept).agg(*aggs)
    stats = df.groupBy(dept).agg(*aggs)
    if "Grade" in ds.df.columns:
        pairs = F.collect_list(F.struct("grade", "count"))
        maps = department_grades(ds, department).groupBy("department").agg(F.map_from_entries(pairs).alias("grade_dist"))
        stats = stats.join(maps, "department", "left")
    return stats


def department_table(ds: Dataset) -> DataFrame:
    """Departments with counts and means, largest first."""
    stats = department_stats(ds)
    shown = [c for c in ("department", "count", "avg_marks", "avg_attendance") if c in stats.columns]
    return stats.select(*shown).orderBy(F.desc("count"), "department")


def top_rows(ds: Dataset, n: int = 5) -> DataFrame:
    """The n rows with the highest score: name, score, department, attendance."""
    score = _score_column(ds)
    name = ds.name or ds.df.columns[0]
    shown = [col(name).cast("string").alias("name"), X.round2(col(score).cast("double")).alias("score")]
    used = [name, score]
    if ds.department:
        shown.append(col(ds.department).cast("string").alias("department"))
        used.append(ds.department)
    if ds.attendance:
        shown.append(X.round2(col(ds.attendance).cast("double")).alias("attendance"))
        used.append(ds.attendance)
    ranked = ds.df.where(col(score).isNotNull()).orderBy(col(score).desc(), *ds.order_keys(*used))
    return ranked.limit(n).select(*shown)


def matching_rows(ds: Dataset, name: str) -> DataFrame:
    """All rows whose name contains the text, ignoring case."""
    if not name:
        raise ValueError("No name provided.")
    return ds.df.where(X.contains_text(col(ds.need("student_name", NO_NAME)), name))


def name_search(ds: Dataset, name: str, shown: int = 3) -> DataFrame:
    """The first matching rows and, on each, the number of all matches."""
    rows = matching_rows(ds, name)
    first = rows.orderBy(*ds.order_keys(*_orderable(ds))).limit(shown)
    return first.withColumn("match_count", rows.agg(F.count("*")).scalar())


def subject_stats(ds: Dataset) -> DataFrame:
    """Per subject: mean, max, min and sample standard deviation, from one wide aggregate."""
    return _subject_table(ds, X.round2)


def _subject_table(ds: Dataset, rounding) -> DataFrame:
    cells = []
    for i, s in enumerate(_subjects(ds)):
        c = col(s).cast("double")
        cells.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(s).alias("subject"),
            rounding(F.avg(c)).alias("average"),
            rounding(F.max(c)).alias("max"),
            rounding(F.min(c)).alias("min"),
            rounding(F.stddev_samp(c)).alias("std"),
        ))
    return ds.df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def subject_metrics(ds: Dataset, subject: str) -> DataFrame:
    """Mean, max, min and standard deviation of one subject."""
    c = col(subject).cast("double")
    return ds.df.agg(
        X.round2(F.avg(c)).alias("average"), X.round2(F.max(c)).alias("max"),
        X.round2(F.min(c)).alias("min"), X.round2(F.stddev_samp(c)).alias("std"),
    )


def subject_table(ds: Dataset) -> DataFrame:
    """All subjects, highest mean first."""
    return subject_stats(ds).drop("position").orderBy(F.desc("average"), "subject")


def subject_long(ds: Dataset, *keep: Column) -> DataFrame:
    """One row per input row and subject with a score: kept columns, position, subject, score."""
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("subject"), col(s).cast("double").alias("score"))
        for i, s in enumerate(_subjects(ds))
    ]
    return ds.df.select(*keep, F.inline(F.array(*cells))).where(F.col("score").isNotNull())


def subject_top(ds: Dataset, k: int = 3) -> DataFrame:
    """The k best rows of every subject; partitions keep only k rows per subject before the shuffle."""
    name = col(ds.name).cast("string") if ds.name else F.lit(None).cast("string")
    roll = col(ds.roll) if ds.roll else F.lit(None).cast("string")
    rows = subject_long(ds, name.alias("name"), roll.alias("roll"))
    order = Window.partitionBy("subject").orderBy(F.desc("score"), "roll", "name")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("subject", "rank", "name", X.round2(F.col("score")).alias("score"))


def subject_analysis(ds: Dataset) -> DataFrame:
    """Statistics and the three best rows of every subject."""
    best = F.array_sort(F.collect_list(F.struct("rank", "name", "score")))
    top = F.transform(best, lambda b: F.struct(b["name"].alias("name"), b["score"].alias("score")))
    stats = subject_stats(ds)
    if not ds.name:
        empty = F.array().cast("array<struct<name:string,score:double>>")
        return stats.withColumn("top_3", empty)
    return stats.join(subject_top(ds).groupBy("subject").agg(top.alias("top_3")), "subject", "left")


def attendance_stats(ds: Dataset, threshold: float = fv.ATTENDANCE_THRESHOLD) -> DataFrame:
    """One row: mean, max, min, rows below the threshold, and rows per fixed band."""
    c = col(ds.need("attendance", NO_ATTENDANCE)).cast("double")
    band = X.attendance_band(c)
    return ds.df.agg(
        X.round2(F.avg(c)).alias("average_attendance"),
        X.round2(F.max(c)).alias("max_attendance"),
        X.round2(F.min(c)).alias("min_attendance"),
        F.count_if(c < threshold).alias("students_below_threshold"),
        F.lit(float(threshold)).alias("threshold_used"),
        *[F.count_if(band == text).alias(short) for short, text in fv.BAND_LABELS.items()],
    )


def attendance_bands(ds: Dataset) -> DataFrame:
    """Rows per attendance band, empty bands included."""
    wide = attendance_stats(ds)
    cells = [F.struct(F.lit(text).alias("band"), F.col(short).alias("count")) for short, text in fv.BAND_LABELS.items()]
    return wide.select(F.inline(F.array(*cells)))


def low_attendance_by_department(
    ds: Dataset, threshold: float = fv.ATTENDANCE_THRESHOLD, n: int = 5
) -> DataFrame:
    """The n departments with most rows below the threshold."""
    c = col(ds.need("attendance", NO_ATTENDANCE)).cast("double")
    dept = col(ds.need("department", NO_DEPARTMENT)).cast("string").alias("department")
    counts = ds.df.where(c < threshold).groupBy(dept).count().where(F.col("department").isNotNull())
    return counts.orderBy(F.desc("count"), "department").limit(n)


def performance_classes(ds: Dataset) -> DataFrame:
    """Every row with its rule-based performance class."""
    average = F.col("Average").cast("double") if "Average" in ds.df.columns else F.lit(0.0)
    name = col(ds.name or ds.df.columns[0]).cast("string").alias("student")
    keep = [col(ds.roll).alias("roll")] if ds.roll else []
    return ds.df.select(
        *keep, name,
        X.performance(average, _attendance(ds)).alias("predicted_performance"),
        X.round2(average).alias("average_marks"),
        F.lit("rule-based").alias("method"),
    )


def predict_performance(ds: Dataset, name: str, model=None) -> DataFrame:
    """The first row that matches a name with its class by rule, or its value by a trained model."""
    first = matching_rows(ds, name).orderBy(*ds.order_keys(*_orderable(ds))).limit(1)
    one = ds.with_df(first)
    if model is None:
        return performance_classes(one).drop("roll")
    scored = model.predict(first)
    return scored.select(
        col(ds.name).cast("string").alias("student"),
        X.round2(col(model.prediction_col)).alias("predicted_value"),
        F.lit("ML regression").alias("method"),
    )


def profiles(ds: Dataset, name: str, model=None, n: int = 5) -> DataFrame:
    """Up to n matching rows as profile cards: role columns, average, grade, full record as JSON, prediction."""
    rows = matching_rows(ds, name)
    keys = ds.order_keys(*_orderable(ds))
    first = rows.orderBy(*keys).limit(n).withColumn("match_count", rows.agg(F.count("*")).scalar())
    numeric = {f.name for f in ds.df.schema.fields if isinstance(f.dataType, T.NumericType)}
    record = F.to_json(F.struct(*[
        col(c).cast("double" if c in numeric else "string").alias(c) for c in ds.df.columns if not c.startswith("_")
    ]))
    shown = [F.col("match_count"), col(ds.name).cast("string").alias("name")]
    for role in ("department", "roll_no", "year", "attendance"):
        if ds.roles.get(role):
            shown.append(col(ds.roles[role]).alias(X.label(ds.roles[role])))
    if "Average" in ds.df.columns:
        shown.append(X.round2(F.col("Average")).alias("Average"))
    if "Grade" in ds.df.columns:
        shown.append(F.col("Grade").cast("string").alias("Grade"))
    shown.append(record.alias("record"))
    if model is None:
        return first.select(*shown)
    return model.predict(first).select(*shown, X.round2(col(model.prediction_col)).alias(model.prediction_col))


def student_names(ds: Dataset) -> DataFrame:
    """Distinct names."""
    name = col(ds.need("student_name", NO_NAME)).cast("string").alias("name")
    return ds.df.select(name).where(F.col("name").isNotNull()).distinct()


def _compared(ds: Dataset, names: Sequence[str], exact: bool) -> DataFrame:
    """The first row for every requested name, only when at least two of them are found."""
    if not 2 <= len(names) <= 5:
        raise ValueError("Select 2 to 5 students to compare.")
    _subjects(ds)
    text = col(ds.need("student_name", NO_NAME)).cast("string")

    def hit(request: Column) -> Column:
        return text == request if exact else X.contains_text(text, request)

    wanted = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("student")) for i, n in enumerate(names)])
    any_hit = hit(F.lit(names[0]))
    for n in names[1:]:
        any_hit = any_hit | hit(F.lit(n))
    shown = [*ds.subjects]
    shown += [c for c in ("Average", ds.attendance) if c and c in ds.df.columns and c not in shown]
    keys = [c for c in dict.fromkeys([ds.roll, ds.name, *shown]) if c]
    # the request columns get names that no input column can take
    rows = ds.df.where(any_hit).select(
        F.explode(F.filter(wanted, lambda r: hit(r["student"]))).alias("__request"), *[col(c) for c in keys]
    )
    order = Window.partitionBy("__request").orderBy(*[col(c) for c in keys])
    first = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") == 1)
    # at most five rows are left here
    first = first.withColumn("__found", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("__found") >= 2)
    return first.select(
        F.col("__request.position").alias("position"), F.col("__request.student").alias("student"),
        *[col(c) for c in shown],
    )


def compare(ds: Dataset, names: Sequence[str], exact: bool = False) -> DataFrame:
    """Two to five requested students side by side: subjects, average, attendance of the first match of each."""
    return _compared(ds, names, exact).orderBy("position")
