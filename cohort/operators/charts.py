"""The data behind the charts, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohort import fixed_values as fv
from cohort.functions import exprs as X
from cohort.functions.exprs import col
from cohort.functions.quantiles import exact_quantiles
from cohort.operators import reports as R
from cohort.operators.prepare import Dataset


def subject_means(ds: Dataset) -> DataFrame:
    """Mean score per subject."""
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("subject"), F.avg(col(s)).alias("average_marks"))
        for i, s in enumerate(R._subjects(ds))
    ]
    return ds.df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def department_share(ds: Dataset) -> DataFrame:
    """Rows and percent share per department."""
    dept = col(ds.need("department", R.NO_DEPARTMENT)).cast("string").alias("department")
    counts = ds.df.select(dept).where(F.col("department").isNotNull()).groupBy("department").count()
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percent", X.round2(F.col("count") * 100.0 / total)).orderBy(F.desc("count"), "department")


def attendance_histogram(ds: Dataset, bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Rows in equal-width bins over the range of attendance, with the position of the threshold marker."""
    name = ds.need("attendance", R.NO_ATTENDANCE)
    c = col(name).cast("double")
    low, high = ds.ranges.get(name) or ds.df.agg(F.coalesce(F.min(c), F.lit(0.0)), F.coalesce(F.max(c), F.lit(0.0))).first()
    width = (high - low) / bins
    bucket = F.least(F.width_bucket(c, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) if high > low else F.lit(1)
    counts = ds.df.where(c.isNotNull()).groupBy(bucket.cast("int").alias("bin")).count()
    all_bins = ds.df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    marker = F.lit(fv.ATTENDANCE_THRESHOLD)
    start, end = F.lit(low) + (F.col("bin") - 1) * F.lit(width), F.lit(low) + F.col("bin") * F.lit(width)
    return all_bins.join(counts, "bin", "left").select(
        "bin", start.alias("low"), end.alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        ((marker >= start) & (marker < end)).alias("holds_marker"),
    )


def department_marks(ds: Dataset) -> DataFrame:
    """Mean of subject means per department, highest first."""
    dept = col(ds.need("department", R.NO_DEPARTMENT)).cast("string").alias("department")
    means = ds.df.groupBy(dept).agg(X.mean_of_means(R._subjects(ds)).alias("average_marks"))
    return means.where(F.col("department").isNotNull()).orderBy(F.desc("average_marks"), "department")


def grade_counts(ds: Dataset) -> DataFrame:
    """Rows per known grade, best grade first; absent grades are left out."""
    if "Grade" not in ds.df.columns:
        raise ValueError(fv.NO_GRADE)
    order = F.array(*[F.lit(g) for g in fv.GRADE_ORDER])
    grade = F.col("Grade").cast("string").alias("grade")
    counts = ds.df.select(grade).where(F.col("grade").isin(fv.GRADE_ORDER)).groupBy("grade").count()
    return counts.withColumn("position", F.array_position(order, F.col("grade")).cast("int")).orderBy("position")


def student_scores(ds: Dataset, name: str, n: int = 5) -> DataFrame:
    """Subject scores of the first n matching rows."""
    first = R.matching_rows(ds, name).orderBy(*ds.order_keys(*ds.df.columns)).limit(n)
    keep = [col(ds.name).cast("string").alias("name")]
    if ds.roll:
        keep.append(col(ds.roll).alias("roll"))
    return R.subject_long(ds.with_df(first), *keep)


def comparison_scores(ds: Dataset, names: Sequence[str], exact: bool = False) -> DataFrame:
    """Students x subjects for grouped bars; a missing score counts as 0."""
    rows = R._compared(ds, names, exact)
    cells = [
        F.struct(
            F.lit(i).alias("subject_position"), F.lit(s).alias("subject"),
            F.coalesce(col(s).cast("double"), F.lit(0.0)).alias("score"),
        )
        for i, s in enumerate(ds.subjects)
    ]
    return rows.select("position", "student", F.inline(F.array(*cells)))


def comparison_radar(ds: Dataset, names: Sequence[str], exact: bool = False) -> DataFrame:
    """The same table for a radar, which needs at least three subjects."""
    if len(ds.subjects) < 3:
        raise ValueError("A radar needs at least 3 subjects.")
    return comparison_scores(ds, names, exact)


def subject_top_n(ds: Dataset, subject: str, n: int = 10) -> DataFrame:
    """The n best rows in one subject; rows without name or score are left out."""
    name = ds.need("student_name", R.NO_NAME)
    if subject not in ds.df.columns:
        raise ValueError(fv.NO_NAME_OR_SUBJECT)
    rows = ds.df.where(col(name).isNotNull() & col(subject).isNotNull())
    best = rows.orderBy(col(subject).desc(), *ds.order_keys(name, subject)).limit(n)
    return best.select(col(name).cast("string").alias("name"), col(subject).alias("score"))


def score_quartiles(ds: Dataset) -> DataFrame:
    """Box plot per subject: min, quartiles, max, and whisker ends at 1.5 interquartile ranges."""
    subjects = R._subjects(ds)
    # preparation has filled every subject and counted its values, unless the rows were changed since
    known = {s: (ds.n_rows, ds.distinct[s]) for s in subjects} if ds.n_rows is not None else None
    quartiles = exact_quantiles(ds.df, subjects, [0.25, 0.5, 0.75], known=known)
    cells = []
    for i, s in enumerate(subjects):
        c = col(s).cast("double")
        q1, q2, q3 = quartiles[s]
        reach = 1.5 * (q3 - q1)
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(s).alias("subject"), F.min(c).alias("min"),
            F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"), F.max(c).alias("max"),
            F.min(F.when(c >= q1 - reach, c)).alias("whisker_low"),
            F.max(F.when(c <= q3 + reach, c)).alias("whisker_high"),
        ))
    return ds.df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
