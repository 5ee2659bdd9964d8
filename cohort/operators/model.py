"""Linear model of a score: training, metrics and batch prediction with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from cohort import fixed_values as fv
from cohort.functions.exprs import col
from cohort.operators.prepare import Dataset

TEST_TENTHS = 2


@dataclass(frozen=True)
class ScoreModel:
    """A fitted model with the names it was fitted on and its one-row metrics."""

    pipeline: PipelineModel
    features: tuple[str, ...]
    target: str
    metrics: DataFrame

    @property
    def prediction_col(self) -> str:
        return f"Predicted_{self.target}"

    def predict(self, df: DataFrame) -> DataFrame:
        """All columns of df and the prediction; missing features count as 0."""
        names = [f"__feature_{i}" for i in range(len(self.features))]
        wide = df.select("*", *[
            F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for c, n in zip(self.features, names)
        ])
        scored = self.pipeline.transform(wide)
        return scored.select(*[col(c) for c in df.columns], F.col("__prediction").alias(self.prediction_col))


def choose_columns(ds: Dataset, target: str | None = None) -> tuple[str, list[str]] | None:
    """Target and features: subjects other than the target, and attendance; None when there is nothing to learn."""
    if not ds.subjects:
        return None
    if target is None:
        if "Average" in ds.df.columns:
            target = "Average"
        elif len(ds.subjects) >= 2:
            target = ds.subjects[-1]
        else:
            return None
    features = [c for c in dict.fromkeys([*ds.subjects, ds.attendance]) if c and c != target]
    return (target, features) if features else None


def _is_test(ds: Dataset, columns: Sequence[str]) -> Column:
    # a hash of the key keeps the split the same under any partitioning
    keys = [c for c in (ds.roll, ds.name) if c] or list(columns)
    place = F.md5(F.concat_ws("|", *[col(c).cast("string") for c in keys], F.lit(str(fv.SAMPLE_SEED))))
    return place < F.lit(f"{TEST_TENTHS * 2**32 // 10:08x}")


def train(
    ds: Dataset, target: str | None = None, features: Sequence[str] | None = None, test_rows: Column | None = None
) -> ScoreModel | None:
    """Fit a linear regression on about 80 % of the rows and measure it on the rest.

    test_rows marks the rows to test on; by default a hash of roll and name picks two tenths. None comes back when the
    table has no usable columns or fewer than 20 complete rows. With the default target the features nearly determine
    it, since the average is made of the subjects.
    """
    chosen = choose_columns(ds, target)
    if chosen is None and features is None:
        return None
    target, default_features = chosen if chosen else (target, [])
    features = list(features or default_features)
    names = [f"__feature_{i}" for i in range(len(features))]
    test_rows = _is_test(ds, [*features, target]) if test_rows is None else test_rows
    rows = ds.df.select(
        *[col(c).cast("double").alias(n) for c, n in zip(features, names)],
        col(target).cast("double").alias("__label"), F.coalesce(test_rows, F.lit(False)).alias("__test"),
    ).dropna()
    # counting, scaling, fitting and measuring read the same few columns
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if rows.count() < fv.MIN_TRAIN_ROWS:
            return None
        pipeline = Pipeline(stages=[
            VectorAssembler(inputCols=names, outputCol="__raw"),
            StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
            # the normal equations need one pass and a matrix of the size of the features
            LinearRegression(featuresCol="__scaled", labelCol="__label", predictionCol="__prediction", solver="normal"),
        ]).fit(rows.where(~F.col("__test")))
        measured = _metrics(pipeline.transform(rows))
        metrics = ds.df.sparkSession.createDataFrame(measured.collect(), measured.schema)
    finally:
        rows.unpersist()
    return ScoreModel(pipeline, tuple(features), target, metrics)


def _metrics(scored: DataFrame) -> DataFrame:
    """One row: R2 and mean absolute error on the test rows, and both sample counts, from one aggregate."""
    label = F.when(F.col("__test"), F.col("__label"))
    error = label - F.col("__prediction")
    spread = F.var_pop(label) * F.count(label)
    return scored.agg(
        F.bround(1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0)), 4).alias("r2"),
        F.bround(F.avg(F.abs(error)), 4).alias("mae"),
        F.count_if(~F.col("__test")).alias("train_samples"),
        F.count_if("__test").alias("test_samples"),
    )
