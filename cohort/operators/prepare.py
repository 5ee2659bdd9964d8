"""Preparation of a raw table: types, imputation, column roles, derived columns.

`prepare` makes one aggregate pass that yields a single row of counts and ranges, one more for medians when numeric
values are missing, and then returns one lazy projection over the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from cohort import fixed_values as fv
from cohort.functions import exprs as X
from cohort.functions.exprs import col
from cohort.functions.quantiles import exact_quantiles
from cohort.session import written

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


@dataclass(frozen=True)
class Dataset:
    """A prepared table with the roles of its columns; `df` is lazy."""

    df: DataFrame
    roles: Mapping[str, str | None]
    subjects: tuple[str, ...]
    numeric_cols: tuple[str, ...]
    n_rows: int | None = None                                   # unknown once the rows were changed, as the next two are
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    distinct: Mapping[str, int] = field(default_factory=dict)   # approximate distinct counts of numeric columns
    derived: tuple[str, ...] = ()                               # columns that preparation added

    @property
    def name(self) -> str | None:
        return self.roles.get("student_name")

    @property
    def department(self) -> str | None:
        return self.roles.get("department")

    @property
    def attendance(self) -> str | None:
        return self.roles.get("attendance")

    @property
    def roll(self) -> str | None:
        return self.roles.get("roll_no")

    @property
    def year(self) -> str | None:
        return self.roles.get("year")

    def need(self, role: str, message: str) -> str:
        """The column of a role; an error with the given text when there is none."""
        found = self.roles.get(role)
        if not found:
            raise ValueError(message)
        return found

    def order_keys(self, *outputs: str) -> list[Column]:
        """Tie-break: roll, then name, then the columns that are shown, so equal rows are interchangeable."""
        names = [c for c in (self.roll, self.name, *outputs) if c]
        return [col(c).asc() for c in dict.fromkeys(names)]

    def materialised(self) -> "Dataset":
        """The same rows written once to the shared folder, for several queries over an input that is dear to compute."""
        return self.with_df(written(self.df, "dataset"), same_rows=True)

    def with_df(self, df: DataFrame, same_rows: bool = False) -> "Dataset":
        """The same dataset over another frame with the same columns.

        What was counted over the old rows is forgotten, unless same_rows says that they are the same, such as persisted ones.
        """
        return replace(self, df=df) if same_rows else replace(self, df=df, n_rows=None, ranges={}, distinct={})


def numeric_text(text: Column) -> Column:
    """The number a text stands for, null when it is none. A cast that fails is dearer than the pattern, so the pattern comes first."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def is_integer_text(text: Column) -> Column:
    """Whether a text is a whole number that fits a long."""
    return F.coalesce(text.rlike(WHOLE) & F.trim(text).try_cast("long").isNotNull(), F.lit(False))


def is_long_id_text(text: Column) -> Column:
    """Whether a text is a whole number beyond a long, which a double would not keep apart from its neighbours."""
    return F.coalesce(text.rlike(WHOLE) & F.trim(text).try_cast("long").isNull(), F.lit(False))


def detect_column(columns: Sequence[str], role: str) -> str | None:
    """Column for a role: the earliest alias wins, among equal names the last column."""
    by_name = {X.normalise_name(c): c for c in columns}
    names = [X.normalise_name(a) for a in fv.ROLE_ALIASES.get(role, [role])]
    return next((by_name[n] for n in names if n in by_name), None)


def plain_types(df: DataFrame) -> DataFrame:
    """Numbers as long or double with NaN as null, booleans as they are, everything else as text."""
    out = []
    for f in df.schema.fields:
        c, t = col(f.name), f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c.cast("double"))
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, T.IntegralType):
            c = c.cast("long")
        elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif not isinstance(t, (T.StringType, T.BooleanType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def _is_number(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.LongType, T.DoubleType))


def check_name_clash(df_columns: Sequence[str], case_sensitive: bool) -> None:
    """Names that differ only in case need a case-sensitive session."""
    if case_sensitive:
        return
    seen: dict[str, str] = {}
    for c in df_columns:
        other = seen.setdefault(c.lower(), c)
        if other != c:
            raise ValueError(f"columns {other!r} and {c!r} differ only in case: set spark.sql.caseSensitive=true")


def _profile(df: DataFrame) -> list[Column]:
    """The row count, and per column present values, parse counts, ranges and distinct estimates."""
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        aggs.append(F.count(c).alias(f"present_{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs += [F.count_if(is_integer_text(c)).alias(f"whole_{i}"), F.count_if(is_long_id_text(c)).alias(f"beyond_{i}")]
            c = numeric_text(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("double")
        aggs += [
            F.count(c).alias(f"numbers_{i}"), F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"),
            F.approx_count_distinct(c).alias(f"distinct_{i}"),
        ]
    return aggs


def prepare(df: DataFrame, exclude_roles: bool = False, approx_median: bool = False, write: bool = False) -> Dataset:
    """Type, impute and extend a raw table and detect the roles of its columns.

    exclude_roles drops columns with a detected role from the subjects; approx_median trades exact medians for one
    cheap sketch per column. write puts the rows into the shared folder in the pass that profiles them, and everything else reads
    them there: for inputs that are dearer to compute than to write, such as joins.
    """
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    check_name_clash([*df.columns, "Total", "Average", "Grade"], case_sensitive)
    df = plain_types(df)
    names = df.columns
    roles = {r: detect_column(names, r) for r in fv.DETECTED_ROLES}
    if write:
        seen = Observation()
        df = written(df.observe(seen, *_profile(df)), "rows")
        found = seen.get
    else:
        found = df.agg(*_profile(df)).first().asDict()
    n_rows = found["rows"]

    # types: the share of parsing rows counts missing rows against a text column
    typed, numbers, missing, ranges = [], [], [], {}
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            # whole numbers beyond a long are ids; as doubles they would run together, so they stay text
            if n_rows and found[f"numbers_{i}"] / n_rows > fv.NUMERIC_SHARE and not found[f"beyond_{i}"]:
                c = F.trim(c).try_cast("long") if found[f"whole_{i}"] == n_rows else numeric_text(c)
                numbers.append(i)
        elif isinstance(f.dataType, T.BooleanType):
            # without a gap a boolean stays; with gaps it is a number or a text, like any other mixed column
            if n_rows and fv.NUMERIC_SHARE < found[f"present_{i}"] / n_rows < 1:
                c = c.cast("double")
                numbers.append(i)
            elif found[f"present_{i}"] < n_rows:
                c = F.initcap(c.cast("string"))
        elif _is_number(f):
            c = c if found[f"present_{i}"] == n_rows else c.cast("double")
            numbers.append(i)
        if i in numbers and found[f"numbers_{i}"]:
            ranges[f.name] = (float(found[f"min_{i}"]), float(found[f"max_{i}"]))
            if found[f"numbers_{i}"] < n_rows:
                missing.append(f.name)
        typed.append(c.alias(f.name))
    df = df.select(*typed)

    # imputation
    if approx_median and missing:
        row = df.agg(*[F.percentile_approx(col(c), 0.5).alias(str(i)) for i, c in enumerate(missing)]).first()
        medians = dict(zip(missing, row))
    else:
        known = {c: (found[f"numbers_{i}"], found[f"distinct_{i}"]) for i, c in enumerate(names) if c in missing}
        medians = {c: q[0] for c, q in exact_quantiles(df, missing, [0.5], known=known).items()}
    filled = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in medians:
            c = F.coalesce(c, F.lit(medians[f.name]))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(fv.MISSING_TEXT))
        filled.append(c.alias(f.name))
    df = df.select(*filled)

    taken = {c for c in roles.values() if c} if exclude_roles else set()
    low, high = fv.SUBJECT_RANGE
    subjects = tuple(
        names[i] for i in numbers
        if names[i] in ranges and low <= ranges[names[i]][0] and ranges[names[i]][1] <= high
        and X.normalise_name(names[i]) not in fv.NOT_SUBJECTS and names[i] not in taken
    )
    numeric_cols = [names[i] for i in numbers]
    derived = tuple(c for c in ("Total", "Average", "Grade") if subjects and c not in names)
    if "Total" in derived:
        df = df.withColumn("Total", X.row_total(subjects))
    if "Average" in derived:
        df = df.withColumn("Average", X.row_average(subjects))
    if "Grade" in derived:
        df = df.withColumn("Grade", X.grade(F.col("Average").try_cast("double")))
    numeric_cols += [c for c in derived if c != "Grade"]
    # a filled-in median adds at most one value
    distinct = {names[i]: found[f"distinct_{i}"] + 1 for i in numbers if names[i] in ranges}
    return Dataset(df, roles, subjects, tuple(numeric_cols), n_rows, ranges, distinct, derived)


def column_mapping(ds: Dataset) -> DataFrame:
    """Role and detected column, in the order of the roles."""
    rows = [(i, text, ds.roles.get(r) or "Not detected") for i, (r, text) in enumerate(fv.DETECTED_ROLES.items())]
    rows.append((len(rows), "Subject Columns", ", ".join(ds.subjects) or "None"))
    return ds.df.sparkSession.createDataFrame(rows, "position int, role string, column string")


def departments(ds: Dataset) -> DataFrame:
    """Distinct department labels."""
    dept = ds.need("department", "No department column detected.")
    return ds.df.select(col(dept).cast("string").alias("department")).where(F.col("department").isNotNull()).distinct()
