"""Exact quantiles of any number of columns in at most two scans, without gathering a column in one task.

Every (column, probability) pair is one target. A first scan makes one mergeable sketch for each column with many distinct values,
whose ranks are off by one part in ACCURACY at most (percentile_approx); two of its values, a little below and above the wanted rank,
enclose the order statistics of a target. The second scan counts, for all targets at once, the rows below the bracket and each
value inside it, pre-aggregated before the shuffle. Running counts give the exact answer. Should a bracket not hold its
rank, which the counts tell, that target is counted once more without one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.functions.exprs import col
from cohort.session import written

ACCURACY = 20_000           # of the sketches: ranks are right to one part in so many
MARGIN = 3 / ACCURACY       # between a target's probability and those of its bracket
DISTINCT_LIMIT = 500_000    # distinct values of a column that are counted without a bracket


@dataclass
class _Target:
    column: str
    prob: float
    rank: float = 0.0       # position among the sorted present values, counted from 0, may be fractional
    low: float = -math.inf
    high: float = math.inf


def _number(column: str) -> Column:
    c = col(column).cast("double")
    return F.when(~F.isnan(c), c)


def _sketch(df: DataFrame, targets: list[_Target], known: Mapping[str, tuple[int, int]] | None, limit: int) -> dict[str, tuple[int, int]]:
    """Present and distinct values of each column, from one scan that also sets the brackets of targets in columns with many."""
    columns = list(dict.fromkeys(t.column for t in targets if known is None or known[t.column][1] > limit))
    if not columns:
        return dict(known or {})
    exprs, shares = [], {}
    for i, c in enumerate(columns):
        shares[c] = sorted({p for t in targets if t.column == c for p in (t.prob - MARGIN, t.prob + MARGIN) if 0 < p < 1})
        exprs += [F.count(_number(c)).alias(f"n_{i}"), F.approx_count_distinct(_number(c), 0.02).alias(f"distinct_{i}")]
        if shares[c]:
            exprs.append(F.percentile_approx(_number(c), shares[c], ACCURACY).alias(f"values_{i}"))
    row = df.agg(*exprs).first()
    sizes = dict(known or {})
    for i, c in enumerate(columns):
        if known is None:
            sizes[c] = row[f"n_{i}"], row[f"distinct_{i}"]
        at = dict(zip(shares[c], row[f"values_{i}"] or [])) if shares[c] else {}
        for t in targets:
            if t.column == c and sizes[c][1] > limit:
                t.low, t.high = at.get(t.prob - MARGIN, -math.inf), at.get(t.prob + MARGIN, math.inf)
    return sizes


def _counted(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """(target, value, n): how often each value of a bracket occurs; a null value has the rows below the bracket."""
    cells = []
    for i, t in enumerate(targets):
        c = _number(t.column)
        cells.append(F.struct(F.lit(i).alias("target"), F.when(c >= t.low, c).alias("value"), (c <= t.high).alias("counts")))
    return df.select(F.inline(F.array(*cells))).where("counts").groupBy("target", "value").agg(F.count("*").alias("n"))


def _reached_by_ranges(table: DataFrame) -> DataFrame:
    """How many values lie up to each one, for a column whose distinct values could not be narrowed: summed in ranges of them."""
    ranges = written(table.repartitionByRange("target", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("target", "part").agg(F.sum("n").alias("held"))     # one row per range
    before = sums.select("target", "part", (F.sum("held").over(Window.partitionBy("target").orderBy("part")) - F.col("held")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("target", "part").orderBy("value"))
    return ranges.join(before, ["target", "part"]).withColumn("reached", F.col("before") + inside)


def _finish(df: DataFrame, targets: list[_Target], many: bool) -> list[float | None]:
    """The answer of each target; None where its bracket does not hold its rank."""
    table = _counted(df, targets)
    pick = _reached_by_ranges(table) if many else table.withColumn(
        "reached", F.sum("n").over(Window.partitionBy("target").orderBy("value")))
    first = F.lit(None).cast("double")
    second = F.lit(None).cast("double")
    for i, t in enumerate(targets):
        here = F.col("target") == i
        first = F.when(here & (F.col("reached") > math.floor(t.rank)), F.col("value")).otherwise(first)
        second = F.when(here & (F.col("reached") > math.ceil(t.rank)), F.col("value")).otherwise(second)
    below = F.max(F.when(F.col("value").isNull(), F.col("n")))
    rows = pick.groupBy("target").agg(F.min(first).alias("a"), F.min(second).alias("b"), F.coalesce(below, F.lit(0)).alias("below")).collect()
    result: list[float | None] = [None] * len(targets)
    for row in rows:
        t, a, b = targets[row["target"]], row["a"], row["b"]
        if a is not None and b is not None and row["below"] <= math.floor(t.rank):
            part = t.rank % 1
            result[row["target"]] = a if part == 0 or a == b else a + (b - a) * part
    return result


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], limit: int = DISTINCT_LIMIT,
    known: Mapping[str, tuple[int, int]] | None = None,
) -> Mapping[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns; None for a column without values.

    known gives the number of present values and the approximate number of distinct values per column; it saves the first scan
    where all columns have few.
    """
    targets = [_Target(c, p) for c in columns for p in probs]
    if not targets:
        return {}
    sizes = _sketch(df, targets, known, limit)
    for t in targets:
        t.rank = t.prob * (sizes[t.column][0] - 1)
    todo = [t for t in targets if sizes[t.column][0]]
    # values of a bracket: twice the margin of the rows, and the error of the sketch on either side
    many = any(sizes[t.column][1] > limit and sizes[t.column][0] * 4 * MARGIN > limit for t in todo)
    done = dict(zip(map(id, todo), _finish(df, todo, many))) if todo else {}
    again = [t for t in todo if done[id(t)] is None]
    for t in again:
        t.low, t.high = -math.inf, math.inf
    if again:
        done |= dict(zip(map(id, again), _finish(df, again, True)))
    return {c: [done.get(id(t)) for t in targets if t.column == c] for c in columns}
