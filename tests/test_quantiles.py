import numpy as np
import pytest

from cohort.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(5)


@pytest.mark.parametrize("limit", [150, 500_000])
@pytest.mark.parametrize("kind", ["uniform", "one hot value", "outliers", "few"])
def test_against_numpy(spark, kind, limit):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(-5, 5, 4000),
        "one hot value": np.concatenate([np.full(1500, 2.5), rng.normal(size=2500)]),
        "outliers": np.concatenate([rng.normal(size=3000), [1e300, -1e300, np.inf]]),
        "few": rng.integers(0, 4, 1001).astype(float),
    }[kind]
    found = exact_quantiles(frame(spark, [*values, None]), ["v"], PROBS, limit=limit)["v"]
    probs = PROBS[:-1] if kind == "outliers" else PROBS
    assert found[: len(probs)] == pytest.approx([np.quantile(values, p) for p in probs], rel=1e-12, abs=1e-12)


def test_empty_and_single(spark):
    assert exact_quantiles(frame(spark, [None, None]), ["v"], [0.5]) == {"v": [None]}
    assert exact_quantiles(frame(spark, [7]), ["v"], [0.25, 0.5]) == {"v": [7.0, 7.0]}
    assert exact_quantiles(frame(spark, [1, 2]), ["v"], [0.5]) == {"v": [1.5]}


def test_a_bracket_of_one_value(spark):
    """Distinct values are said to be many but are two."""
    values = [1.0] * 30 + [5.0] * 71
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    found = exact_quantiles(df, ["x"], [0.0, 0.25, 0.3, 0.5, 1.0], limit=1, known={"x": (len(values), 10**9)})
    assert found["x"] == [float(np.quantile(values, p)) for p in (0.0, 0.25, 0.3, 0.5, 1.0)]


def test_sums_by_ranges(spark):
    from cohort.functions.quantiles import _reached_by_ranges

    rows = [(t, float(v), v % 3 + 1) for t in (0, 1) for v in range(200)]
    got = {(r["target"], r["value"]): r["reached"] for r in _reached_by_ranges(
        spark.createDataFrame(rows, "target int, value double, n long").repartition(5)).collect()}
    for t in (0, 1):
        total = 0
        for v in range(200):
            total += v % 3 + 1
            assert got[t, float(v)] == total


def test_scratch_is_removed(spark, tmp_path):
    import os

    from cohort import session

    session.written(spark.range(3), "scratch")
    path = session._made[-1]
    bare = path.removeprefix("file://")
    assert os.path.isdir(bare)
    kept, session._made[:] = session._made[:-1], [path]
    assert session.remove_scratch(spark) == 1 and not os.path.exists(bare)
    session._made[:] = kept


def _reads(spark):
    """The rows that are read from a source, as a Python stage behind it counts them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return seen, counted


@pytest.mark.parametrize("distinct", [10, 60_000])
def test_two_scans_at_any_number_of_distinct_values(spark, distinct):
    n = 60_000
    seen, counted = _reads(spark)
    df = spark.range(n).selectExpr(f"CAST(id % {distinct} AS DOUBLE) AS v", f"CAST(-(id % {distinct}) AS DOUBLE) AS w")
    read = df.repartition(4).mapInArrow(counted, df.schema)
    got = exact_quantiles(read, ["v", "w"], PROBS, limit=1000)
    values = np.arange(n) % distinct
    assert got["v"] == pytest.approx([np.quantile(values, p) for p in PROBS]) and got["w"] == pytest.approx([np.quantile(-values, p) for p in PROBS])
    assert seen.value == 2 * n


def test_a_bracket_that_misses_is_counted_again(spark, monkeypatch):
    from cohort.functions import quantiles as Q

    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS v")
    real = Q._sketch

    def wrong(df, targets, *rest):
        sizes = real(df, targets, *rest)
        for t, (low, high) in zip(targets, [(4000.0, 4100.0), (10.0, 20.0)]):
            t.low, t.high = low, high
        return sizes

    monkeypatch.setattr(Q, "_sketch", wrong)
    assert exact_quantiles(df, ["v"], [0.25, 0.5], limit=10)["v"] == [1249.75, 2499.5]
