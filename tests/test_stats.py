import numpy as np
import pytest
from pyspark.sql import functions as F

from ontime.operators import quantiles, stats
from ontime.sources.shared import materialize
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def numbers(spark):
    """Values, a third of them the same, and classes."""
    x = F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 37 % 101)
    table = spark.range(3000).select(
        F.when(F.col("id") % 50 != 1, x).cast("int").alias("x"), ((F.col("id") * 13 % 97) / 7).alias("y"),
        (F.col("id") % 2).cast("int").alias("late"), (F.col("id") % 5 == 0).cast("int").alias("fog"),
    )
    return table, table.toPandas()


def test_histogram_equals_numpy(numbers):
    table, data = numbers
    rows = stats.histogram(table, "x").orderBy("bin").collect()
    counts, edges = np.histogram(data.x.dropna(), bins=30)
    assert [r.frequency for r in rows] == counts.tolist()
    assert np.allclose([r.lower for r in rows], edges[:-1]) and np.allclose([r.upper for r in rows], edges[1:])
    plan = plan_of(stats.histogram(table, "x"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_histogram_edge_cases(spark):
    one = spark.createDataFrame([(4.0,), (4.0,), (None,), (float("nan"),)], "x double")
    assert [tuple(r) for r in stats.histogram(one, "x").collect()] == [(0, 4.0, 4.0, 2)]
    assert stats.histogram(one.where("x is null"), "x").collect() == []
    gaps = spark.createDataFrame([(0,), (10,)], "x int")
    assert [r.frequency for r in stats.histogram(gaps, "x", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 1]


def test_density_has_area_one(numbers):
    rows = stats.density(numbers[0], "x").collect()
    assert sum(r.density * (r.upper - r.lower) for r in rows) == pytest.approx(1)


def test_describe_equals_pandas(numbers):
    table, data = numbers
    rows = {r.measure: r for r in stats.describe(table, ["x", "y"]).collect()}
    for name in ("x", "y"):
        want = data[name].describe()
        got = [rows[name][c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert np.allclose(got, want.to_numpy())
    grouped = {r.late: r for r in stats.describe(table, ["x"], by=["late"]).collect()}
    assert grouped[1].mean == pytest.approx(data[data.late == 1].x.mean())


def test_describe_one_row(spark):
    row = stats.describe(spark.createDataFrame([(3,)], "x int"), ["x"]).first()
    assert (row["count"], row["mean"], row["std"], row["q50"]) == (1, 3.0, None, 3.0)


def test_describe_log10(numbers):
    table, data = numbers
    logs = np.log10(data.x[data.x > 0])
    rows = {r.statistic: r for r in stats.describe_log10(table, "x").collect()}
    assert rows["mean"].log10_value == pytest.approx(logs.mean())
    assert rows["mean+2std"].minutes == pytest.approx(10 ** (logs.mean() + 2 * logs.std()))
    assert rows["75%"].minutes == pytest.approx(10 ** logs.quantile(0.75))


def boxes(values):
    q1, median, q3 = values.quantile([0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    return (len(values), q1, median, q3, inside.min(), inside.max(), len(values) - len(inside))


def test_box_stats_equal_brute_force(numbers):
    table, data = numbers
    for row in stats.box_stats(table, "late", ["x", "y"]).collect():
        assert np.allclose(tuple(row)[2:], boxes(data[data.late == row.late][row.measure].dropna()))
    for row in stats.flag_box_stats(table, ["late", "fog"], "x").collect():
        assert np.allclose(tuple(row)[2:], boxes(data[data[row.flag] == row.met].x.dropna()))


def test_outliers(spark):
    table = spark.createDataFrame([(0, v) for v in [1, 2, 3, 4, 100, 100]] + [(0, None)], "k int, v int")
    row = stats.box_stats(table, "k", ["v"]).first()
    assert row.asDict()["outliers"] == 0
    table = spark.createDataFrame([(0, v) for v in list(range(20)) + [500, -500]], "k int, v int")
    row = stats.box_stats(table, "k", ["v"]).first()
    assert (row.low_whisker, row.high_whisker, row.outliers) == (0.0, 19.0, 2)


def test_trend_lines_equal_numpy(numbers):
    table, data = numbers
    known = data.dropna()
    for row in stats.trend_lines(table, "y", ["x", "late"]).collect():
        pair = data[["y", row.feature]].dropna()
        slope, intercept = np.polyfit(pair[row.feature], pair.y, 1)
        assert (row.slope, row.intercept) == (pytest.approx(slope), pytest.approx(intercept))
        assert row.r2 == pytest.approx(np.corrcoef(pair[row.feature], pair.y)[0, 1] ** 2) and row.n == len(pair)
    corr = stats.pair_corr(table, [("x", "y")]).first()
    assert corr.corr == pytest.approx(known.x.corr(known.y)) and corr.n == len(known)


@pytest.mark.parametrize("limit", [1, 10, 700, 5000])
def test_pair_points(numbers, limit):
    table, data = numbers
    points = stats.pair_points(table.where("x is not null"), "x", "late", limit).collect()
    want = data.dropna().sort_values(["x", "late"]).head(limit)
    assert sorted(tuple(r) for r in points) == list(zip(want.x, want.late))
    assert stats.pair_points(table, "x", "late").count() == 3000


def test_values_are_counted_before_quantiles(numbers):
    plan = plan_of(stats.value_counts(numbers[0], ["x", "y"], ["late"])).split("== Initial Plan ==")[-1]
    first = [line for line in reversed(plan.splitlines()) if "Exchange hashpartitioning" in line][0]
    assert "value#" in first and "measure#" in first


def test_a_summary_reads_its_input_once(spark, numbers, tmp_path, monkeypatch):
    numbers[0].write.parquet(str(tmp_path / "numbers"))
    written = []
    monkeypatch.setattr(stats, "materialize", lambda table, name: written.append(plan_of(table)) or materialize(table, name))
    table = spark.read.parquet(str(tmp_path / "numbers"))
    for made in (stats.describe(table, ["x", "y"]), stats.box_stats(table, "late", ["x", "y"])):
        assert str(tmp_path / "numbers")[:20] not in plan_of(made)
    assert [plan.split("== Initial Plan ==")[-1].count("FileScan parquet") for plan in written] == [1, 1]


@pytest.mark.parametrize("gathered, ranges", [(1, 2), (3, 4), (40, 8), (5000, 4096)])
def test_quantiles_by_selection_equal_numpy(spark, numbers, monkeypatch, gathered, ranges):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    table, data = numbers
    long = stats.value_counts(table.withColumn("z", F.exp(F.col("y"))).withColumn("k", F.when(F.col("late") == 1, "a")), ["x", "y", "z"], ["k"])
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    data = data.assign(z=np.exp(data.y), k=np.where(data.late == 1, "a", None))
    got = {(r.k, r.measure): r.q for r in quantiles.exact_quantiles(materialize(long, "long"), ["k", "measure"], shares, gathered).collect()}
    assert len(got) == 6
    for (k, name), q in got.items():
        want = data[data.k.isna() if k is None else data.k == k][name].dropna()
        assert np.allclose(q, np.quantile(want, shares))


def test_quantiles_of_a_million_different_values(spark):
    """No task gathers more than a range of the values."""
    table = spark.range(1_000_000).select((F.sqrt("id") * 1.7).alias("value"), F.lit("m").alias("measure"), F.lit(1).cast("long").alias("n"))
    made = quantiles.exact_quantiles(materialize(table, "million"), ["measure"], [0.25, 0.5, 0.75])
    want = np.quantile(np.sqrt(np.arange(1_000_000)) * 1.7, [0.25, 0.5, 0.75])
    assert np.allclose(made.first().q, want, rtol=1e-12)
    assert "percentile" not in plan_of(made)
    assert quantiles.exact_quantiles(materialize(table.limit(0), "none"), ["measure"], [0.5]).count() == 0


@pytest.mark.parametrize("values", [[1e9, 1e9 + 1, 1e9 + 2] * 100, [0.1] * 50, [7.0]])
def test_standard_deviation_of_large_values(spark, values):
    got = stats.describe(spark.createDataFrame([(x,) for x in values], "x double"), ["x"]).first()
    want = spark.createDataFrame([(x,) for x in values], "x double").agg(F.stddev_samp("x")).first()[0]
    assert (got.std is None) == (want is None)
    assert want is None or got.std == pytest.approx(np.std(values, ddof=1), abs=1e-8)
