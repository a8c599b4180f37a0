"""Distribution statistics: histogram, quartiles, box plots, trends, pairs.

Quantiles are exact. They are taken from a table of values and their counts,
built with a map-side combine and spread over all tasks by value. It is written once, and
all figures of a summary come out of it, so the input is read once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontime.functions.columns import log10_minutes, minutes_from_log10
from ontime.operators.quantiles import exact_quantiles
from ontime.sources.shared import materialize


def histogram(table: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value.

    The last bin includes its upper edge, empty bins are kept, NULL and NaN are
    skipped, and a single distinct value gives a single bin.
    """
    known = table.select(F.col(column).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    low = known.agg(F.min("x")).scalar()
    high = known.agg(F.max("x")).scalar()
    width = (high - low) / bins
    place = F.least(F.floor((F.col("x") - low) / width).cast("int"), F.lit(bins - 1))
    counts = known.groupBy(F.when(high > low, place).otherwise(0).alias("bin")).agg(
        F.count("*").alias("frequency")
    )
    grid = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = grid.where((high > low) | ((high == low) & (F.col("bin") == 0)))
    last = F.col("bin") == bins - 1
    return grid.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("lower"),
        F.when(last, high).otherwise(low + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
    )


def density(table: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histogram scaled so that its area is 1."""
    counted = histogram(table, column, bins)
    total = table.agg(F.count(F.nanvl(F.col(column).cast("double"), F.lit(None)))).scalar()
    area = total * (F.col("upper") - F.col("lower"))
    return counted.withColumn("density", F.try_divide(F.col("frequency"), area))


def _long(table: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row per known value: measure, value."""
    measures = table.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return measures.unpivot(by, columns, "measure", "value").where(F.col("value").isNotNull())


def value_counts(table: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """How often each value of each column occurs: measure, value, n."""
    by = by or []
    return _long(table, columns, by).groupBy(*by, "measure", "value").agg(F.count("*").alias("n"))


QUARTILES = [0.25, 0.5, 0.75]


def describe(table: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of each column.

    The mean comes first and deviations from it second, both from the counted values, so large values of
    small spread keep their digits.
    """
    keys = [*(by or []), "measure"]
    counts = materialize(value_counts(table, columns, by), "values")
    n, value = F.col("n"), F.col("value")
    rough = counts.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        (F.sum(n * value) / F.sum("n")).alias("rough"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    off = value - F.col("rough")
    moments = _with(counts, rough, keys).groupBy(*keys, "count", "rough", "min", "max").agg(
        F.sum(n * off).alias("off"), F.sum(n * off * off).alias("squares")
    )
    squares = F.greatest(F.col("squares") - F.pow(F.col("off"), F.lit(2.0)) / F.col("count"), F.lit(0.0))
    return _with(moments, exact_quantiles(counts, keys, QUARTILES), keys).select(
        *keys,
        "count",
        (F.col("rough") + F.col("off") / F.col("count")).alias("mean"),
        F.sqrt(F.try_divide(squares, F.col("count") - 1)).alias("std"),
        "min",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
        "max",
    )


def _with(table: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the figures of each row's keys, of which there are few."""
    named = figures.withColumnsRenamed({key: f"of_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"of_{key}")) for key in keys]
    return table.join(F.broadcast(named), same).drop(*[f"of_{key}" for key in keys])


def describe_log10(table: DataFrame, column: str) -> DataFrame:
    """Summary of log10 of the positive values, and the same in minutes.

    Also gives the bands of one, two and three standard deviations.
    """
    logs = table.select(log10_minutes(F.col(column)).alias("log"))
    summary = describe(logs, ["log"])
    mean, std = F.col("mean"), F.col("std")
    figures = {
        "mean": mean,
        "std": std,
        "min": F.col("min"),
        "25%": F.col("q25"),
        "50%": F.col("q50"),
        "75%": F.col("q75"),
        "max": F.col("max"),
    }
    for k in (1, 2, 3):
        figures[f"mean-{k}std"] = mean - k * std
        figures[f"mean+{k}std"] = mean + k * std
    rows = [
        F.struct(F.lit(name).alias("statistic"), figure.alias("log10_value"))
        for name, figure in figures.items()
    ]
    return summary.select("count", F.inline(F.array(*rows))).withColumn(
        "minutes", minutes_from_log10(F.col("log10_value"))
    )


def _boxes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Box-plot figures per key from a table of values and their counts."""
    counts = materialize(counts, "values")
    boxes = exact_quantiles(counts, keys, QUARTILES).select(
        *keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return _with(counts, boxes, keys).groupBy(*keys).agg(
        F.sum("n").alias("count"),
        *[F.first(name).alias(name) for name in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def box_stats(table: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Box-plot figures of each column for each class of ``by``.

    Whiskers reach to the last values within 1.5 interquartile ranges of the
    box; what lies beyond is counted as outliers.
    """
    return _boxes(value_counts(table, columns, [by]), [by, "measure"])


def flag_box_stats(table: DataFrame, flags: list[str], column: str) -> DataFrame:
    """Box-plot figures of one column, with and without each flag.

    Values are counted per combination of flags first; only these counts are
    repeated for each flag.
    """
    counts = value_counts(table, [column], flags)
    long = counts.unpivot(["value", "n"], flags, "flag", "met")
    merged = long.groupBy("flag", "met", "value").agg(F.sum("n").alias("n"))
    return _boxes(merged, ["flag", "met"])


def trend_lines(table: DataFrame, y: str, features: list[str]) -> DataFrame:
    """Least-squares line of ``y`` over each feature, all in one pass."""
    target = F.col(y).cast("double")
    lines = []
    for name in features:
        x = F.col(name).cast("double")
        lines.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.regr_slope(target, x).alias("slope"),
                F.regr_intercept(target, x).alias("intercept"),
                F.regr_r2(target, x).alias("r2"),
                F.regr_count(target, x).alias("n"),
            ).alias(name)
        )
    return table.agg(*lines).select(F.inline(F.array(*[F.col(name) for name in features])))


def pair_points(table: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Points for a scatter plot; with a limit, the first ones in order.

    Equal points are counted before the order is taken, so that few rows meet in
    the task that takes it, and are repeated afterwards up to the limit.
    """
    points = table.select(x, y)
    if limit is None:
        return points
    counted = points.groupBy(x, y).agg(F.count("*").alias("n")).orderBy(x, y).limit(limit)
    earlier = Window.orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(limit) - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return (
        counted.select(x, y, F.least("n", room).alias("n"))
        .where(F.col("n") > 0)
        .select(x, y, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        .drop("copy")
    )


def pair_corr(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair of columns, all in one pass."""
    rows = []
    for x, y in pairs:
        known = F.col(x).isNotNull() & F.col(y).isNotNull()
        rows.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("corr"),
                F.count_if(known).alias("n"),
            )
        )
    names = [f"pair{i}" for i in range(len(rows))]
    return table.agg(*[row.alias(name) for row, name in zip(rows, names)]).select(
        F.inline(F.array(*names))
    )
