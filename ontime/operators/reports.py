"""Filters and grouped reports over the enriched flight tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions.columns import all_of, delay_bucket, flag, measure_if, pct

# The measures a condition report looks at, and their missing codes.
CONDITION_MEASURES = {
    "MaxWindSpeed": schemas.MISSING["WindSpeed"],
    "MinCeilingHeight": schemas.MISSING["CeilingHeight"],
    "MinVisibility": schemas.MISSING["Visibility"],
    "MaxPressure": schemas.MISSING["Pressure"],
    "MaxPrecipitation48": schemas.MISSING["Precipitation48"],
}

HAZARDS = ["Fog", "Snow", "Hail", "Thunder", "Tornado"]


def delayed(flights: DataFrame) -> DataFrame:
    """Flights delayed by weather; an unknown delay does not count."""
    return flights.where(F.col("WeatherDelay") > 0)


def on_time(flights: DataFrame) -> DataFrame:
    """Flights known not to be delayed by weather."""
    return flights.where(F.col("WeatherDelay") == 0)


def drop_null(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which all the given columns are known."""
    return table.dropna(subset=columns)


def valid_weather(flights: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """Rows in which every given measure is below its missing code."""
    bounds = CONDITION_MEASURES if bounds is None else bounds
    return flights.where(all_of([F.col(name) < top for name, top in bounds.items()]))


def season(flights: DataFrame, name: str, months: list[int] | None = None) -> DataFrame:
    """Flights of the season's months, or of the caller's; prunes partitions of a saved table."""
    return flights.where(F.col("Month").isin(*(months or schemas.SEASON_MONTHS[name])))


def only_hazard(hazard: str, role: str = "Origin") -> Column:
    """Whether the hazard was the only one reported."""
    others = [h for h in ("Fog", "Rain", "Snow", "Hail", "Thunder") if h != hazard]
    return all_of([F.col(role + hazard) == 1] + [F.col(role + other) == 0 for other in others])


def hazard_only(flights: DataFrame, hazard: str, role: str = "Origin") -> DataFrame:
    """Flights for which the hazard was the only one reported."""
    return flights.where(only_hazard(hazard, role))


def hazard_delay(hazard: str, role: str = "Origin", only: bool = True, delay: str = "WeatherDelay") -> Column:
    """The delay of flights that met the hazard, or with ``only`` no other one; 0 for the rest."""
    met = only_hazard(hazard, role) if only else F.col(role + hazard) == 1
    return measure_if(met, F.col(delay))


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("rows"))


def coverage(table: DataFrame, *keys: str) -> DataFrame:
    """Row count by the given columns, largest first."""
    counts = table.groupBy(*keys).agg(F.count("*").alias("rows"))
    return top_groups(counts, "rows", *keys)


def top_groups(groups: DataFrame, by: str, *ties: str) -> DataFrame:
    """Groups ordered by a count, largest first; ``ties`` settle equal counts."""
    return groups.orderBy(F.desc(by), *ties)


def delay_by_year(flights: DataFrame) -> DataFrame:
    """Flights with, without and with unknown weather delay, by year."""
    delay = F.col("WeatherDelay")
    return (
        flights.groupBy("Year")
        .agg(
            F.sum(flag(delay > 0)).alias("delayed"),
            F.sum(flag(delay == 0)).alias("on_time"),
            F.count("*").alias("total"),
        )
        .orderBy("Year")
    )


def delay_totals(flights: DataFrame) -> DataFrame:
    """Flights without and with weather delay, NULL where there is none."""
    delay = F.col("WeatherDelay")
    return flights.agg(
        F.sum(flag(delay == 0, else_null=True)).alias("on_time"),
        F.sum(flag(delay > 0, else_null=True)).alias("delayed"),
    )


def bucket_counts(flights: DataFrame, buckets=None, on_time: str | None = None) -> DataFrame:
    """Flights by delay bucket; flights without a bucket form a NULL group."""
    return (
        flights.groupBy(delay_bucket(F.col("WeatherDelay"), buckets, on_time).alias("bucket"))
        .agg(F.count("*").alias("flights"))
        .orderBy("bucket")
    )


def _departed_late():
    return (F.col("DepDelay") > 0) & (F.col("Cancelled") == 0)


def _monthly(flights: DataFrame, *percentages) -> DataFrame:
    weather_late = (F.col("WeatherDelay") > 0) & (F.col("Cancelled") == 0)
    return flights.groupBy("Year", "Month").agg(
        F.count("*").alias("flights"),
        F.sum(flag(_departed_late())).alias("delayed"),
        F.sum(flag(weather_late)).alias("weather_delayed"),
        *percentages,
    )


def hazard_share(flights: DataFrame, role: str = "Origin") -> DataFrame:
    """By month: of the delayed flights, the percentage that met each hazard."""
    late = F.sum(flag(_departed_late()))
    return _monthly(
        flights,
        *[
            pct(F.sum(flag(_departed_late() & (F.col(role + hazard) == 1))), late).alias(
                f"pct_{hazard.lower()}"
            )
            for hazard in HAZARDS
        ],
    )


def hazard_rate(flights: DataFrame, role: str = "Origin") -> DataFrame:
    """By month: of the flights that met a hazard, the percentage delayed.

    Months with the most weather delays come first.
    """
    rates = []
    for hazard in HAZARDS:
        met = F.col(role + hazard) == 1
        rate = pct(F.sum(flag(_departed_late() & met)), F.sum(flag(met)))
        rates.append(rate.alias(f"pct_{hazard.lower()}"))
    return top_groups(_monthly(flights, *rates), "weather_delayed", "Year", "Month")
