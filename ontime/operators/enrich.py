"""Joins of weather to airports and of flights to airport weather.

Row-level joins carry no hint, except on the airport list, whose size is
checked first. Spark then broadcasts what is small at run time, and AQE splits
a join partition that holds a hot airport-hour by map output, however hot it
is; the other side has only a handful of rows for any key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions.columns import hhmm_to_hour

# A row of the airport list is a code of at most four characters and an int,
# about 40 bytes with its hash entry: this bound is about 8 MB.
BROADCAST_ROWS = 200_000

HOURLY_JOIN_KEYS = ["Origin", "Year", "Month", "Day", "CRSDepHour"]
DAY_KEYS = ["Year", "Month", "Day"]

_FLIGHT_COLUMNS = [
    "DayOfWeek",
    "Origin",
    "Dest",
    "DepTime",
    "CRSDepTime",
    "ArrTime",
    "CRSArrTime",
    "UniqueCarrier",
    "FlightNum",
    "DepDelay",
    "TaxiOut",
    "Cancelled",
    "CancellationCode",
    *schemas.DELAY_CAUSES,
]


def small_side(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most ``max_rows`` rows.

    Counting is a job that runs while the plan is built; it stops at the bound. A larger
    table is returned as it is, which leaves a shuffle join.
    """
    found = table.limit(max_rows + 1).count()
    return F.broadcast(table) if found <= max_rows else table


def at_airports(readings: DataFrame, airports: DataFrame) -> DataFrame:
    """Readings of stations that serve an airport.

    Most stations of the world serve none, so this comes before a roll-up.
    """
    return readings.join(airports.select("StationNumber"), "StationNumber", "left_semi")


def airport_weather(weather: DataFrame, airports: DataFrame) -> DataFrame:
    """Weather by airport code instead of station.

    A station that serves several codes gives a row for each of them.
    """
    kept = [c for c in weather.columns if c not in ("StationNumber", "WBAN")]
    return weather.join(airports, "StationNumber", "inner").select("AirportCode", *kept)


def with_departure_hour(flights: DataFrame) -> DataFrame:
    """Flights with the hour of their scheduled departure."""
    return flights.withColumn("CRSDepHour", hhmm_to_hour(F.col("CRSDepTime")))


def enrich_hourly(flights: DataFrame, weather: DataFrame) -> DataFrame:
    """Flights with the weather at the origin in the scheduled hour.

    A flight meets every row of its airport-hour, so several WBANs give several
    rows; roll up with ``by_wban=False`` to have one.
    """
    left = with_departure_hour(flights).withColumnRenamed("DayOfMonth", "Day")
    right = weather.withColumnsRenamed({"AirportCode": "Origin", "Hour": "CRSDepHour"})
    return left.join(right, HOURLY_JOIN_KEYS, "inner").select(
        *DAY_KEYS, "CRSDepHour", *_FLIGHT_COLUMNS, *schemas.ROLLUP_COLUMNS
    )


def _in_role(weather: DataFrame, role: str) -> DataFrame:
    measures = schemas.DAILY_MEASURES + schemas.DAILY_FLAGS
    return weather.select(
        F.col("AirportCode").alias(role), *DAY_KEYS, *[F.col(c).alias(role + c) for c in measures]
    )


def enrich_daily(flights: DataFrame, weather: DataFrame) -> DataFrame:
    """Flights with the day's weather at the origin and at the destination."""
    measures = schemas.DAILY_MEASURES + schemas.DAILY_FLAGS
    return (
        flights.withColumnRenamed("DayOfMonth", "Day")
        .join(_in_role(weather, "Origin"), ["Origin", *DAY_KEYS], "inner")
        .join(_in_role(weather, "Dest"), ["Dest", *DAY_KEYS], "inner")
        .select(
            *DAY_KEYS,
            *_FLIGHT_COLUMNS,
            *[role + measure for role in ("Origin", "Dest") for measure in measures],
        )
    )
