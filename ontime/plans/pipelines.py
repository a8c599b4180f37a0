"""Whole pipelines, from raw tables to enriched ones and to models."""

from pyspark.sql import DataFrame, SparkSession

from ontime import schemas
from ontime.operators import enrich, reports, weather
from ontime.operators.rejects import Counted, counting_session
from ontime.sources import catalog, files
from ontime.sources.shared import materialize


#: The table that each ingest adds its counts to.
INGEST_LOG = "ingest_log"


def _airports(stations: DataFrame) -> tuple[DataFrame, bool]:
    """The airport list, and whether it is broadcast."""
    airports = weather.airports_from_stations(stations)
    small = enrich.small_side(airports)
    return small, small is not airports


def hourly_weather(
    stations: DataFrame, lines: DataFrame, by_wban: bool = True, counted: Counted | None = None
) -> DataFrame:
    """Hourly weather by airport.

    Readings of stations without an airport go before the roll-up, which
    leaves less to shuffle, and before they are parsed, unless lines are counted or the
    airport list is too large to meet whole lines.
    """
    airports, broadcast = _airports(stations)
    if broadcast and counted is None:
        readings = weather.parse_isd(weather.of_stations(lines, schemas.HOURLY_FIELDS["StationNumber"], airports))
    else:
        readings = enrich.at_airports(weather.parse_isd(lines, counted=counted), airports)
    return enrich.airport_weather(weather.rollup_hourly(readings, by_wban), airports)


def daily_weather(stations: DataFrame, lines: DataFrame, counted: Counted | None = None) -> DataFrame:
    """Daily weather by airport; lines of other stations go early, as in :func:`hourly_weather`."""
    airports, broadcast = _airports(stations)
    if broadcast and counted is None:
        lines = weather.of_stations(lines, schemas.DAILY_KEY_FIELDS["StationNumber"], airports)
    return enrich.airport_weather(weather.parse_gsod(lines, counted=counted), airports)


def _written(weather: DataFrame) -> DataFrame:
    """The weather by airport, written to the shared folder where Spark may broadcast what is small.

    Spark then knows its size before it plans the join, and flights aren't shuffled to meet a few rows of weather. Adaptive
    execution finds out too late: by then flights have been dealt.
    """
    limit = weather.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return weather if limit.startswith("-") else materialize(weather, "weather")


def hourly_flights(
    stations: DataFrame, lines: DataFrame, flights: DataFrame, counted: Counted | None = None
) -> DataFrame:
    """Flights with hourly weather at the origin."""
    return enrich.enrich_hourly(flights, _written(hourly_weather(stations, lines, counted=counted)))


def daily_flights(
    stations: DataFrame, lines: DataFrame, flights: DataFrame, counted: Counted | None = None
) -> DataFrame:
    """Flights with daily weather at the origin and the destination."""
    return enrich.enrich_daily(flights, _written(daily_weather(stations, lines, counted)))


def build_table(
    spark: SparkSession,
    database: str,
    stations_path: str,
    weather_glob: str,
    flights_glob: str,
    kind: str = "hourly",
) -> DataFrame:
    """Read the raw files, save the enriched table and report its coverage.

    Weather lines and flights, and those that couldn't be read, are counted in the same pass; the counts go to the table ``INGEST_LOG`` of the database.
    The report reads the saved table: the pipeline runs once.
    """
    seen, counting = {name: Counted(name) for name in ("weather", "flights")}, counting_session(spark)
    stations = files.read_stations(counting, stations_path)
    flights = files.read_flights(counting, flights_glob, counted=seen["flights"])
    if kind == "hourly":
        table = hourly_flights(stations, files.read_isd_lines(counting, weather_glob), flights, seen["weather"])
        name = f"{database}.{schemas.HOURLY_TABLE}"
    elif kind == "daily":
        table = daily_flights(stations, files.read_gsod_lines(counting, weather_glob), flights, seen["weather"])
        name = f"{database}.{schemas.DAILY_TABLE}"
    else:
        raise ValueError(f"kind must be 'hourly' or 'daily', not {kind!r}")
    catalog.ensure_database(spark, database)
    catalog.save_enriched(table, name)
    spark.catalog.refreshTable(name)
    counts = seen["weather"].metrics() | seen["flights"].metrics()
    catalog.log_metrics(spark, f"{database}.{INGEST_LOG}", name, {"weather": weather_glob, "flights": flights_glob}, counts)
    return reports.coverage(catalog.load_enriched(spark, name), "Year", "Month")
