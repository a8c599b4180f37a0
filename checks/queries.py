"""The registered queries: library operators over whole test tables.

Each query stands next to its DuckDB equivalent, where SQL can express it.
Reports read the saved enriched tables; the enrichment queries and the flagship
run the pipelines from raw lines.
"""

import math
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracle import with_blocks
from checks.views import PLANTED_MINUTES, Views
from ontime import schemas
from ontime.functions import columns as fn
from ontime.operators import (
    enrich,
    evaluate,
    features,
    models,
    rejects,
    reports,
    sampling,
    score,
    stats,
    weather,
)
from ontime.plans import pipelines, training
from ontime.sources import catalog, files, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: How far k-means may stay above the least cost, as a factor.
ELBOW_MARGIN = 1.5


def query(sql: str | None = None):
    """Register a function of the views under its name, with its SQL."""

    def register(function):
        name = function.__name__
        QUERIES[name] = lambda spark, folder: function(Views(spark, folder))
        if sql is not None:
            ORACLE[name] = with_blocks(sql)
        return function

    return register


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits do not matter in a comparison."""
    kept = {
        name: F.round(name, digits) for name, kind in table.dtypes if kind in ("double", "float")
    }
    return table.withColumns(kept) if kept else table


# --- sources ----------------------------------------------------------------


@query("select try_cast(USAF as integer) as USAF, try_cast(WBAN as integer) as WBAN, StationN, Country, State, "
       "ICAO, Latitude, Longtitude, Elevation, Begin, \"End\" from fx_station_file")
def station_csv_scan(v):
    return files.read_stations(v.spark, v.station_file())


@query("select cast(length(value) as integer) as length, count(*) as lines from fx_isd_lines group by 1")
def isd_text_scan(v):
    return v.isd_lines().groupBy(F.length("value").alias("length")).agg(F.count("*").alias("lines"))


@query("select cast(length(value) as integer) as length, count(*) as lines from fx_gsod_lines group by 1")
def gsod_text_scan(v):
    return v.gsod_lines().groupBy(F.length("value").alias("length")).agg(F.count("*").alias("lines"))


_FILE_FLIGHTS = """
select * replace (case when DayOfWeek = 3 then concat(UniqueCarrier, ',x') else UniqueCarrier end as UniqueCarrier,
  nullif(TailNum, 'NA') as TailNum)
from fx_flights where AirTime not in (60, 61, 62)
"""


@query(_FILE_FLIGHTS)
def flight_csv_scan(v):
    return files.read_flights(v.spark, v.flight_file())


@query("select AirTime not in (60, 61, 62) as valid, count(*) as rows from fx_flights group by 1")
def flight_csv_validity(v):
    rows = files.read_flights(v.spark, v.flight_file(), on_bad="keep")
    return rows.groupBy("valid").agg(F.count("*").alias("rows"))


@query(f"select count(*) as rows from ({_FILE_FLIGHTS})")
def flight_csv_count(v):
    return reports.row_count(files.read_flights(v.spark, v.flight_file()))


# --- parsing ----------------------------------------------------------------


@query("select * replace (round(Precipitation48, 3) as Precipitation48) from isd")
def isd_parse(v):
    return rounded(weather.parse_isd(v.isd_lines()), 3)


@query("select count(*) as lines, count(*) filter (where not good) as bad from isd_checked")
def isd_bad_lines(v):
    return weather.bad_rows(v.isd_lines(), "hourly")


@query("""select PrecipitationHour, round(sum(cast(case when PrecipitationHour = 99 or Precipitation = 9999 then 9999
  when PrecipitationHour = 0 then Precipitation * cast(48 as double) * 0.0393700787
  else cast(Precipitation as double) / PrecipitationHour * 48 * 0.0393700787 end as double)), 3) as inches
from isd group by PrecipitationHour""")
def isd_exact_rate(v):
    readings = weather.parse_isd(v.isd_lines(), exact_rate=True)
    return rounded(
        readings.groupBy("PrecipitationHour").agg(F.sum("Precipitation48").alias("inches")), 3
    )


@query("select * from gsod")
def gsod_parse(v):
    return weather.parse_gsod(v.gsod_lines())


@query("select count(*) as lines, count(*) filter (where not good) as bad from gsod_checked")
def gsod_bad_lines(v):
    return weather.bad_rows(v.gsod_lines(), "daily")


# --- weather and joins ------------------------------------------------------


@query("select AirportCode, StationNumber from airports")
def stations_us_airports(v):
    return weather.airports_from_stations(v.stations())


_ROUND_ROLLUP = """* replace (round(MaxPrecipitation48, 3) as MaxPrecipitation48,
  round(MinPrecipitation48, 3) as MinPrecipitation48)"""


@query(f"select {_ROUND_ROLLUP} from hourly_rollup")
def weather_hourly_rollup(v):
    return rounded(weather.rollup_hourly(weather.parse_isd(v.isd_lines())), 3)


@query("""select StationNumber, Year, Month, Day, Hour, coalesce(max(nullif(Temp, 9999)), 9999) as MaxTemp,
  min(Temp) as MinTemp, count(distinct Temp) as DistinctTemp, max(PresentWeatherCode) as MaxPresentWeatherCode,
  count(*) as NumOfRec from isd group by StationNumber, Year, Month, Day, Hour""")
def weather_station_hours(v):
    rollup = weather.rollup_hourly(weather.parse_isd(v.isd_lines()), by_wban=False)
    return rollup.select(
        "StationNumber", "Year", "Month", "Day", "Hour", "MaxTemp", "MinTemp", "DistinctTemp",
        "MaxPresentWeatherCode", "NumOfRec",
    )


@query(f"select {_ROUND_ROLLUP} from hourly_airport")
def airport_weather(v):
    return rounded(pipelines.hourly_weather(v.stations(), v.isd_lines()), 3)


@query("select * from daily_airport")
def airport_weather_daily(v):
    return pipelines.daily_weather(v.stations(), v.gsod_lines())


@query(f"select {_ROUND_ROLLUP} from hourly")
def flights_enriched_hourly(v):
    return rounded(v.hourly_flights(), 3)


@query("select * from daily")
def flights_enriched_daily(v):
    return v.daily_flights()


@query("select cast(floor(CRSDepTime / 100) as integer) as CRSDepHour, count(*) as flights from fx_flights group by 1")
def departure_hours(v):
    hours = enrich.with_departure_hour(v.flights())
    return hours.groupBy("CRSDepHour").agg(F.count("*").alias("flights"))


# --- catalog ----------------------------------------------------------------


@query("select Year, Month, count(*) as rows from hourly group by Year, Month")
def enriched_table_round_trip(v):
    spark, database = v.spark, "ontime_check"
    name = f"{database}.{schemas.HOURLY_TABLE}_{uuid.uuid4().hex[:8]}"
    catalog.ensure_database(spark, database, shared.new_folder(spark, database))
    catalog.save_enriched(v.hourly_flights(), name)
    return reports.coverage(catalog.load_enriched(spark, name), "Year", "Month")


def _saved_weather(v, weather):
    """The weather as a bucketed table, for as long as the session's folder is there."""
    spark, database = v.spark, "ontime_weather"
    catalog.ensure_database(spark, database, shared.new_folder(spark, database))
    name = f"{database}.weather_{uuid.uuid4().hex[:8]}"
    catalog.save_weather(weather, name)
    return spark.table(name)


@query(f"select {_ROUND_ROLLUP} from hourly")
def enriched_from_saved_hourly_weather(v):
    weather_table = _saved_weather(v, pipelines.hourly_weather(v.stations(), v.isd_lines()))
    return rounded(enrich.enrich_hourly(v.flights(), weather_table), 3)


@query("select * from daily")
def enriched_from_saved_daily_weather(v):
    weather_table = _saved_weather(v, pipelines.daily_weather(v.stations(), v.gsod_lines()))
    return enrich.enrich_daily(v.flights(), weather_table)


@query("select count(*) as flights, cast(sum(WeatherDelay) as bigint) as minutes from hourly where WeatherDelay > 0")
def temp_view_report(v):
    v.hourly().createOrReplaceTempView("ontime_flights")
    return v.spark.sql(
        "select count(*) as flights, sum(WeatherDelay) as minutes from ontime_flights where WeatherDelay > 0"
    )


def _table_from_files(v, kind: str, weather_path: str):
    """Row counts of the saved table by month and what its ingest read and rejected; the tables are dropped afterwards."""
    spark, database = v.spark, f"ontime_files_{uuid.uuid4().hex[:8]}"
    catalog.ensure_database(spark, database, shared.new_folder(spark, database))
    try:
        coverage = pipelines.build_table(spark, database, v.station_file(), weather_path, v.flight_file(), kind)
        months = [("rows", r.Year, r.Month, r.rows) for r in coverage.collect()]
        logged = [(r.metric, None, None, int(r.value)) for r in spark.table(f"{database}.{pipelines.INGEST_LOG}").collect()]
    finally:
        catalog.drop_outputs(spark, database, [r.tableName for r in spark.sql(f"show tables in {database}").collect()], True)
    return spark.createDataFrame(months + logged, "measure string, Year int, Month int, n bigint")


def _table_from_files_sql(table: str, lines: str, rejected: str) -> str:
    flights = "select count(*) as n, count(*) filter (where AirTime in (60, 61, 62)) as bad from fx_flights"
    return f"""with f as ({flights}), w as (select count(*) as n, count(*) filter (where {rejected}) as bad from {lines})
select 'rows' as measure, Year, Month, count(*) as n from {table} group by Year, Month
union all select 'flights_read', null, null, n from f union all select 'flights_rejected', null, null, bad from f
union all select 'weather_read', null, null, n from w union all select 'weather_rejected', null, null, bad from w"""


@query(_table_from_files_sql("file_hourly", "isd_checked", "not good"))
def hourly_table_from_files(v):
    return _table_from_files(v, "hourly", v.isd_file())


@query(_table_from_files_sql("file_daily", "gsod_checked", "not good"))
def daily_table_from_files(v):
    return _table_from_files(v, "daily", v.gsod_file())


# --- reports ----------------------------------------------------------------

_BY_YEAR = """
select Year, cast(count(*) filter (where WeatherDelay > 0) as bigint) as delayed,
  cast(count(*) filter (where WeatherDelay = 0) as bigint) as on_time, count(*) as total
from {table} group by Year order by Year
"""


@query(_BY_YEAR.format(table="hourly"))
def delay_by_year(v):
    return reports.delay_by_year(v.hourly_flights())


@query(_BY_YEAR.format(table="daily"))
def delay_by_year_daily(v):
    return reports.delay_by_year(v.daily())


@query("""select cast(sum(case when WeatherDelay = 0 then 1 end) as bigint) as on_time,
  cast(sum(case when WeatherDelay > 0 then 1 end) as bigint) as delayed from hourly""")
def delay_totals(v):
    return reports.delay_totals(v.hourly())


@query("""select case when WeatherDelay = 0 then '0.On Time Arrival' when WeatherDelay <= 0 then null
  when WeatherDelay <= 12 then '1.Less than 12 Minutes' when WeatherDelay <= 25 then '2.Between 12 Minutes and 25 Minutes'
  when WeatherDelay <= 55 then '3.Between 25 Minutes and 55 Minutes'
  when WeatherDelay > 55 then '5.Beyond 55 minutes' end as bucket, count(*) as flights from hourly group by 1""")
def delay_bucket_counts(v):
    return reports.bucket_counts(v.hourly(), on_time=schemas.ON_TIME_LABEL)


@query("""select case when WeatherDelay <= 15 then '1.Less than 15 Minutes'
  when WeatherDelay <= 60 then '2.Between 15 Minutes and 1 Hour' when WeatherDelay <= 120 then '3.Between 1 Hour and 2 Hours'
  when WeatherDelay <= 240 then '4.Between 2 Hours and 4 Hours' else '5.Beyond 4 Hours' end as bucket,
  count(*) as flights from hourly where WeatherDelay > 0 group by 1""")
def delay_hour_bucket_counts(v):
    return reports.bucket_counts(reports.delayed(v.hourly()), schemas.HOUR_BUCKETS)


@query("""select case when WeatherDelay <= 15 then '1.Less than 15 Minutes'
  when WeatherDelay <= 120 then '2.Between 15 Minutes and 2 Hour' else '3.Beyond 2 Hours' end as bucket,
  count(*) as flights from hourly where WeatherDelay > 0 group by 1""")
def delay_coarse_bucket_counts(v):
    return reports.bucket_counts(reports.delayed(v.hourly()), schemas.COARSE_BUCKETS)


@query("select Year, count(*) as rows from hourly group by Year")
def coverage_year(v):
    return reports.coverage(v.hourly(), "Year")


@query("select Year, Month, count(*) as rows from hourly group by Year, Month")
def coverage_year_month(v):
    return reports.coverage(v.hourly(), "Year", "Month")


@query("select count(*) as rows from daily")
def daily_row_count(v):
    return reports.row_count(v.daily())


_MONTHLY = """
select Year, Month, count(*) as flights, cast(sum(late) as bigint) as delayed,
  cast(sum(case when WeatherDelay > 0 and Cancelled = 0 then 1 else 0 end) as bigint) as weather_delayed,
  {pcts}
from (select *, case when DepDelay > 0 and Cancelled = 0 then 1 else 0 end as late from daily)
group by Year, Month
"""
_HAZARDS = ["Fog", "Snow", "Hail", "Thunder", "Tornado"]


@query(_MONTHLY.format(pcts=", ".join(
    f"round(cast(sum(late * Origin{h}) as double) / nullif(sum(late), 0) * 100) as pct_{h.lower()}" for h in _HAZARDS)))
def hazard_share_monthly(v):
    return reports.hazard_share(v.daily())


@query(_MONTHLY.format(pcts=", ".join(
    f"round(cast(sum(late * Origin{h}) as double) / nullif(sum(Origin{h}), 0) * 100) as pct_{h.lower()}"
    for h in _HAZARDS)))
def hazard_rate_monthly(v):
    return reports.hazard_rate(v.daily())


# --- filters ----------------------------------------------------------------


@query("""select Month, count(*) as flights, cast(sum(MaxPressure) as bigint) as pressure from valid_hourly
where Month in (10, 11, 1, 2, 3) and MinPressure < 99999 group by Month""")
def winter_valid_flights(v):
    bounds = reports.CONDITION_MEASURES | {"MinPressure": schemas.MISSING["Pressure"]}
    known = reports.valid_weather(reports.season(v.hourly(), "winter"), bounds)
    return known.groupBy("Month").agg(
        F.count("*").alias("flights"), F.sum("MaxPressure").alias("pressure")
    )


@query("""select Origin, count(*) as flights, cast(sum(WeatherDelay) as bigint) as minutes from daily
where OriginRain = 1 and OriginFog = 0 and OriginSnow = 0 and OriginHail = 0 and OriginThunder = 0
  and WeatherDelay > 0 group by Origin""")
def rain_only_delays(v):
    only = reports.delayed(reports.hazard_only(v.daily(), "Rain"))
    return only.groupBy("Origin").agg(
        F.count("*").alias("flights"), F.sum("WeatherDelay").alias("minutes")
    )


# --- statistics -------------------------------------------------------------

_HISTOGRAM = """
known as (select cast({column} as double) as x from {table} where {column} is not null),
edges as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / 30 as w, count(*) as total from known),
counted as (
  select least(cast(floor((x - lo) / w) as integer), 29) as bin, count(*) as frequency
  from known, edges group by 1),
bins as (
  select cast(g.bin as integer) as bin, round(lo + g.bin * w, 6) as lower,
    round(case when g.bin = 29 then hi else lo + (g.bin + 1) * w end, 6) as upper,
    coalesce(frequency, 0) as frequency,
    round(coalesce(frequency, 0) / (total * (case when g.bin = 29 then hi else lo + (g.bin + 1) * w end - (lo + g.bin * w))), 6)
      as density
  from range(30) g(bin) cross join edges left join counted c on c.bin = g.bin)
"""


def _histogram_sql(table, column, columns="bin, lower, upper, frequency"):
    return f"with {_HISTOGRAM.format(table=table, column=column)} select {columns} from bins"


@query(_histogram_sql("hourly", "DepDelay"))
def depdelay_histogram(v):
    return rounded(stats.histogram(v.hourly(), "DepDelay"))


@query(_histogram_sql("hourly", "WeatherDelay"))
def weatherdelay_histogram(v):
    return rounded(stats.histogram(v.hourly(), "WeatherDelay"))


@query(_histogram_sql("(select WeatherDelay from hourly where WeatherDelay > 0)", "WeatherDelay", "*"))
def weatherdelay_density(v):
    return rounded(stats.density(reports.delayed(v.hourly()), "WeatherDelay"))


def _describe_sql(table, columns):
    parts = [
        f"""select '{c}' as measure, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  round(cast(min({c}) as double), 6) as min, round(quantile_cont(cast({c} as double), 0.25), 6) as q25,
  round(quantile_cont(cast({c} as double), 0.5), 6) as q50, round(quantile_cont(cast({c} as double), 0.75), 6) as q75,
  round(cast(max({c}) as double), 6) as max from {table}"""
        for c in columns
    ]
    return " union all ".join(parts)


@query(_describe_sql("(select cast(1000000000 as double) + DepDelay as shifted from hourly where DepDelay is not null)", ["shifted"]))
def shifted_describe(v):
    shifted = v.hourly().select((F.lit(1e9) + F.col("DepDelay")).alias("shifted"))
    return rounded(stats.describe(shifted, ["shifted"]))


@query("select Month, count(*) as rows from hourly where Month in (12, 1, 2) group by 1")
def meteorological_winter(v):
    winter = reports.season(v.hourly(), "winter", [12, 1, 2])
    return winter.groupBy("Month").agg(F.count("*").alias("rows"))


@query(_describe_sql("(select coalesce(DepDelay, 0) as depDelay, coalesce(WeatherDelay, 0) as weatherDelay "
                     "from hourly where WeatherDelay > 0)", ["weatherDelay", "depDelay"]))
def delay_describe(v):
    delays = reports.delayed(v.hourly()).select(
        fn.or_zero(F.col("WeatherDelay")).alias("weatherDelay"),
        fn.or_zero(F.col("DepDelay")).alias("depDelay"),
    )
    return rounded(stats.describe(delays, ["weatherDelay", "depDelay"]))


_CONDITIONS = list(reports.CONDITION_MEASURES)


@query(_describe_sql("(select * from valid_hourly where Month in (10, 11, 1, 2, 3) and MinPressure < 99999)", _CONDITIONS))
def winter_condition_describe(v):
    bounds = reports.CONDITION_MEASURES | {"MinPressure": schemas.MISSING["Pressure"]}
    known = reports.valid_weather(reports.season(v.hourly(), "winter"), bounds)
    return rounded(stats.describe(known, _CONDITIONS))


@query("""with s as (select count(x) as n, avg(x) as m, stddev_samp(x) as d, min(x) as lo, max(x) as hi,
    quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c
  from (select log10(WeatherDelay) as x from hourly where WeatherDelay > 0)),
figures as (select n, unnest([{'k': 'mean', 'x': m}, {'k': 'std', 'x': d}, {'k': 'min', 'x': lo}, {'k': '25%', 'x': a},
  {'k': '50%', 'x': b}, {'k': '75%', 'x': c}, {'k': 'max', 'x': hi}, {'k': 'mean-1std', 'x': m - d},
  {'k': 'mean+1std', 'x': m + d}, {'k': 'mean-2std', 'x': m - 2 * d}, {'k': 'mean+2std', 'x': m + 2 * d},
  {'k': 'mean-3std', 'x': m - 3 * d}, {'k': 'mean+3std', 'x': m + 3 * d}]) as f from s)
select n as count, f.k as statistic, round(f.x, 6) as log10_value, round(pow(10, f.x), 6) as minutes from figures""")
def delay_log10_describe(v):
    return rounded(stats.describe_log10(v.hourly(), "WeatherDelay"))


_BOX = """
q as (select {keys}, count(*) as count, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
  quantile_cont(value, 0.75) as q3 from long where value is not null group by {keys})
select {picked}, q.count, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(min(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as low_whisker,
  round(max(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as high_whisker,
  cast(count(*) filter (where not value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as bigint) as outliers
from long join q using ({keys}) where value is not null group by {picked}, q.count, q1, median, q3
"""


def _season_box_sql(where):
    arms = " union all ".join(
        f"select case when WeatherDelay > 0 then 1 else 0 end as delayed, '{c}' as measure, cast({c} as double) as value "
        f"from valid_hourly where {where}"
        for c in _CONDITIONS
    )
    return f"with long as ({arms}), " + _BOX.format(keys="delayed, measure", picked="q.delayed, q.measure")


def _season_boxes(flights):
    classed = flights.withColumn("delayed", fn.flag(F.col("WeatherDelay") > 0))
    return rounded(stats.box_stats(classed, "delayed", _CONDITIONS))


@query(_season_box_sql("Month in (10, 11, 1, 2, 3) and MinPressure < 99999"))
def winter_box_stats(v):
    bounds = reports.CONDITION_MEASURES | {"MinPressure": schemas.MISSING["Pressure"]}
    return _season_boxes(reports.valid_weather(reports.season(v.hourly(), "winter"), bounds))


@query(_season_box_sql("Month in (4, 5, 6, 7, 8, 9)"))
def summer_box_stats(v):
    return _season_boxes(reports.valid_weather(reports.season(v.hourly(), "summer")))


_FLAGS = [role + name for role in ("Origin", "Dest") for name in schemas.DAILY_FLAGS]


@query("with long as (" + " union all ".join(
    f"select '{f}' as flag, case when {f} = 1 then 1 else 0 end as met, "
    "case when WeatherDelay > 0 then log10(WeatherDelay) end as value from daily" for f in _FLAGS)
    + "), " + _BOX.format(keys="flag, met", picked="q.flag, q.met"))
def hazard_box_stats(v):
    flags = v.daily().select(
        *[fn.flag(F.col(name) == 1).alias(name) for name in _FLAGS],
        fn.log10_minutes(F.col("WeatherDelay")).alias("log"),
    )
    return rounded(stats.flag_box_stats(flags, _FLAGS, "log"))


def _trend_sql(y, xs, table):
    return " union all ".join(
        f"select '{x}' as feature, round(regr_slope({y}, {x}), 6) as slope, round(regr_intercept({y}, {x}), 6) as intercept, "
        f"round(regr_r2({y}, {x}), 6) as r2, cast(regr_count({y}, {x}) as bigint) as n from {table}"
        for x in xs
    )


@query(_trend_sql("WeatherDelay", _CONDITIONS, "(select * from valid_hourly where WeatherDelay > 0)"))
def weather_trend_lines(v):
    known = reports.valid_weather(reports.delayed(v.hourly()))
    return rounded(stats.trend_lines(known, "WeatherDelay", _CONDITIONS))


_DAILY_FEATURES = [
    role + name
    for role in ("Origin", "Dest")
    for name in ("Visibility", "WindSpeed", "MaxWindSpeed", "Precipitation", "SnowDepth")
]


@query(_trend_sql("log10(WeatherDelay)", _DAILY_FEATURES, "(select * from daily where WeatherDelay > 0)"))
def daily_trend_lines(v):
    logs = reports.delayed(v.daily()).withColumn("log", fn.log10_minutes(F.col("WeatherDelay")))
    return rounded(stats.trend_lines(logs, "log", _DAILY_FEATURES))


def _hazard_delays(v):
    """Delays counted where it snowed, and where it only rained."""
    return v.daily().select(
        "OriginSnowDepth",
        "OriginPrecipitation",
        reports.hazard_delay("Snow", only=False).alias("snowDelay"),
        reports.hazard_delay("Rain").alias("rainDelay"),
    )


@query("""select OriginSnowDepth, WeatherDelay as snowDelay from daily where OriginSnow = 1 and WeatherDelay > 0
order by 1, 2 limit 100000""")
def snow_delay_points(v):
    snowed = _hazard_delays(v).where(F.col("snowDelay") > 0)
    return stats.pair_points(snowed, "OriginSnowDepth", "snowDelay", 100_000)


@query("""select OriginSnowDepth, WeatherDelay as snowDelay from daily where OriginSnow = 1 and WeatherDelay > 0
order by 1, 2 limit 50""")
def snow_delay_first_points(v):
    snowed = _hazard_delays(v).where(F.col("snowDelay") > 0)
    return stats.pair_points(snowed, "OriginSnowDepth", "snowDelay", 50)


@query("""select OriginPrecipitation, WeatherDelay as rainDelay from daily where OriginRain = 1 and OriginFog = 0
and OriginSnow = 0 and OriginHail = 0 and OriginThunder = 0 and WeatherDelay > 0""")
def rain_delay_points(v):
    rained = _hazard_delays(v).where(F.col("rainDelay") > 0)
    return stats.pair_points(rained, "OriginPrecipitation", "rainDelay")


@query("""with m as (select OriginSnowDepth, OriginPrecipitation,
  case when OriginSnow = 1 then WeatherDelay else 0 end as snowDelay,
  case when OriginRain = 1 and OriginFog = 0 and OriginSnow = 0 and OriginHail = 0 and OriginThunder = 0
       then WeatherDelay else 0 end as rainDelay from daily)
select 'OriginSnowDepth' as x, 'snowDelay' as y, round(corr(OriginSnowDepth, snowDelay), 6) as corr,
  count(snowDelay) as n from m union all
select 'OriginPrecipitation', 'rainDelay', round(corr(OriginPrecipitation, rainDelay), 6), count(rainDelay) from m""")
def hazard_delay_corr(v):
    pairs = [("OriginSnowDepth", "snowDelay"), ("OriginPrecipitation", "rainDelay")]
    return rounded(stats.pair_corr(_hazard_delays(v), pairs))


@query("""select 'WeatherDelay' as x, 'DepDelay' as y, round(corr(WeatherDelay, DepDelay), 6) as corr, count(*) as n
from hourly where WeatherDelay > 0 and DepDelay is not null""")
def delay_pair_corr(v):
    return rounded(stats.pair_corr(reports.delayed(v.hourly()), [("WeatherDelay", "DepDelay")]))


@query("""select round(pow(10, log10(WeatherDelay)), 6) as minutes, count(*) as flights from hourly
where WeatherDelay > 0 group by 1""")
def log10_round_trip(v):
    log = fn.log10_minutes(F.col("WeatherDelay"))
    minutes = F.round(fn.minutes_from_log10(log), 6).alias("minutes")
    return reports.delayed(v.hourly()).groupBy(minutes).agg(F.count("*").alias("flights"))


# --- sampling and training sets ---------------------------------------------


def _flight_number():
    return F.col("FlightNum").cast("bigint")


@query("""select Year, Month, Origin, FlightNum, DepDelay, WeatherDelay from hourly
where cast(FlightNum as bigint) % 100 < 10""")
def flight_sample_by_key(v):
    sample = sampling.sample_by_key(v.hourly(), _flight_number(), 100, 10)
    return sample.select("Year", "Month", "Origin", "FlightNum", "DepDelay", "WeatherDelay")


@query("""select Year, Month, Day, Origin, FlightNum, MaxWindSpeed, MinVisibility, MaxPresentWeatherCode,
  case when WeatherDelay > 0 then 1 else 0 end as label
from hourly where WeatherDelay > 0 or (WeatherDelay = 0 and cast(FlightNum as bigint) % 50 = 0)""")
def balanced_training_set(v):
    columns = ["MaxWindSpeed", "MinVisibility", "MaxPresentWeatherCode"]
    known = reports.drop_null(v.hourly(), ["WeatherDelay", *columns])
    labelled = features.fill_sentinels(known).withColumn(
        "label", fn.flag(F.col("WeatherDelay") > 0)
    )
    kept = sampling.balance_by_key(labelled, "label", {0: (50, 1)}, _flight_number())
    return kept.select("Year", "Month", "Day", "Origin", "FlightNum", *columns, "label")


@query("""select label, count(*) as flights from (
  select 1 as label from hourly where WeatherDelay > 0 union all select 0 from hourly where WeatherDelay = 0)
group by label""")
def stacked_classes(v):
    late = sampling.with_label(reports.delayed(v.hourly()), 1)
    prompt = sampling.with_label(reports.on_time(v.hourly()), 0)
    return sampling.stack(late, prompt).groupBy("label").agg(F.count("*").alias("flights"))


def _near_share(rows: Column, whole: Column, share: Column) -> Column:
    """Whether a random draw of a share has a likely size: six standard deviations."""
    return F.abs(rows - share * whole) <= 6 * F.sqrt(whole * share * (1 - share)) + 1


@query("""select part, count(*) as flights, true as likely from hourly cross join (values ('training'), ('test')) p(part)
group by part""")
def random_split_sizes(v):
    """Sizes of random parts, next to the number of flights that they make up."""
    parts = sampling.split(v.hourly(), [0.7, 0.3], seed=10)
    whole = reports.row_count(v.hourly()).scalar()
    sizes = [
        sampling.with_label(reports.row_count(part).withColumn("flights", whole), name, "part").select(
            "part", "flights", _near_share(F.col("rows"), F.col("flights"), F.lit(share)).alias("likely")
        )
        for part, name, share in zip(parts, ("training", "test"), (0.7, 0.3))
    ]
    return sampling.stack(*sizes)


@query("""select sample, label, count(*) as flights, true as likely from (
  select case when WeatherDelay > 0 then 1 else 0 end as label from hourly where WeatherDelay >= 0)
cross join (values ('by class'), ('one in ten')) s(sample) group by sample, label""")
def random_sample_by_class(v):
    """Sizes of random samples by class, next to those of the classes."""
    labelled = features.delay_examples(v.hourly())
    drawn = sampling.balance(labelled, "label", {1: 1.0, 0: 0.02}, seed=7)
    thin = sampling.sample_rows(labelled, 0.1, seed=7)
    whole = labelled.groupBy("label").agg(F.count("*").alias("flights"))
    late = F.col("label") == 1
    kept = []
    for name, part, share in (
        ("by class", drawn, F.when(late, 1.0).otherwise(0.02)),
        ("one in ten", thin, F.lit(0.1)),
    ):
        sizes = part.groupBy("label").agg(F.count("*").alias("rows"))
        near = _near_share(F.col("rows"), F.col("flights"), share)
        sized = whole.join(sizes, "label", "left").select("label", "flights", F.coalesce(near, F.lit(False)).alias("likely"))
        kept.append(sampling.with_label(sized, name, "sample"))
    return sampling.stack(*kept)


@query("select Year, count(*) as rows, cast(sum(TaxiOut) as bigint) as taxi from hourly group by Year")
def split_parts_together(v):
    """The parts of a random split make up the table."""
    whole = sampling.stack(*sampling.split(v.hourly(), [0.8, 0.2], seed=10))
    return whole.groupBy("Year").agg(F.count("*").alias("rows"), F.sum("TaxiOut").alias("taxi"))


@query("""select count(*) as flights, cast(sum(MaxPressure) as bigint) as pressure from hourly
where WeatherDelay > 0""")
def balance_keeps_delayed(v):
    """A random balance keeps every delayed flight."""
    drawn = sampling.balance(features.delay_examples(v.hourly()), "label", {1: 1.0, 0: 0.02}, seed=7)
    late = drawn.where(F.col("label") == 1)
    return late.agg(F.count("*").alias("flights"), F.sum("MaxPressure").alias("pressure"))


# --- features ---------------------------------------------------------------

_INDEX = """
select {column} as code, cast(dense_rank() over (order by {column}) - 1 as double) as index, count(*) as flights
from hourly group by {column}
"""


def _index_table(table, column):
    model = features.fit_domain_index(table, [column])
    indexed = model.transform(table.select(column))
    return indexed.groupBy(
        F.col(column).alias("code"), F.col(model.getOutputCols()[0]).alias("index")
    ).agg(F.count("*").alias("flights"))


@query(_INDEX.format(column="UniqueCarrier"))
def carrier_index(v):
    return _index_table(v.hourly(), "UniqueCarrier")


@query(_INDEX.format(column="Origin"))
def origin_index(v):
    return _index_table(v.hourly(), "Origin")


@query(_INDEX.format(column="MaxPresentWeatherCode"))
def weather_code_index(v):
    return _index_table(v.hourly(), "MaxPresentWeatherCode")


@query("""with b as (select case when WeatherDelay <= 12 then '1.Less than 12 Minutes'
  when WeatherDelay <= 25 then '2.Between 12 Minutes and 25 Minutes'
  when WeatherDelay <= 55 then '3.Between 25 Minutes and 55 Minutes' else '5.Beyond 55 minutes' end as label
  from hourly where WeatherDelay > 0)
select label, cast(row_number() over (order by count(*) desc, label) - 1 as double) as index, count(*) as flights
from b group by label""")
def label_index(v):
    examples = features.bucket_examples(v.hourly())
    model = features.fit_label_index(examples, "delayCat")
    return (
        model.transform(examples)
        .groupBy(F.col("delayCat").alias("label"), F.col(model.getOutputCol()).alias("index"))
        .agg(F.count("*").alias("flights"))
    )


_VECTOR_SIZE = (
    "(select count(distinct UniqueCarrier) + count(distinct Origin) + count(distinct Dest){codes} + {numbers} "
    "from hourly where WeatherDelay >= 0)"
)


@query(f"""select Origin, cast({_VECTOR_SIZE.format(codes="", numbers=4)} as integer) as size, count(*) as flights,
  cast(sum(Month + Day + DayOfWeek + CRSDepHour + 3) as double) as total
from hourly where WeatherDelay >= 0 group by Origin""")
def flight_vectors(v):
    return _vector_totals(v, with_weather=False)


@query(f"""select Origin,
  cast({_VECTOR_SIZE.format(codes=" + count(distinct MaxPresentWeatherCode)", numbers=9)} as integer) as size,
  count(*) as flights, round(sum(Month + Day + DayOfWeek + CRSDepHour + 4 + MaxWindSpeed + MinCeilingHeight
    + MinVisibility + MaxPressure + cast(MaxPrecipitation48 as double)), 2) as total
from hourly where WeatherDelay >= 0 group by Origin""")
def weather_vectors(v):
    return _vector_totals(v, with_weather=True)


def _vector_totals(v, with_weather):
    examples = features.delay_examples(v.hourly())
    domain = features.fit_domain_index(examples, features.categories(with_weather))
    stages = features.feature_stages(domain, with_weather)
    table = examples
    for stage in stages:
        table = (stage.fit(table) if hasattr(stage, "fit") else stage).transform(table)
    values = vector_to_array(F.col("features"))
    total = F.aggregate(values, F.lit(0.0), lambda total, value: total + value)
    return rounded(
        table.groupBy("Origin", F.size(values).alias("size")).agg(
            F.count("*").alias("flights"), F.sum(total).alias("total")
        ),
        2,
    )


# --- requests and scoring ---------------------------------------------------


@query("""select FlightNum, cast(Month as double) as Month, cast(Day as double) as Day,
  cast(DayOfWeek as double) as DayOfWeek, cast(CRSDepHour as double) as CRSDepHour, UniqueCarrier, Origin, Dest,
  cast(case when given then MaxWindSpeed else 9999 end as double) as MaxWindSpeed,
  cast(case when given then MinCeilingHeight else 99999 end as double) as MinCeilingHeight,
  cast(case when given then MinVisibility else 999999 end as double) as MinVisibility,
  cast(case when given then MaxPressure else 99999 end as double) as MaxPressure,
  cast(case when given then floor(MaxPrecipitation48) else 9999 end as double) as MaxPrecipitation48,
  case when given then MaxPresentWeatherCode else '0' end as MaxPresentWeatherCode
from (select *, CRSDepTime % 3 <> 0 as given from hourly)""")
def request_parse_fill(v):
    return score.fill_missing_weather(score.parse_requests(v.requests())).drop("request")


@query("""select 'requests_read' as metric, cast(count(*) as double) as value from hourly union all
select 'requests_rejected', cast(count(*) filter (where CRSDepTime % 3 <> 0 and CRSDepTime % 5 = 0) as double) from hourly union all
select 'scored', cast(count(*) filter (where CRSDepTime % 3 = 0 or CRSDepTime % 5 <> 0) as double) from hourly""")
def request_rejects(v):
    """Requests read and rejected, counted while they are parsed; some lack their last value."""
    short = F.when(F.col("request").rlike("^([^,]*,){12}") & (F.col("CRSDepTime") % 5 == 0), F.substring_index("request", ",", 12))
    broken = v.counting().timed_requests().select(F.coalesce(short, F.col("request")).alias("request"))
    seen = rejects.Counted("requests")
    scored = score.parse_requests(broken, counted=seen).count()
    metrics = seen.metrics() | {"scored": scored}
    return v.spark.createDataFrame([(name, float(value)) for name, value in metrics.items()], "metric string, value double")


@query("""select FlightNum, prediction, log_minutes,
  round(case when prediction = 1 then pow(10, log_minutes) else 0 end, 6) as result from fx_predictions""")
def two_stage_combine(v):
    result = score.combine_stages(F.col("prediction"), F.col("log_minutes")).alias("result")
    return rounded(v.predictions().select("FlightNum", "prediction", "log_minutes", result))


@query("""select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy,
  round(1 - avg(case when label = prediction then 1.0 else 0.0 end), 6) as test_error,
  round(sqrt(avg(pow(log10(WeatherDelay) - log_minutes, 2))), 6) as rmse,
  round(sqrt(avg(pow(WeatherDelay - pow(10, log_minutes), 2))), 6) as rmse_minutes from fx_predictions""")
def prediction_metrics(v):
    made = v.predictions().withColumn("log", fn.log10_minutes(F.col("WeatherDelay")))
    figures = [
        evaluate.accuracy(made),
        evaluate.rmse(made, "log", "log_minutes"),
        evaluate.rmse_minutes(made, "WeatherDelay", "log_minutes"),
    ]
    rows = [figure.withColumn("row", F.lit(1)) for figure in figures]
    return rounded(rows[0].join(rows[1], "row").join(rows[2], "row").drop("row"))


_AUROC = """
select '{score}' as score, round((sum(case when label = 1 then r end) - p * (p + 1) / 2) / (p * (n - p)), 6) as auroc
from (select label, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as r,
  sum(label) over () as p, count(*) over () as n from (select label, cast({score} as double) as {score} from fx_predictions))
group by p, n
"""


@query(_AUROC.format(score="score") + " union all " + _AUROC.format(score="prediction"))
def prediction_auroc(v):
    made = v.predictions()
    rows = [(name, evaluate.auroc(made, name)) for name in ("score", "prediction")]
    return rounded(v.spark.createDataFrame(rows, "score string, auroc double"))


@query("""select score as threshold, round(sum(n) over down / sum(n) over (), 6) as "FPR", round(sum(p) over down / sum(p) over (), 6) as "TPR"
from (select cast(score as double) as score, count(*) filter (where label = 1) as p, count(*) filter (where label <> 1) as n
  from fx_predictions group by 1) window down as (order by score desc)""")
def prediction_roc_curve(v):
    made = evaluate.roc_points(v.predictions(), "score")
    return made.withColumns({name: F.round(name, 6) for name in ("FPR", "TPR")})


# --- models, on flights whose delay follows a planted rule --------------------
#
# The rule separates kinds of weather by a gap, so a model that learns it gives exactly what
# SQL states; a model that doesn't see the weather can't.


def _figures(v, rows) -> DataFrame:
    flat = [(model, name, None if value is None else float(value)) for model, values in rows for name, value in values.items()]
    return rounded(v.spark.createDataFrame(flat, "model string, metric string, value double"), 3)


def _delay_parts(v) -> training.Parts:
    """All flights of both classes, none left out."""
    return training.delay_parts(v.planted(), on_time_share=1.0)


_LATE = "select case when WeatherDelay > 0 then 1 else 0 end as label, kind from planted_kinds where MaxPresentWeatherCode is not null and MinVisibility is not null"
# The area under ROC of the rule as a score.
_RULE_AUROC = f"""rule as (select round((sum(case when label = 1 then r end) - p * (p + 1) / 2) / (p * (n - p)), 3) as auroc
  from (select label, rank() over (order by kind) + (count(*) over (partition by kind) - 1) / 2.0 as r,
    sum(label) over () as p, count(*) over () as n from ({_LATE})) group by p, n)"""


def _rule_figures(*metrics: str) -> str:
    names = ", ".join(f"('{name}')" for name in metrics)
    return f"with {_RULE_AUROC} select 'with weather' as model, metric, auroc as value from rule cross join (values {names}) m(metric)"


def _without_weather(v, parts, kind, informed):
    """How much better a model ranks with weather, at most 0.2: what flights alone tell has no SQL. NULL if there are no flights."""
    alone = training.train_delay(parts, kind, False).metrics
    ahead = min(informed["auroc"] - alone["auroc"], 0.2) if informed and alone else None
    return ("with weather", {"ahead of flight only": ahead})


def _delay_figures(v, kind):
    parts = _delay_parts(v)
    informed = training.train_delay(parts, kind, True).metrics
    return _figures(v, [("with weather", informed), _without_weather(v, parts, kind, informed)])


_AHEAD = " union all select 'with weather', 'ahead of flight only', 0.2"


@query(_rule_figures("auroc", "auroc_hard_label") + _AHEAD)
def delay_forest_auc(v):
    return _delay_figures(v, "forest")


@query(_rule_figures("auroc", "auroc_hard_label", "training_auroc") + _AHEAD)
def delay_logistic_auc(v):
    return _delay_figures(v, "logistic")


@query("""select Year, Month, Day, Origin, Dest, UniqueCarrier, CRSDepHour, cast(case when kind > 0 then 1 else 0 end as double) as forest,
  cast(case when kind > 0 then 1 else 0 end as double) as logistic
from planted_kinds where MaxPresentWeatherCode is not null and MinVisibility is not null""")
def delay_predictions(v):
    """What both classifiers say of every flight, with delays of the parts that they were not fitted on included."""
    parts = _delay_parts(v)
    made = features.delay_examples(v.planted())
    for kind in ("forest", "logistic"):
        kept = made.columns
        made = training.train_delay(parts, kind).model.transform(made).withColumnRenamed("prediction", kind).select(*kept, kind)
    return made.select("Year", "Month", "Day", "Origin", "Dest", "UniqueCarrier", "CRSDepHour", "forest", "logistic")


@query(f"""with {_RULE_AUROC} select cast(case when auroc = 1 then 0 end as double) as fpr_at_all_delays,
  cast(case when auroc = 1 then 1 end as double) as tpr_at_no_alarm, cast(0 as double) as first_fpr, cast(1 as double) as last_tpr from rule""")
def logistic_roc_curve(v):
    """The corners of the training curve: the false alarms that all delays cost, and the delays found without any."""
    curve = evaluate.roc_curve(training.train_delay(_delay_parts(v), "logistic").model)
    corners = curve.agg(
        F.min(F.when(F.col("TPR") == 1, F.col("FPR"))).alias("fpr_at_all_delays"),
        F.max(F.when(F.col("FPR") == 0, F.col("TPR"))).alias("tpr_at_no_alarm"),
        F.min("FPR").alias("first_fpr"),
        F.max("TPR").alias("last_tpr"),
    )
    return rounded(corners.where(F.col("first_fpr").isNotNull()), 2)


@query(_rule_figures("auroc", "auroc_hard_label", "training_auroc", *(
    f"cv_auroc reg={reg} net={net}" for reg in models.GRID_REG_PARAM for net in models.GRID_ELASTIC_NET)))
def logistic_grid_search(v):
    return _figures(v, [("with weather", training.train_delay(_delay_parts(v), "grid").metrics)])


_BUCKETS = """case when WeatherDelay <= 12 then '1.Less than 12 Minutes' when WeatherDelay <= 25 then '2.Between 12 Minutes and 25 Minutes'
  when WeatherDelay <= 55 then '3.Between 25 Minutes and 55 Minutes' else '5.Beyond 55 minutes' end"""
# How often the kind of weather tells the bucket.
_BUCKET_HITS = f"""hits as (select avg(case when bucket = expected then 1.0 else 0.0 end) as accuracy from (
  select {_BUCKETS} as bucket, mode({_BUCKETS}) over (partition by kind) as expected from planted_kinds where WeatherDelay > 0))"""


def _bucket_figures_sql(column: str, *names: str) -> str:
    runs = ", ".join(f"('{name}')" for name in names)
    return f"""with {_BUCKET_HITS} select {column}, metric, case when metric = 'accuracy' then accuracy else 1 - accuracy end as value
from hits cross join (values {runs}) r({column}) cross join (values ('accuracy'), ('test_error')) m(metric)"""


@query(_bucket_figures_sql("model", "with weather", "with weather, 5 trees"))
def bucket_forest_accuracy(v):
    parts = training.bucket_parts(v.planted())
    runs = (("with weather", True, 10), ("with weather, 5 trees", True, 5))
    return _figures(
        v, [(name, training.train_buckets(parts, weather, trees).metrics) for name, weather, trees in runs]
    )


@query(f"""select Year, Month, Day, Origin, Dest, {_BUCKETS} as "delayCat",
  mode({_BUCKETS}) over (partition by kind) as "predictedLabel" from planted_kinds where WeatherDelay > 0""")
def bucket_predictions(v):
    """The predicted label of every delayed flight."""
    model = training.train_buckets(training.bucket_parts(v.planted())).model
    made = model.transform(features.bucket_examples(v.planted()))
    return made.select("Year", "Month", "Day", "Origin", "Dest", "delayCat", "predictedLabel")


@query(_bucket_figures_sql("run", "10 trees", "20 trees"))
def bucket_experiment_log(v):
    """Two experiments, whose models are saved and whose figures are read from the log table."""
    spark, database = v.spark, "ontime_metrics"
    catalog.ensure_database(spark, database, shared.new_folder(spark, database))
    log = f"{database}.runs_{uuid.uuid4().hex[:8]}"
    for trees, depth in ((10, 8), (20, 10)):
        path = shared.new_folder(spark, "model")
        training.bucket_experiment(spark, v.planted(), log, f"{trees} trees", trees, depth, path)
    return rounded(spark.table(log).select("run", "metric", "value"), 3)


@query("""with lines as (select log10(WeatherDelay) as y, avg(log10(WeatherDelay)) over (partition by MaxPresentWeatherCode) as guess,
  WeatherDelay as m from planted_kinds where WeatherDelay > 0 and MaxPresentWeatherCode is not null),
figures as (select sqrt(avg(pow(y - guess, 2))) as log_error, sqrt(avg(pow(m - pow(10, guess), 2))) as minute_error,
  1 - sum(pow(y - guess, 2)) / (var_pop(y) * count(*)) as r2 from lines)
select 'linear' as model, unnest(['rmse_log10', 'rmse_minutes', 'training_rmse', 'training_r2']) as metric,
  unnest([round(log_error, 1), round(minute_error, 0), round(log_error, 1), round(r2, 1)]) as value from figures""")
def minutes_linear_fit(v):
    """One code for each kind of weather, so the line through the codes' means fits. It is found by iteration: few digits are stated."""
    parts = training.minutes_parts(v.planted())
    made = _figures(v, [("linear", training.train_minutes(parts, "linear").metrics)])
    digits = F.when(F.col("metric") == "rmse_minutes", F.round("value", 0)).otherwise(F.round("value", 1))
    return made.withColumn("value", digits)


@query("""with lines as (select log10(WeatherDelay) as y, avg(log10(WeatherDelay)) over (partition by kind) as guess,
  WeatherDelay as m from planted_kinds where WeatherDelay > 0 and MaxPresentWeatherCode is not null),
figures as (select sqrt(avg(pow(y - guess, 2))) as log_error, sqrt(avg(pow(m - pow(10, guess), 2))) as minute_error from lines)
select 'forest' as model, unnest(['rmse_log10', 'rmse_minutes']) as metric,
  unnest([round(log_error, 1), round(minute_error, 0)]) as value from figures""")
def minutes_forest_fit(v):
    parts = training.minutes_parts(v.planted())
    made = _figures(v, [("forest", training.train_minutes(parts, "forest").metrics)])
    digits = F.when(F.col("metric") == "rmse_minutes", F.round("value", 0)).otherwise(F.round("value", 1))
    return made.withColumn("value", digits)


def _nearest_minutes(minutes: Column) -> Column:
    """The minutes of the planted rule that a prediction comes closest to, by ratio."""
    apart = [F.struct(F.abs(fn.log10_minutes(minutes) - math.log10(m)), F.lit(float(m))) for m in PLANTED_MINUTES if m]
    return F.when(minutes > 0, F.array_min(F.array(*apart))["col2"]).otherwise(0.0)


@query("""select Year, Month, Day, Origin, Dest, cast(round(pow(10, avg(log10(WeatherDelay)) over (partition by kind)), 0) as double) as linear,
  cast(round(pow(10, avg(log10(WeatherDelay)) over (partition by kind)), 0) as double) as forest
from planted_kinds where WeatherDelay > 0 and MaxPresentWeatherCode is not null""")
def minutes_predictions(v):
    """The predicted length of every delayed flight, as the planted length that it comes closest to."""
    parts = training.minutes_parts(v.planted())
    made = features.minutes_examples(v.planted())
    for kind in ("linear", "forest"):
        kept = made.columns
        made = training.train_minutes(parts, kind).model.transform(made)
        made = made.select(*kept, _nearest_minutes(fn.minutes_from_log10(F.col("prediction"))).alias(kind))
    return made.select("Year", "Month", "Day", "Origin", "Dest", "linear", "forest")


@query("""select kind, count(*) as flights, cast(sum(coalesce(MaxPrecipitation48, 9999)) filter (where MaxPrecipitation48 is null) as double) as filled_rain,
  cast(sum(coalesce(MinVisibility, 999999)) as bigint) as sight, cast(max(coalesce(MinVisibility, 999999)) as integer) as most_sight
from planted_kinds where WeatherDelay > 0 and MaxPresentWeatherCode is not null group by kind""")
def examples_with_unknown_weather(v):
    """Examples of delays with missing codes for unknown weather; an unknown code leaves a flight out."""
    made = features.minutes_examples(v.planted())
    kind = F.floor(F.col("MaxWindSpeed") / 100).cast("int").alias("kind")
    filled = F.col("MaxPrecipitation48") == schemas.MISSING["Precipitation48"]
    return made.groupBy(kind).agg(
        F.count("*").alias("flights"),
        F.sum(F.when(filled, F.col("MaxPrecipitation48"))).alias("filled_rain"),
        F.sum("MinVisibility").alias("sight"),
        F.max("MinVisibility").alias("most_sight"),
    )


# The least costs of k clusters on a line, by the same recursion in SQL: one step for each k.
_DELAY_COUNTS = """points as (select log, sum(n) as n, row_number() over (order by log) as i from (
  select coalesce(log10(case when WeatherDelay > 0 then WeatherDelay end), 0) as log, count(*) as n from hourly group by 1) group by log),
middle as (select sum(n * log) / sum(n) as m from points),
sums as (select i, sum(n) over (order by i) as w, sum(n * (log - m)) over (order by i) as x, sum(n * (log - m) * (log - m)) over (order by i) as xx
  from points, middle union all select 0, 0, 0, 0),
spans as (select a.i as first, b.i as last, greatest(b.xx - a.xx - (b.x - a.x) * (b.x - a.x) / (b.w - a.w), 0) as cost,
  m + (b.x - a.x) / (b.w - a.w) as centre from sums a join sums b on a.i < b.i, middle),
k1 as (select last, cost, [centre] as centres from spans where first = 0)"""
_STEPS = ", ".join(
    f"""k{k} as (select s.last, min(p.cost + s.cost) as cost, arg_min(list_append(p.centres, s.centre), p.cost + s.cost) as centres
  from spans s join k{k - 1} p on p.last = s.first group by s.last)"""
    for k in range(2, 10)
)
_LEAST = " union all ".join(f"select {k} as k, cost, centres from k{k} where last = (select max(i) from points)" for k in range(1, 10))
_CLUSTERS = f"with {_DELAY_COUNTS}, {_STEPS}, least as ({_LEAST})"


@query(f"{_CLUSTERS} select cast(k as integer) as k, round(cost, 4) as least_cost, true as close from least where k > 1")
def delay_elbow(v):
    """The least cost for each number of clusters, and whether k-means comes close to it and never below."""
    found = models.elbow(v.hourly()).join(models.exact_elbow(v.hourly()).withColumnRenamed("cost", "least_cost"), "k")
    ratio = F.col("cost") / F.col("least_cost")
    return rounded(found.select("k", "least_cost", ratio.between(1 - 1e-9, ELBOW_MARGIN).alias("close")), 4)


@query(f"""{_CLUSTERS} select cast(k as integer) as k, cast(unnest(generate_series(1, k)) as integer) as cluster,
  round(pow(10, unnest(centres)), 3) as minutes, true as close from least where k in (4, 5)""")
def delay_cluster_minutes(v):
    """The best centres of four and five clusters in minutes, and whether the centres of k-means cost about as little."""
    exact = models.exact_elbow(v.hourly()).where(F.col("k").isin(4, 5))
    costs = []
    for k in (4, 5):
        centres = [r.log10_value for r in models.cluster_minutes(models.fit_delay_clusters(v.hourly(), k), v.spark).collect()]
        costs.append(models.centre_cost(v.hourly(), centres).select(F.lit(k).alias("k"), F.col("cost").alias("found")))
    ratio = F.col("found") / F.col("cost")
    judged = exact.join(sampling.stack(*costs), "k").withColumn("close", ratio.between(1 - 1e-9, ELBOW_MARGIN))
    placed = judged.select("k", "close", F.posexplode("centres").alias("place", "log"))
    return rounded(placed.select("k", (F.col("place") + 1).alias("cluster"), fn.minutes_from_log10(F.col("log")).alias("minutes"), "close"), 3)


@query("""select r.FlightNum, r.request, cast(case when kind > 0 then 1 else 0 end as double) as predicted_delay,
  cast([0, 8, 20, 40, 100][kind + 1] as double) as minutes
from (select FlightNum, request, cast(split_part(request, ',', 8) as integer) // 100 as kind from planted_requests) r""")
def two_stage_scores(v):
    """Expected minutes of requests that name the weather, by a saved and loaded model of both stages."""
    classifier = training.train_delay(_delay_parts(v), "logistic").model
    regressor = training.train_minutes(training.minutes_parts(v.planted()), "forest").model
    path = shared.new_folder(v.spark, "model")
    catalog.save_model(score.two_stage(classifier, regressor), path)
    requests = score.fill_missing_weather(score.parse_requests(v.planted_requests()))
    scored = score.score_two_stage(requests, catalog.load_model(path))
    return scored.select("FlightNum", "request", "predicted_delay", _nearest_minutes(F.col("result")).alias("minutes"))


@query("select 'by ' || score as run, score as column, 'auroc' as metric, auroc as value from ("
       + _AUROC.format(score="score") + " union all " + _AUROC.format(score="prediction") + ")")
def metric_log(v):
    spark, database = v.spark, "ontime_metrics"
    catalog.ensure_database(spark, database, shared.new_folder(spark, database))
    table = f"{database}.runs_{uuid.uuid4().hex[:8]}"
    made = v.predictions()
    for score_name in ("score", "prediction"):
        metrics = {"auroc": evaluate.auroc(made, score_name)}
        catalog.log_metrics(spark, table, f"by {score_name}", {"column": score_name}, metrics)
    logged = spark.table(table)
    return rounded(logged.select("run", F.col("params")["column"].alias("column"), "metric", "value"))
