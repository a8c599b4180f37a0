import pytest
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions import columns as fn
from ontime.operators import enrich, reports


def delays(spark, values):
    return spark.createDataFrame([(2006, v) for v in values], "Year int, WeatherDelay int")


def test_delay_by_year_and_totals(spark):
    table = spark.createDataFrame([(2007, 5), (2006, 0), (2006, 3), (2006, None), (None, 1)], "Year int, WeatherDelay int")
    assert [tuple(r) for r in reports.delay_by_year(table).collect()] == [(None, 1, 0, 1), (2006, 1, 1, 3), (2007, 1, 0, 1)]
    assert tuple(reports.delay_totals(table).first()) == (1, 3)
    assert tuple(reports.delay_totals(delays(spark, [None])).first()) == (None, None)
    assert reports.row_count(table).first().rows == 5


@pytest.mark.parametrize(
    "minutes, label",
    [(None, None), (-3, None), (0, "0.On Time Arrival"), (1, "1.Less than 12 Minutes"), (12, "1.Less than 12 Minutes"),
     (13, "2.Between 12 Minutes and 25 Minutes"), (25, "2.Between 12 Minutes and 25 Minutes"),
     (26, "3.Between 25 Minutes and 55 Minutes"), (55, "3.Between 25 Minutes and 55 Minutes"), (56, "5.Beyond 55 minutes")],
)
def test_delay_buckets(spark, minutes, label):
    row = reports.bucket_counts(delays(spark, [minutes]), on_time=schemas.ON_TIME_LABEL).first()
    assert tuple(row) == (label, 1)


def test_other_buckets_and_no_on_time_label(spark):
    counts = reports.bucket_counts(delays(spark, [0, 15, 16, 240, 241, None]), schemas.HOUR_BUCKETS)
    assert {r.bucket: r.flights for r in counts.collect()} == {
        None: 2, "1.Less than 15 Minutes": 1, "2.Between 15 Minutes and 1 Hour": 1, "4.Between 2 Hours and 4 Hours": 1, "5.Beyond 4 Hours": 1,
    }
    assert sum(r.flights for r in counts.collect()) == 6


def test_coverage_order(spark):
    table = spark.createDataFrame([(2006, 1), (2006, 2), (2006, 2), (2007, 1)], "Year int, Month int")
    assert [tuple(r) for r in reports.coverage(table, "Year", "Month").collect()] == [(2006, 2, 2), (2006, 1, 1), (2007, 1, 1)]


HAZARD = "Year int, Month int, DepDelay int, WeatherDelay int, Cancelled int, OriginFog int, OriginRain int, OriginSnow int, OriginHail int, OriginThunder int, OriginTornado int"


def test_hazard_reports(spark):
    rows = [
        (2006, 1, 10, 5, 0, 1, 0, 0, 0, 0, 0), (2006, 1, 10, 0, 0, 0, 1, 1, 0, 0, 0), (2006, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0),
        (2006, 1, 10, 5, 1, 1, 0, 0, 0, 0, 0), (2006, 1, 7, None, 0, 0, 0, 0, 0, 0, 0), (2006, 2, -1, 3, 0, 0, 0, 0, 0, 0, 0),
        (2006, 2, -1, 3, 0, 0, 0, 0, 0, 0, 0),
    ]
    table = spark.createDataFrame(rows, HAZARD)
    share = {r.Month: r for r in reports.hazard_share(table).collect()}
    assert (share[1].flights, share[1].delayed, share[1].weather_delayed) == (5, 3, 1)
    assert (share[1].pct_fog, share[1].pct_snow, share[1].pct_hail) == (33.0, 33.0, 0.0)
    assert share[2].pct_fog is None
    first, second = reports.hazard_rate(table).collect()
    assert (first.Month, second.Month) == (2, 1) and first.pct_fog is None
    assert (second.pct_fog, second.pct_snow, second.pct_hail) == (33.0, 100.0, None)
    assert reports.hazard_only(table, "Rain").count() == 0
    assert reports.hazard_only(table, "Fog").count() == 3


def test_filters(spark):
    assert reports.delayed(delays(spark, [None, 0, 1, -1])).count() == 1
    assert reports.on_time(delays(spark, [None, 0, 1, -1])).count() == 1
    assert reports.drop_null(delays(spark, [None, 0]), ["WeatherDelay"]).count() == 1
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("Month"))
    assert sorted(r.Month for r in reports.season(months, "winter").collect()) == [1, 2, 3, 10, 11]
    assert sorted(r.Month for r in reports.season(months, "summer").collect()) == [4, 5, 6, 7, 8, 9]
    conditions = "MaxWindSpeed int, MinCeilingHeight int, MinVisibility int, MaxPressure int, MaxPrecipitation48 double"
    rows = [(1, 1, 1, 1, 1.0), (9999, 1, 1, 1, 1.0), (1, 99999, 1, 1, 1.0), (1, 1, 999999, 1, 1.0), (1, 1, 1, 99999, 1.0),
            (1, 1, 1, 1, 9999.0), (None, 1, 1, 1, 1.0)]
    assert reports.valid_weather(spark.createDataFrame(rows, conditions)).count() == 1


def test_scalar_functions(spark):
    hours = spark.createDataFrame([(5,), (2359,), (2400,), (None,)], "CRSDepTime int")
    assert [r.CRSDepHour for r in enrich.with_departure_hour(hours).collect()] == [0, 23, 24, None]
    row = spark.range(1).select(
        fn.icao_to_airport(F.lit("KSFO")).alias("airport"), fn.to_int(F.lit("+0123")).alias("plus"), fn.to_int(F.lit("1x")).alias("bad"),
        fn.to_double(F.lit(" 1.5 ")).alias("double"), fn.or_zero(F.lit(None).cast("int")).alias("zero"),
        fn.log10_minutes(F.lit(0)).alias("log0"), fn.minutes_from_log10(F.lit(2.0)).alias("hundred"),
        fn.pct(F.lit(1), F.lit(8)).alias("pct"), fn.pct(F.lit(1), F.lit(0)).alias("none"),
        fn.flag(F.lit(False)).alias("no"), fn.flag(F.lit(False), else_null=True).alias("null"),
        fn.measure_if(F.lit(True), F.lit(7)).alias("seven"), fn.tail_after(F.lit("xAA1 b AA1"), "AA1").alias("tail"),
        fn.tail_after(F.lit("x"), "AA1").alias("absent"), fn.fixed(r"'ab\tcd '", 3, 4).alias("fixed"),
    ).first()
    assert tuple(row) == ("SFO", 123, None, 1.5, 0, None, 100.0, 13.0, None, 0, None, 7, "b AA1", None, "cd")
