import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ontime import schemas
from ontime.operators import reports
from ontime.plans import pipelines
from ontime.sources import catalog, files, shared
from tests.conftest import plan_of
from tests.lines import gsod_line, isd_line

HEADER = ",".join(f.split()[0] for f in schemas.FLIGHT_SCHEMA.split(", "))


def flight_row(**values):
    row = dict(zip(HEADER.split(","), ["NA"] * 29))
    row |= {"Year": "2006", "Month": "1", "DayOfMonth": "2", "CRSDepTime": "500", "Origin": "AAA", "Dest": "CCC", "FlightNum": "1"}
    return ",".join((row | values).values())


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_stations_keep_malformed_values_as_null(spark, tmp_path):
    path = write(
        tmp_path / "stations.csv",
        "USAF,WBAN,STATION NAME,CTRY,STATE,ICAO,LAT,LON,ELEV(M),BEGIN,END",
        '700001,99999,"NAME, WITH COMMA",US,NY,KAAA,+10.5,-20.25,+3.0,19980101,20071231',
        "A00007,99999,OTHER,US,,KBBB,,,,19980101,20071231",
    )
    first, second = files.read_stations(spark, path).collect()
    assert (first.USAF, first.StationN, first.Latitude, first.Longtitude) == (700001, "NAME, WITH COMMA", 10.5, -20.25)
    assert (second.USAF, second.WBAN, second.ICAO, second.State, second.Elevation) == (None, 99999, "KBBB", None, None)


GOOD = [
    flight_row(), flight_row(FlightNum="2", WeatherDelay="12", UniqueCarrier='"C,C"'), flight_row(FlightNum="3", DepDelay="-5"),
    flight_row(FlightNum="4", TailNum="NA", Distance="+7"),
]
BAD = [
    flight_row(Distance="far"), flight_row() + ",more", flight_row().rsplit(",", 1)[0], flight_row(AirTime="1.5"),
    flight_row(TaxiIn=" 5"), flight_row(TaxiOut="99999999999"), flight_row(Year=""),
]


def test_flights_drop_bad_rows_whatever_is_selected(spark, tmp_path):
    for name, rows in (("a.csv", GOOD[:2] + BAD[:3]), ("b.csv", GOOD[2:] + BAD[3:6])):
        write(tmp_path / name, HEADER, *rows)
    table = files.read_flights(spark, str(tmp_path / "*.csv"))
    rows = {r.FlightNum: r for r in table.collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]
    assert (rows["2"].UniqueCarrier, rows["2"].WeatherDelay, rows["1"].WeatherDelay) == ("C,C", 12, None)
    assert (rows["3"].DepDelay, rows["4"].TailNum, rows["4"].Distance) == (-5, None, 7)
    assert table.count() == 4
    assert table.select("Origin").count() == len(table.select("Origin").collect()) == 4
    assert reports.coverage(table, "Year").first().rows == 4
    assert ", ".join(f"{n} {t}" for n, t in table.dtypes) == schemas.FLIGHT_SCHEMA


def test_flights_keep_and_fail(spark, tmp_path):
    path = write(tmp_path / "flights.csv", HEADER, *GOOD, *BAD[:6])
    kept = files.read_flights(spark, path, on_bad="keep")
    assert kept.where("valid").count() == 4 and kept.where("not valid").count() == 6
    with pytest.raises(Exception, match="unreadable flight row"):
        files.read_flights(spark, path, on_bad="fail").collect()
    good = write(tmp_path / "good.csv", HEADER, *GOOD)
    assert files.read_flights(spark, good, on_bad="fail").count() == 4
    with pytest.raises(ValueError):
        files.read_flights(spark, good, on_bad="other")


def test_empty_number_is_null(spark, tmp_path):
    path = write(tmp_path / "flights.csv", HEADER, flight_row(ArrDelay=""))
    assert files.read_flights(spark, path).first().ArrDelay is None


def test_quote_can_be_turned_off(spark, tmp_path):
    path = write(tmp_path / "flights.csv", HEADER, flight_row(UniqueCarrier='"CC"'), flight_row(UniqueCarrier='"C,C"'))
    assert [r.UniqueCarrier for r in files.read_flights(spark, path).collect()] == ["CC", "C,C"]
    assert [r.UniqueCarrier for r in files.read_flights(spark, path, quote="").collect()] == ['"CC"']


def test_build_tables_from_files(spark, tmp_path):
    stations = write(
        tmp_path / "stations.csv", "USAF,WBAN,S,C,S,I,L,L,E,B,E", "700001,1,a,US,NY,KAAA,1,1,1,1,1", "700002,1,a,US,NY,KCCC,1,1,1,1,1"
    )
    write(tmp_path / "isd-1.txt", isd_line(station="700001"), "short")
    write(tmp_path / "isd-2.txt", isd_line(station="700001", date="20060202"), isd_line(station="700002"))
    write(tmp_path / "gsod_1.txt", gsod_line(station="700001"), gsod_line(station="700002"))
    flights = write(tmp_path / "f.csv", HEADER, flight_row(), flight_row(Month="2"), flight_row(Month="2", Origin="CCC"), BAD[0])
    database = "ontime_test"
    try:
        made = pipelines.build_table(spark, database, stations, str(tmp_path / "isd-*.txt"), flights)
        assert [tuple(r) for r in made.collect()] == [(2006, 1, 1), (2006, 2, 1)]
        saved = catalog.load_enriched(spark, f"{database}.{schemas.HOURLY_TABLE}")
        assert saved.columns[-2:] == ["Year", "Month"]
        winter = plan_of(reports.season(saved, "winter"))
        assert re.search(r"PartitionFilters: \[Month#\d+ IN \(", winter)
        daily = pipelines.build_table(spark, database, stations, str(tmp_path / "gsod_*.txt"), flights, kind="daily")
        assert [tuple(r) for r in daily.collect()] == [(2006, 1, 1)]
        logged = {(r.run.split("_")[-1], r.metric): r.value for r in spark.table(f"{database}.{pipelines.INGEST_LOG}").collect()}
        assert logged == {
            ("weatherhourly", "weather_read"): 4, ("weatherhourly", "weather_rejected"): 1, ("weatherhourly", "flights_read"): 4, ("weatherhourly", "flights_rejected"): 1,
            ("dailyweather", "weather_read"): 2, ("dailyweather", "weather_rejected"): 0, ("dailyweather", "flights_read"): 4, ("dailyweather", "flights_rejected"): 1,
        }
        # A second run replaces the table.
        assert pipelines.build_table(spark, database, stations, str(tmp_path / "isd-*.txt"), flights).count() == 2
        with pytest.raises(ValueError):
            pipelines.build_table(spark, database, stations, "x", flights, kind="weekly")
    finally:
        catalog.drop_outputs(spark, database, [schemas.HOURLY_TABLE, schemas.DAILY_TABLE, pipelines.INGEST_LOG], with_database=True)
    assert not spark.catalog.databaseExists(database)


def test_reports_read_two_columns_only(spark, tmp_path):
    table = spark.range(10).select(
        F.lit(2006).alias("Year"), F.lit(1).alias("Month"), F.col("id").alias("WeatherDelay"), F.lit("x").alias("Origin")
    )
    catalog.write_enriched(table, str(tmp_path / "t"))
    plan = plan_of(reports.delay_by_year(spark.read.parquet(str(tmp_path / "t"))))
    assert "ReadSchema: struct<WeatherDelay:bigint>" in plan
    pushed = plan_of(reports.delayed(spark.read.parquet(str(tmp_path / "t"))).select("Origin"))
    assert "GreaterThan(WeatherDelay,0)" in pushed


class Session:
    """As much of a session as the choice of the shared folder looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=lambda: None)


def test_shared_folder_follows_the_setting():
    cluster = Session("hdfs://disk/shared/", "yarn")
    first, second = shared.new_folder(cluster, "x"), shared.new_folder(cluster, "x")
    assert first != second and first.startswith("hdfs://disk/shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(None, "yarn"))


def test_materialize(spark):
    table = shared.materialize(spark.range(5), "five")
    assert table.count() == 5 and "FileScan parquet" in plan_of(table)
    assert shared.shared_folder(spark) == shared.shared_folder(spark)


def test_metric_log_appends(spark):
    database = "ontime_log_test"
    catalog.ensure_database(spark, database)
    try:
        catalog.log_metrics(spark, f"{database}.runs", "a", {"trees": 10}, {"accuracy": 0.5, "error": 0.5})
        catalog.log_metrics(spark, f"{database}.runs", "b", {"trees": 20}, {"accuracy": 0.75})
        rows = spark.table(f"{database}.runs").collect()
        assert sorted((r.run, r.params["trees"], r.metric, r.value) for r in rows) == [
            ("a", "10", "accuracy", 0.5), ("a", "10", "error", 0.5), ("b", "20", "accuracy", 0.75),
        ]
    finally:
        catalog.drop_outputs(spark, database, ["runs"], with_database=True)


@pytest.mark.parametrize("named", [None, "64MB"])
def test_large_months_are_written_in_short_parts(spark, tmp_path, named):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    noise = [F.rand(k).alias(f"x{k}") for k in range(8)]
    table = spark.range(0, 400_000, 1, 4).select("id", F.lit(2006).alias("Year"), F.lit(1).alias("Month"), *noise)
    if named:
        spark.conf.set(size, named)
    try:
        catalog.write_enriched(table, str(tmp_path / "t"))
        assert spark.conf.get(size, None) == named
    finally:
        spark.conf.unset(size)
    files = list((tmp_path / "t" / "Year=2006" / "Month=1").glob("*.parquet"))
    assert len(files) == 1 if named else len(files) > 1
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.count_distinct("id")).first()[0] == 400_000
