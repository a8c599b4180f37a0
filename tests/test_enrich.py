from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ontime import schemas
from ontime.operators import enrich
from ontime.plans import pipelines
from ontime.sources import catalog
from tests.conftest import final_plan_of, plan_of
from tests.lines import frame, gsod_line, isd_line


def flights(spark, rows):
    """Flights from (day, hhmm, origin, dest); other columns are NULL."""
    names = [f.split()[0] for f in schemas.FLIGHT_SCHEMA.split(", ")]
    given = {"Year": 2006, "Month": 1}
    full = []
    for day, hhmm, origin, dest in rows:
        values = given | {"DayOfMonth": day, "CRSDepTime": hhmm, "Origin": origin, "Dest": dest}
        full.append(tuple(values.get(name) for name in names))
    return spark.createDataFrame(full, schemas.FLIGHT_SCHEMA)


def stations(spark, rows):
    return spark.createDataFrame(rows, "USAF string, Country string, ICAO string")


STATIONS = [("700001", "US", "KAAA"), ("700001", "US", "KBBB"), ("700002", "US", "KCCC"), ("700003", "CA", "KDDD")]


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def large_tables(spark):
    """No table counts as small, as on real data."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, off):
        yield


@pytest.fixture
def small_skew_limits(spark, large_tables):
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    with settings(spark, small):
        yield


def test_hourly_join_keys_and_fan_out(spark):
    lines = frame(
        spark,
        [
            isd_line(station="700001", wban="00001", hour="05"), isd_line(station="700001", wban="00002", hour="05"),
            isd_line(station="700002", hour="23"), isd_line(station="700003", hour="05"),
        ],
    )
    data = flights(
        spark,
        [(2, 559, "AAA", "CCC"), (2, 500, "BBB", "CCC"), (2, 459, "AAA", "CCC"), (3, 500, "AAA", "CCC"),
         (2, 2359, "CCC", "AAA"), (2, 2400, "CCC", "AAA"), (2, 5, "CCC", "AAA"), (2, 500, "DDD", "AAA"), (2, None, "AAA", "CCC")],
    )
    joined = pipelines.hourly_flights(stations(spark, STATIONS), lines, data)
    got = sorted((r.Origin, r.CRSDepTime, r.CRSDepHour) for r in joined.collect())
    assert got == [("AAA", 559, 5), ("AAA", 559, 5), ("BBB", 500, 5), ("BBB", 500, 5), ("CCC", 2359, 23)]
    assert joined.columns == (
        "Year Month Day CRSDepHour DayOfWeek Origin Dest DepTime CRSDepTime ArrTime CRSArrTime UniqueCarrier FlightNum "
        "DepDelay TaxiOut Cancelled CancellationCode CarrierDelay WeatherDelay NASDelay SecurityDelay LateAircraftDelay"
    ).split() + schemas.ROLLUP_COLUMNS
    single = enrich.enrich_hourly(data, pipelines.hourly_weather(stations(spark, STATIONS), lines, by_wban=False))
    assert sorted((r.Origin, r.CRSDepTime) for r in single.collect()) == [("AAA", 559), ("BBB", 500), ("CCC", 2359)]


def test_daily_join_uses_weather_in_two_roles(spark):
    lines = frame(
        spark,
        [gsod_line(station="700001", temp="  10.0"), gsod_line(station="700002", temp="  20.0", flags="100001"),
         gsod_line(station="700002", date="20060103")],
    )
    data = flights(spark, [(2, 500, "AAA", "CCC"), (2, 500, "CCC", "BBB"), (3, 500, "AAA", "CCC"), (2, 500, "AAA", "DDD")])
    joined = pipelines.daily_flights(stations(spark, STATIONS), lines, data)
    got = sorted((r.Origin, r.Dest, r.OriginTemp, r.DestTemp, r.OriginFog, r.DestTornado) for r in joined.collect())
    assert got == [("AAA", "CCC", 10.0, 20.0, 0, 1), ("CCC", "BBB", 20.0, 10.0, 1, 0)]


def test_daily_weather_is_prepared_once(spark, tmp_path, large_tables):
    frame(spark, [gsod_line(station="700001"), gsod_line(station="700002")]).write.text(str(tmp_path / "gsod"))
    lines = spark.read.text(str(tmp_path / "gsod"))
    data = flights(spark, [(2, 500, "AAA", "CCC")])
    plan = final_plan_of(pipelines.daily_flights(stations(spark, STATIONS), lines, data))
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("kind", ["hourly", "daily"])
def test_flights_are_not_dealt_to_meet_little_weather(spark, kind):
    join, line = {"hourly": (pipelines.hourly_flights, isd_line), "daily": (pipelines.daily_flights, gsod_line)}[kind]
    lines = frame(spark, [line(station="700001"), line(station="700002")])
    joined = join(stations(spark, STATIONS), lines, flights(spark, [(2, 500, "AAA", "CCC")]))
    plan = final_plan_of(joined)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan_of(joined)
    assert joined.count() == 1


def test_airports_are_broadcast_behind_a_check(spark):
    table = spark.range(100).withColumnRenamed("id", "StationNumber")
    assert "broadcast" in enrich.small_side(table, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in enrich.small_side(table, 99)._jdf.queryExecution().logical().toString().lower()


def test_same_result_without_the_broadcast(spark, monkeypatch, large_tables):
    lines = frame(spark, [isd_line(station="700001"), isd_line(station="700002")])
    usual = pipelines.hourly_weather(stations(spark, STATIONS), lines)
    assert plan_of(usual).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan_of(usual)
    monkeypatch.setattr(enrich, "small_side", lambda table: table)
    shuffled = pipelines.hourly_weather(stations(spark, STATIONS), lines)
    assert "SortMergeJoin" in plan_of(shuffled)
    assert sorted(shuffled.collect()) == sorted(usual.collect())


@pytest.mark.parametrize("kind", ["hourly", "daily"])
def test_saved_weather_stays_where_it_is(spark, tmp_path, large_tables, kind):
    """Flights are dealt to the buckets; the weather side has no exchange, however often it is used."""
    make, line, join = {
        "hourly": (pipelines.hourly_weather, isd_line, enrich.enrich_hourly), "daily": (pipelines.daily_weather, gsod_line, enrich.enrich_daily),
    }[kind]
    made = make(stations(spark, STATIONS), frame(spark, [line(station="700001"), line(station="700002")]))
    database = f"ontime_buckets_{kind}"
    catalog.ensure_database(spark, database, str(tmp_path / "buckets"))
    try:
        catalog.save_weather(made, f"{database}.weather")
        saved = spark.table(f"{database}.weather")
        data = flights(spark, [(2, 500, "AAA", "CCC"), (2, 510, "BBB", "AAA"), (2, 500, "DDD", "AAA"), (3, 500, "AAA", "AAA")])
        joined = join(data, saved)
        plan = final_plan_of(joined)
        sides = plan.count("FileScan parquet")
        assert sides == {"hourly": 1, "daily": 2}[kind] and plan.count("Bucketed: true") == sides
        for branch in plan.split("FileScan parquet")[:-1]:
            above = branch.splitlines()[-6:]
            assert not any("Exchange" in text for text in above)
        assert sorted(joined.collect(), key=str) == sorted(join(data, made).collect(), key=str) and joined.count() == 2
    finally:
        catalog.drop_outputs(spark, database, ["weather"], with_database=True)


def test_hot_airport_hour_is_split(spark, small_skew_limits):
    """A third of all flights in one airport-hour does not end in one task."""
    columns = [f.split() for f in schemas.FLIGHT_SCHEMA.split(", ")]
    key = {
        "Year": F.lit(2006), "Month": F.lit(1), "Origin": F.concat(F.lit("A"), F.col("spread") % 50),
        "DayOfMonth": F.col("spread") % 28 + 1, "CRSDepTime": F.col("spread") % 24 * 100, "FlightNum": F.sha2(F.col("id").cast("string"), 256),
    }
    spread = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    data = spark.range(0, 30_000, 1, 8).withColumn("spread", spread).select(
        *[key.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns]
    )
    air = spark.range(50 * 28 * 24).select(
        F.concat(F.lit("A"), F.col("id") % 50).alias("AirportCode"), F.lit(2006).alias("Year"), F.lit(1).alias("Month"),
        (F.floor(F.col("id") / 50) % 28 + 1).cast("int").alias("Day"), (F.floor(F.col("id") / 1400)).cast("int").alias("Hour"),
        *[F.lit(1).alias(c) for c in schemas.ROLLUP_COLUMNS],
    )
    joined = enrich.enrich_hourly(data, air)
    plan = final_plan_of(joined)
    assert "skew=true" in plan and "AQEShuffleRead coalesced and skewed" in plan
    assert joined.count() == 30_000


def test_readings_without_airport_go_before_the_rollup(spark):
    plan = plan_of(pipelines.hourly_weather(stations(spark, STATIONS), frame(spark, [isd_line()])))
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.index("LeftSemi") > plan.rindex("HashAggregate(keys=[StationNumber")


@pytest.mark.parametrize("kind", ["hourly", "daily"])
def test_lines_without_airport_go_before_they_are_parsed(spark, monkeypatch, kind):
    made, line = {"hourly": (pipelines.hourly_weather, isd_line), "daily": (pipelines.daily_weather, gsod_line)}[kind]
    good = [line(station=s) for s in ("700001", "700002", "700003", "700009", "999999")]
    lines = frame(spark, [*good, line(station="700001", wban="99999"), line(station=" 70000"), line(station="7000x1"), good[0][:60], "", None])
    early = made(stations(spark, STATIONS), lines)
    plan = plan_of(early).split("== Initial Plan ==")[-1]
    assert plan.rindex("(length(value") < plan.index("LeftSemi")
    monkeypatch.setattr(enrich, "small_side", lambda table: table)
    late = made(stations(spark, STATIONS), lines)
    assert "LeftSemi" not in plan_of(late) or kind == "hourly"
    assert {r.AirportCode for r in early.collect()} == {"AAA", "BBB", "CCC"}
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
