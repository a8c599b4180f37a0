import pytest
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions import columns as fn
from ontime.operators import rejects, weather
from tests.conftest import plan_of
from tests.lines import frame, gsod_line, isd_line


def parse_one(spark, extra="", **fields):
    return weather.parse_isd(frame(spark, [isd_line(extra=extra, **fields)])).first()


def test_hourly_fields(spark):
    row = parse_one(spark, temp="-0070")
    assert row.asDict() == {
        "StationNumber": 722950, "WBAN": "23174", "Year": 2006, "Month": 1, "Day": 2, "Hour": 5,
        "WindSpeed": 46, "CeilingHeight": 22000, "Visibility": 16093, "Temp": -70, "Pressure": 10132,
        "PrecipitationHour": 0, "Precipitation": 0, "Precipitation48": 0.0, "PresentWeatherCode": "0",
    }


@pytest.mark.parametrize(
    "group, hours, depth, inches",
    [
        ("", 0, 0, 0.0),
        ("AA106001231", 6, 12, 3.780),
        ("AA106000531", 6, 5, 0.0),
        ("AA100000531", 0, 5, 9.449),
        ("AA100000031", 0, 0, 0.0),
        ("AA199001231", 99, 12, 9999),
        ("AA106999931", 6, 9999, 9999),
        ("AA1zz001231", 99, 12, 9999),
        ("AA106q0q031", 6, 9999, 9999),
        ("AA106", 6, 9999, 9999),
        ("AA1", 99, 9999, 9999),
        ("AA1   06001231", 6, 12, 3.780),
        ("AA1\t06001231", 6, 12, 3.780),
    ],
)
def test_precipitation_group(spark, group, hours, depth, inches):
    row = parse_one(spark, "ADD" + group)
    assert (row.PrecipitationHour, row.Precipitation) == (hours, depth)
    assert round(row.Precipitation48, 3) == inches


def test_exact_rate(spark):
    lines = frame(spark, [isd_line(extra="AA106000531")])
    assert round(weather.parse_isd(lines, exact_rate=True).first().Precipitation48, 3) == 1.575


@pytest.mark.parametrize(
    "group, code",
    [
        ("", "0"),
        ("AT1AU01FG  1", "FG"),
        ("AT1AU01FGRA1", "FGRA"),
        ("AT1AU01RA", "RA"),
        ("AT1AU01", ""),
        ("AT1AU", "0"),
        ("AT1AU01RAxAT1AU01FG", "RAxA"),
    ],
)
def test_present_weather_group(spark, group, code):
    assert parse_one(spark, "ADD" + group).PresentWeatherCode == code


def test_marker_in_first_place_is_no_weather_group(spark):
    row = weather.parse_isd(frame(spark, ["AT1A" + isd_line()[4:]])).first()
    assert row.PresentWeatherCode == "0"


BAD = [isd_line()[:103], isd_line(hour="xx"), isd_line(wind="    "), isd_line(temp="+01.5"), "", isd_line(station="A00007")]


def test_bad_hourly_lines(spark):
    lines = frame(spark, [isd_line(), isd_line(wban="99999"), *BAD])
    assert weather.parse_isd(lines).count() == 1
    assert weather.bad_rows(lines).first().asDict() == {"lines": 8, "bad": 6}
    kept = weather.parse_isd(lines, on_bad="keep")
    assert {r.valid: r["count"] for r in kept.groupBy("valid").count().collect()} == {True: 1, False: 6}
    with pytest.raises(Exception, match="unreadable weather line"):
        weather.parse_isd(lines, on_bad="fail").collect()
    with pytest.raises(ValueError):
        weather.parse_isd(lines, on_bad="other")


def test_daily_fields_and_bad_lines(spark):
    lines = frame(
        spark,
        [gsod_line(), gsod_line(station="999999"), gsod_line()[:137], gsod_line(flags="01000x"), gsod_line(temp="   abc")],
    )
    (row,) = weather.parse_gsod(lines).collect()
    assert row.asDict() == {
        "StationNumber": 722950, "WBAN": "23174", "Year": 2006, "Month": 1, "Day": 2, "Temp": 55.5,
        "Visibility": 9.8, "WindSpeed": 4.2, "MaxWindSpeed": 12.0, "Precipitation": 0.1, "SnowDepth": 999.9,
        "Fog": 0, "Rain": 1, "Snow": 0, "Hail": 0, "Thunder": 0, "Tornado": 0,
    }
    assert weather.bad_rows(lines, "daily").first().asDict() == {"lines": 5, "bad": 3}
    assert weather.parse_gsod(lines, on_bad="keep").where("not valid").count() == 3


def test_parsing_stays_in_generated_code_and_prunes(spark, tmp_path):
    frame(spark, [isd_line()]).write.text(str(tmp_path / "isd"))
    plan = plan_of(weather.parse_isd(spark.read.text(str(tmp_path / "isd"))).select("Year", "Temp"))
    assert "Python" not in plan and "MapElements" not in plan and "DeserializeToObject" not in plan
    assert "AA1" not in plan  # the weather code is looked at, as it decides whether a line is bad


def test_airports(spark):
    rows = [
        ("700001", "US", "KAAA"), ("700002", "US", "KAAA"), ("700002", "US", "KBBB"), ("999999", "US", "KAAA"),
        ("A00007", "US", "KCCC"), ("700009", "CA", "KDDD"), ("700010", "US", None), (None, "US", "KEEE"),
    ]
    stations = spark.createDataFrame(rows, "USAF string, Country string, ICAO string")
    found = weather.airports_from_stations(stations).collect()
    assert sorted(map(tuple, found)) == [("AAA", 700002), ("BBB", 700002)]
    assert weather.airports_from_stations(stations, "CA").collect()[0].AirportCode == "DDD"


READING = (
    "StationNumber int, WBAN string, Year int, Month int, Day int, Hour int, WindSpeed int, CeilingHeight int, "
    "Visibility int, Temp int, Pressure int, Precipitation48 double, PresentWeatherCode string"
)


def reading(wban="1", hour=0, wind=1, temp=1, code="0", precipitation=0.0):
    return (7, wban, 2006, 1, 1, hour, wind, 99999, 10, temp, 20, precipitation, code)


def test_rollup_masks_missing_values(spark):
    rows = [
        reading(wind=9999, temp=-50, code="RA"), reading(wind=30, temp=9999, code="FG"), reading(wind=30, temp=-80),
        reading(hour=1, wind=9999), reading(hour=1, wind=None), reading(hour=2, wind=None, temp=-1, code=None),
        reading(wban="2", wind=70, code="ZZZZ", precipitation=9999.0),
    ]
    rollup = weather.rollup_hourly(spark.createDataFrame(rows, READING))
    by_key = {(r.WBAN, r.Hour): r for r in rollup.collect()}
    assert len(by_key) == 4
    first = by_key["1", 0]
    assert (first.MaxWindSpeed, first.MinWindSpeed, first.DistinctWindSpeed) == (30, 30, 2)
    assert (first.MaxTemp, first.MinTemp, first.DistinctTemp) == (-50, -80, 3)
    assert (first.MaxCeilingHeight, first.MinCeilingHeight, first.DistinctCeilingHeight) == (99999, 99999, 1)
    assert (first.MaxPresentWeatherCode, first.NumOfRec) == ("RA", 3)
    missing = by_key["1", 1]
    assert (missing.MaxWindSpeed, missing.MinWindSpeed, missing.DistinctWindSpeed, missing.NumOfRec) == (9999, 9999, 1, 2)
    unknown = by_key["1", 2]
    assert (unknown.MaxWindSpeed, unknown.MinWindSpeed, unknown.DistinctWindSpeed) == (None, None, 0)
    assert (unknown.MaxTemp, unknown.MaxPresentWeatherCode, unknown.NumOfRec) == (-1, None, 1)
    other = by_key["2", 0]
    assert (other.MaxPrecipitation48, other.MinPrecipitation48, other.MaxPresentWeatherCode) == (9999.0, 9999.0, "ZZZZ")


def test_rollup_without_wban(spark):
    rows = [reading(wban="1", wind=3), reading(wban="2", wind=5), reading(wban="2", wind=5)]
    (row,) = weather.rollup_hourly(spark.createDataFrame(rows, READING), by_wban=False).collect()
    assert (row.MaxWindSpeed, row.MinWindSpeed, row.DistinctWindSpeed, row.NumOfRec) == (5, 3, 2, 3)
    assert "WBAN" not in row


def test_rollup_hashes_on_values_before_keys(spark):
    plan = plan_of(weather.rollup_hourly(spark.createDataFrame([reading()], READING)))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    first, second = [line for line in reversed(plan.split("== Initial Plan ==")[-1].splitlines()) if "Exchange hashpartitioning" in line]
    assert "value#" in first and "slot#" in first and "value#" not in second


def test_rollup_reads_its_lines_once(spark, tmp_path):
    frame(spark, [isd_line()]).write.text(str(tmp_path / "lines"))
    plan = plan_of(weather.rollup_hourly(weather.parse_isd(spark.read.text(str(tmp_path / "lines")))))
    assert plan.split("== Initial Plan ==")[-1].count("FileScan text") == 1


def test_packed_hours_come_back(spark):
    parts = [None, -99, -9, 0, 1, 12, 31, 99, 255, -255]
    years = [None, -999, 0, 2006, 9999, 2**31 - 1, -(2**31) + 1]
    rows = [(y, m, d, h) for y in years for m in parts for d in parts[::3] for h in parts[1::4]]
    table = spark.createDataFrame(rows, "y int, m int, d int, h int").withColumn("at", fn.pack_hour("y", "m", "d", "h"))
    got = table.select("at", "y", "m", "d", "h", *[p.alias(n) for p, n in zip(fn.unpack_hour(F.col("at")), "YMDH")]).collect()
    assert all(tuple(r)[1:5] == tuple(r)[5:] for r in got) and len({r["at"] for r in got}) == len(rows)
    with pytest.raises(Exception, match="too many digits"):
        spark.createDataFrame([(2006, 1, 256, 1)], "y int, m int, d int, h int").select(fn.pack_hour("y", "m", "d", "h")).collect()


def test_rollup_of_odd_keys(spark):
    rows = [(7, None, 2006, None, -1, 0), (7, None, 2006, None, -1, 0), (None, "a", None, 1, 1, 99)]
    full = [(*key, 3, 4, 5, 6, 7, 1.0, "RA") for key in rows]
    got = sorted((r.asDict() for r in weather.rollup_hourly(spark.createDataFrame(full, READING)).collect()), key=str)
    assert {(r["StationNumber"], r["WBAN"], r["Year"], r["Month"], r["Day"], r["Hour"], r["NumOfRec"]) for r in got} == {(*rows[0], 2), (*rows[2], 1)}


def test_bad_lines_are_counted_as_they_are_parsed(spark):
    session = rejects.counting_session(spark)
    seen = rejects.Counted("weather")
    lines = frame(session, [isd_line(), isd_line(wind="00x6"), "short", isd_line(wban="99999")])
    assert weather.parse_isd(lines, counted=seen).count() == 1
    assert seen.metrics() == {"weather_read": 4, "weather_rejected": 2}
    daily = rejects.Counted("weather")
    weather.parse_gsod(frame(session, [gsod_line(), gsod_line(flags="01x000"), gsod_line(station="999999")]), counted=daily).collect()
    assert daily.metrics() == {"weather_read": 3, "weather_rejected": 1}


def test_rollup_of_a_hot_hour_matches_brute_force(spark):
    hot = spark.range(20_000).select(
        F.lit(7).alias("StationNumber"), F.lit("1").alias("WBAN"), F.lit(2006).alias("Year"),
        F.lit(1).alias("Month"), F.lit(1).alias("Day"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 24).cast("int").alias("Hour"),
        (F.col("id") * 7 % 1000).cast("int").alias("WindSpeed"), (F.col("id") * 11 % 5000).cast("int").alias("CeilingHeight"),
        (F.col("id") % 9000).cast("int").alias("Visibility"), (F.col("id") % 300 - 100).cast("int").alias("Temp"),
        (F.col("id") % 50).cast("int").alias("Pressure"), (F.col("id") % 4 * 1.5).alias("Precipitation48"),
        F.when(F.col("id") % 2 == 0, "RA").otherwise("FG").alias("PresentWeatherCode"),
    )
    data = hot.toPandas()
    want = data.groupby("Hour").agg(high=("WindSpeed", "max"), low=("Temp", "min"), n=("Visibility", "nunique"), rows=("Day", "size"))
    got = weather.rollup_hourly(hot).toPandas().set_index("Hour").sort_index()
    assert (got.MaxWindSpeed == want.high).all() and (got.MinTemp == want.low).all()
    assert (got.DistinctVisibility == want.n).all() and (got.NumOfRec == want.rows).all()
    assert schemas.ROLLUP_COLUMNS == [c for c in weather.rollup_hourly(hot).columns if c not in schemas.READING_KEYS]


def test_code_numbers_keep_order(spark):
    codes = ["", "0", "00", "FG", "FGRA", "RA", "RA01", "zzzz", None]
    table = spark.createDataFrame([(c,) for c in codes], "code string")
    made = table.select("code", fn.code_to_number(F.col("code")).alias("n"))
    rows = made.select("code", "n", fn.number_to_code(F.col("n")).alias("back")).collect()
    assert all(row.code == row.back for row in rows)
    known = [row for row in rows if row.code is not None]
    assert sorted(known, key=lambda r: r.n) == sorted(known, key=lambda r: r.code)
    wrong = spark.createDataFrame([("FGRA1",), ("é",), ("A\0BC",)], "code string")
    assert all(r.n is None for r in wrong.select(fn.code_to_number(F.col("code")).alias("n")).collect())


def test_max_valid(spark):
    table = spark.createDataFrame([(1, 9999), (1, 5), (2, 9999), (3, None)], "k int, x int")
    got = table.groupBy("k").agg(fn.max_valid(F.col("x"), 9999).alias("m"))
    assert {r.k: r.m for r in got.collect()} == {1: 5, 2: 9999, 3: None}


@pytest.mark.parametrize("code", ["é  ", "A\0BC"])
def test_odd_code_is_a_bad_line_and_stops_nothing(spark, code):
    lines = frame(spark, [isd_line(extra="AT1AU01" + code + "1"), isd_line(extra="AT1AU01RA  1")])
    assert weather.bad_rows(lines).first().asDict() == {"lines": 2, "bad": 1}
    rolled = weather.rollup_hourly(weather.parse_isd(lines)).collect()
    assert [r.MaxPresentWeatherCode for r in rolled] == ["RA"]
    kept = weather.parse_isd(lines, on_bad="keep")
    assert sorted(r.valid for r in kept.collect()) == [False, True]
