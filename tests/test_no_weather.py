"""Tables whose flights meet no weather: the airports' stations have numbers too long for a weather line."""

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import difference, duck
from checks.oracle import with_blocks
from checks.queries import QUERIES
from ontime import schemas
from ontime.operators import rejects, weather
from ontime.plans import pipelines
from ontime.sources import catalog
from tests.lines import frame, gsod_line, isd_line
from tests.test_sources import BAD, HEADER, flight_row, write

_TABLES = {
    "nation": "select cast(range as integer) as n_nationkey, 'N' || range as n_name, cast(0 as integer) as n_regionkey from range(25)",
    "supplier": """select s_suppkey, 'S' as s_name, cast(s_suppkey % 25 as integer) as s_nationkey, cast(0 as double) as s_acctbal
from (select range + far as s_suppkey from range(200), (values (0), (300000)) t(far))""",
    "lineitem": """select range as l_orderkey, range * 7 % 500 as l_partkey, range % 200 + far as l_suppkey, cast(range % 7 as integer) as l_linenumber,
  cast(range % 50 as double) as l_quantity, 'A' as l_returnflag, 'F' as l_linestatus, timestamp '1994-01-01' + to_days(cast(range % 400 as integer)) as l_shipdate
from range(1500), (values (0), (300000)) t(far)""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("far")
    for name, sql in _TABLES.items():
        duckdb.sql(f"copy ({sql}) to '{path}/{name}.parquet'")
    return str(path)


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("table, rows", [("fx_flights", 3000), ("isd", 1000), ("daily", 0), ("hourly", 0), ("planted", 0)])
def test_no_flight_meets_weather(con, table, rows):
    found = con.sql(with_blocks(f"select count(*) from {table}")).fetchall()[0][0]
    assert found >= rows if rows else found == 0


@pytest.mark.parametrize("name", ["hourly_table_from_files", "daily_table_from_files"])
def test_files_without_matches_are_counted(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None


@pytest.mark.parametrize("name", ["delay_by_year_daily", "delay_totals", "coverage_year", "hazard_box_stats", "request_rejects", "label_index"])
def test_saved_tables_without_rows_are_read(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None


_LEARNED = [
    "bucket_predictions", "bucket_forest_accuracy", "bucket_experiment_log", "delay_predictions", "logistic_roc_curve", "logistic_grid_search",
    "minutes_linear_fit", "minutes_forest_fit", "minutes_predictions", "two_stage_scores", "delay_elbow", "delay_cluster_minutes",
]


@pytest.mark.filterwarnings("ignore:no examples")
@pytest.mark.parametrize("name", _LEARNED)
def test_models_of_no_flights(spark, con, folder, name):
    assert difference(spark, con, folder, name) is None


@pytest.mark.filterwarnings("ignore:no examples")
@pytest.mark.parametrize("name", ["delay_logistic_auc", "delay_forest_auc"])
def test_no_flights_give_no_figures(spark, folder, name):
    """The SQL states a constant for the lead, whatever the tables hold; nothing is ahead of anything here."""
    assert [tuple(r) for r in QUERIES[name](spark, folder).collect()] == [("with weather", "ahead of flight only", None)]


def test_enriched_tables_read_as_they_were(spark, tmp_path):
    table = spark.range(4).select(
        F.lit(2006).alias("Year"), F.when(F.col("id") > 0, F.col("id")).cast("int").alias("Month"), F.lit("09").alias("Origin"), F.lit(1.5).alias("x")
    )
    for name, rows in (("some", table), ("none", table.where("Month > 12"))):
        path = str(tmp_path / name)
        back = catalog.read_enriched(spark, path, catalog.write_enriched(rows, path))
        assert back.dtypes == [("Origin", "string"), ("x", "double"), ("Year", "int"), ("Month", "int")]
        assert sorted(back.collect(), key=str) == sorted(rows.select(*back.columns).collect(), key=str)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize("station, country", [("700009", "US"), ("700001", "CA")])
@pytest.mark.parametrize("kind", ["hourly", "daily"])
def test_ingest_counts_what_meets_nothing(spark, tmp_path, kind, station, country, broadcast):
    stations = write(tmp_path / "stations.csv", "USAF,WBAN,S,C,S,I,L,L,E,B,E", f"{station},1,a,{country},NY,KAAA,1,1,1,1,1")
    line = isd_line if kind == "hourly" else gsod_line
    lines = write(tmp_path / "lines.txt", line(station="700001"), "short", line(station="700002"), line(station="700001", temp="  x  "))
    flights = write(tmp_path / "f.csv", HEADER, flight_row(), flight_row(Month="2"), *BAD[:3])
    database, threshold = "ontime_meets_nothing", "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, broadcast)
    try:
        assert pipelines.build_table(spark, database, stations, lines, flights, kind).count() == 0
        logged = {r.metric: r.value for r in spark.table(f"{database}.{pipelines.INGEST_LOG}").collect()}
        assert logged == {"weather_read": 4, "weather_rejected": 2, "flights_read": 5, "flights_rejected": 3}
    finally:
        spark.conf.unset(threshold)
        catalog.drop_outputs(spark, database, [schemas.HOURLY_TABLE, schemas.DAILY_TABLE, pipelines.INGEST_LOG], with_database=True)


def test_rows_that_spark_leaves_out_are_counted(spark):
    """In a session that leaves rows out, and below a limit that needs none."""
    for rows in (lambda t: t.join(t.sparkSession.range(0).select(F.lit("x").alias("UniqueCarrier")), "UniqueCarrier"), lambda t: t.limit(0)):
        seen = rejects.Counted("rows")
        table = spark.newSession().range(7).select(F.col("id").cast("string").alias("UniqueCarrier"))
        assert rows(rejects.watched(table, F.col("UniqueCarrier") > 2, seen)).count() == 0
        assert seen.metrics() == {"rows_read": 7, "rows_rejected": 3}


@pytest.mark.parametrize("on_bad", ["drop", "keep"])
@pytest.mark.parametrize("parse, line", [(weather.parse_isd, isd_line), (weather.parse_gsod, gsod_line)])
def test_counted_lines_parse_as_others(spark, parse, line, on_bad):
    lines = [line(), line(date="2006xx02"), "short", None]
    session, seen = rejects.counting_session(spark), rejects.Counted("weather")
    counted, plain = parse(frame(session, lines), on_bad, counted=seen), parse(frame(spark, lines), on_bad)
    assert counted.dtypes == plain.dtypes
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect()))
    assert seen.metrics() == {"weather_read": len(lines), "weather_rejected": len(lines) - 1}
