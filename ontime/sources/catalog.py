"""Catalog tables, saved models, the metric log and frames from values."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ontime import schemas
from ontime.operators.score import REQUEST

PARTITIONS = ["Year", "Month"]


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database if it is absent."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


_PART_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: What a task that writes an enriched table reads. It sorts its rows by month, and wide rows of few
#: different values take some fifteen times as much memory as their shuffle.
WRITTEN_AT_ONCE = "16MB"


@contextmanager
def _by_month(table: DataFrame) -> Iterator[DataFrameWriter]:
    """Writer of the table by year and month.

    Rebalancing brings a month together, so that it is not scattered over one
    small file per task, and AQE splits a month that is large, in parts of ``WRITTEN_AT_ONCE`` unless
    the session names a size.
    """
    conf = table.sparkSession.conf
    given = conf.get(_PART_SIZE, None)
    if given is None:
        conf.set(_PART_SIZE, WRITTEN_AT_ONCE)
    try:
        yield table.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS)
    finally:
        if given is None:
            conf.unset(_PART_SIZE)


def save_enriched(table: DataFrame, name: str) -> None:
    """Replace a catalog table, partitioned by year and month."""
    with _by_month(table) as writer:
        writer.saveAsTable(name)


def write_enriched(table: DataFrame, path: str) -> StructType:
    """The same as parquet files, without a catalog entry. Gives the columns that :func:`read_enriched` asks for."""
    with _by_month(table) as writer:
        writer.parquet(path)
    kept = [field for field in table.schema if field.name not in PARTITIONS]
    return StructType(kept + [table.schema[name] for name in PARTITIONS])


def read_enriched(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """What :func:`write_enriched` wrote. A table without rows has no file that could tell its columns."""
    return spark.read.schema(columns).parquet(path)


#: Join keys of weather by airport, hourly and daily.
WEATHER_KEYS = ["AirportCode", "Year", "Month", "Day"]


def save_weather(weather: DataFrame, name: str, buckets: int | None = None) -> None:
    """Replace a table of weather by airport, bucketed by the keys that flights join it on.

    Flights that are enriched from it are dealt to its buckets, and the weather stays where it is, however often it is
    used. ``buckets`` is the session's number of shuffle partitions unless given; with fewer than
    that, Spark deals both sides anew. A hot airport-hour isn't split, as it is between two
    shuffled sides, so use weather that isn't saved where one key holds a large part of the flights.
    """
    spark = weather.sparkSession
    keys = WEATHER_KEYS + [name for name in ("Hour",) if name in weather.columns]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One task for each bucket writes one file for it.
    dealt = weather.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def load_enriched(spark: SparkSession, name: str = schemas.HOURLY_TABLE) -> DataFrame:
    """A saved table."""
    return spark.table(name)


def drop_outputs(spark: SparkSession, database: str, tables: list[str], with_database: bool = False):
    """Drop the named tables, and the database only when asked to."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{table}`")
    if with_database:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}`")


def save_model(model: PipelineModel, path: str) -> None:
    """Save a model, replacing what is at the path."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def log_metrics(spark: SparkSession, table: str, run: str, params: dict, metrics: dict) -> None:
    """Append one row per metric of a run to a table; a figure that nothing was there for is NULL."""
    rows = [
        (run, {k: str(v) for k, v in params.items()}, name, None if value is None else float(value))
        for name, value in metrics.items()
    ]
    schema = "run string, params map<string,string>, metric string, value double"
    logged = spark.createDataFrame(rows, schema).withColumn("logged_at", F.current_timestamp())
    logged.write.mode("append").saveAsTable(table)


def request_frame(spark: SparkSession, requests: list[str]) -> DataFrame:
    """Scoring requests given as text, as one column ``request``."""
    return spark.createDataFrame([(text,) for text in requests], f"{REQUEST} string")
