"""Readers of station, weather and flight files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ontime import schemas
from ontime.operators.rejects import Counted, watched

_CORRUPT = "_corrupt_record"


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station catalogue from CSV with a header; a malformed value is NULL."""
    return spark.read.schema(schemas.STATION_SCHEMA).option("header", True).csv(path)


def read_isd_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Hourly weather lines, as one column ``value``."""
    return spark.read.text(glob)


def read_gsod_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Daily weather lines, as one column ``value``."""
    return spark.read.text(glob)


def read_flights(
    spark: SparkSession, glob: str, on_bad: str = "drop", quote: str | None = None, counted: Counted | None = None
) -> DataFrame:
    """Flights from CSV with a header; ``NA`` is NULL.

    A row with too few or too many values, or with text in an integer column,
    is bad. ``on_bad`` says whether it is dropped, kept with NULL for what
    cannot be read (and a column ``valid``), or fails the query.

    Spark's own DROPMALFORMED looks at the columns a query uses only, so a count
    and a full read of the same file can disagree. Here whole rows are split, and
    every integer column is read, whatever the query uses. ``quote`` replaces
    the usual double quote; an empty string turns quoting off. ``counted`` gets the number of rows and of bad ones.
    """
    schema = StructType.fromDDL(schemas.FLIGHT_SCHEMA)
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, IntegerType)]
    reader = (
        spark.read.schema(schema.add(_CORRUPT, StringType()))
        .option("header", True)
        .option("nullValue", schemas.FLIGHT_NULL_TEXT)
        .option("nanValue", schemas.FLIGHT_NULL_TEXT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("columnPruning", False)
    )
    if quote is not None:
        reader = reader.option("quote", quote)

    # Always true, but it makes each query read all the numbers.
    all_read = F.coalesce(F.greatest(*numbers), F.lit(0)) >= -(2**31)
    valid = F.col(_CORRUPT).isNull() & all_read
    rows = watched(reader.csv(glob), valid, counted)
    if on_bad == "drop":
        return rows.where(valid).drop(_CORRUPT)
    if on_bad == "keep":
        return rows.withColumn("valid", valid).drop(_CORRUPT)
    if on_bad == "fail":
        unreadable = F.raise_error(F.concat(F.lit("unreadable flight row: "), F.col(_CORRUPT)))
        return rows.where(F.when(valid, True).otherwise(unreadable)).drop(_CORRUPT)
    raise ValueError(f"on_bad must be 'drop', 'keep' or 'fail', not {on_bad!r}")
