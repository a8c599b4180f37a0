"""Weather operators: fixed-width parsing, station choice, hourly roll-up."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontime import schemas
from ontime.functions.columns import (
    all_known,
    code_to_number,
    fixed,
    fixed_double,
    fixed_int,
    icao_to_airport,
    max_valid,
    number_to_code,
    pack_hour,
    precipitation48,
    tail_after,
    to_int,
    unpack_hour,
)
from ontime.operators.rejects import Counted

LINE = "value"
# Whether a line that is counted is good.
_GOOD = "line_is_good"


def _split_bad(fields: DataFrame, valid: Column, on_bad: str) -> DataFrame:
    if on_bad == "drop":
        return fields.where(valid)
    if on_bad == "keep":
        return fields.withColumn("valid", valid)
    if on_bad == "fail":
        unreadable = F.raise_error(F.concat(F.lit("unreadable weather line: "), F.col(LINE)))
        return fields.where(F.when(valid, True).otherwise(unreadable))
    raise ValueError(f"on_bad must be 'drop', 'keep' or 'fail', not {on_bad!r}")


def _tested(
    lines: DataFrame, fields: Callable[[DataFrame], DataFrame], valid: Column, counted: Counted | None
) -> tuple[DataFrame, Column]:
    """The lines with their fields, and the test of a line.

    Lines that are counted are tested first, up to the first field that isn't a number, and only good ones are read
    whole: text in a numeric field costs Spark an exception.
    """
    if counted is None:
        return fields(lines), valid
    tested = counted.watch(fields(lines).select(LINE, valid.alias(_GOOD)), F.col(_GOOD))
    return fields(tested), F.col(_GOOD)


def _precipitation_group() -> dict[str, Column]:
    """Hours (two characters) and depth (four) of the precipitation group."""
    group = F.col("precipitation_group")
    hours = F.coalesce(
        to_int(F.substring(group, 1, 2)), F.lit(schemas.MISSING_PRECIPITATION_HOURS)
    )
    depth = F.coalesce(
        F.when(F.length(group) >= 6, to_int(F.substring(group, 3, 4))),
        F.lit(schemas.MISSING_PRECIPITATION_DEPTH),
    )
    return {
        "PrecipitationHour": F.when(group.isNull(), 0).otherwise(hours),
        "Precipitation": F.when(group.isNull(), 0).otherwise(depth),
    }


def _present_weather() -> Column:
    """Four characters of code behind a prefix of four.

    A line cannot start with this group: a marker in first place is not one.
    """
    group = tail_after(F.col(LINE), schemas.PRESENT_WEATHER_MARKER)
    has_code = (F.instr(LINE, schemas.PRESENT_WEATHER_MARKER) > 1) & (F.length(group) >= 4)
    return F.when(has_code, F.rtrim(F.substring(group, 5, 4))).otherwise(
        schemas.NO_PRESENT_WEATHER
    )


def _with_fields(lines: DataFrame, fields: dict[str, Column]) -> DataFrame:
    kept = [LINE] + [_GOOD] * (_GOOD in lines.columns)
    return lines.select(*kept, *[column.alias(name) for name, column in fields.items()])


def _hourly_fields(lines: DataFrame) -> DataFrame:
    """Lines with their fixed fields; what is not a number is NULL."""
    fields = {
        name: (fixed if name == "WBAN" else fixed_int)(LINE, *place)
        for name, place in schemas.HOURLY_FIELDS.items()
    }
    return _with_fields(lines, fields)


def _hourly_valid() -> Column:
    numbers = [name for name in schemas.HOURLY_FIELDS if name != "WBAN"]
    plain_code = _present_weather().rlike(r"^[\x01-\x7F]*$")
    return (F.length(LINE) >= schemas.HOURLY_LINE_LENGTH) & all_known(numbers) & plain_code


def parse_isd(
    lines: DataFrame, on_bad: str = "drop", exact_rate: bool = False, counted: Counted | None = None
) -> DataFrame:
    """Hourly readings from fixed-width lines (column ``value``).

    A line that is too short, holds text in a numeric field or has a weather code
    with other than ASCII characters is bad: it is dropped, marked in a column ``valid``, or fails the query when it is
    reached. Readings without a WBAN are left out. ``counted`` gets the number of lines and of bad ones.
    """
    line = F.col(LINE)
    groups = {"precipitation_group": tail_after(line, schemas.PRECIPITATION_MARKER)}
    precipitation = precipitation48(F.col("PrecipitationHour"), F.col("Precipitation"), exact_rate)
    return (
        _split_bad(*_tested(lines, _hourly_fields, _hourly_valid(), counted), on_bad)
        .where(F.col("WBAN") != schemas.MISSING_WBAN)
        .withColumns(groups)
        .withColumns(_precipitation_group())
        .select(
            *schemas.HOURLY_FIELDS,
            "PrecipitationHour",
            "Precipitation",
            precipitation.alias("Precipitation48"),
            _present_weather().alias("PresentWeatherCode"),
            *["valid"] * (on_bad == "keep"),
        )
    )


def _daily_fields(lines: DataFrame) -> DataFrame:
    """Lines with their fixed fields; what is not a number is NULL."""
    keys = {
        name: (fixed if name == "WBAN" else fixed_int)(LINE, *place)
        for name, place in schemas.DAILY_KEY_FIELDS.items()
    }
    measures = {
        name: fixed_double(LINE, *place) for name, place in schemas.DAILY_MEASURE_FIELDS.items()
    }
    flags = {name: fixed_int(LINE, *place) for name, place in schemas.DAILY_FLAG_FIELDS.items()}
    fields = keys | measures | flags
    return _with_fields(lines, fields)


def _daily_valid() -> Column:
    numbers = ["StationNumber", "Year", "Month", "Day", *schemas.DAILY_MEASURES, *schemas.DAILY_FLAGS]
    return (F.length(LINE) >= schemas.DAILY_LINE_LENGTH) & all_known(numbers)


def parse_gsod(lines: DataFrame, on_bad: str = "drop", counted: Counted | None = None) -> DataFrame:
    """Daily summaries from fixed-width lines (column ``value``).

    Bad lines are treated as in :func:`parse_isd`. Lines without a station
    number are left out.
    """
    known = F.coalesce("StationNumber", F.lit(0)) != schemas.MISSING_STATION
    fields, valid = _tested(lines, _daily_fields, _daily_valid(), counted)
    return _split_bad(fields, valid, on_bad).where(known).drop(LINE, _GOOD)


def bad_rows(lines: DataFrame, kind: str = "hourly") -> DataFrame:
    """One row: how many lines there are and how many a parser would reject."""
    if kind == "hourly":
        fields, valid = _hourly_fields(lines), _hourly_valid()
    elif kind == "daily":
        fields, valid = _daily_fields(lines), _daily_valid()
    else:
        raise ValueError(f"kind must be 'hourly' or 'daily', not {kind!r}")
    return fields.agg(F.count("*").alias("lines"), F.count_if(~valid).alias("bad"))


def airports_from_stations(stations: DataFrame, country: str = "US") -> DataFrame:
    """One weather station per airport code: the largest station number.

    Stations without a usable number or call sign are left out. Duplicates do
    not matter to a maximum, so no DISTINCT precedes it.
    """
    return (
        stations.where(F.col("Country") == country)
        .select(
            icao_to_airport(F.col("ICAO")).alias("AirportCode"),
            to_int(F.col("USAF")).alias("StationNumber"),
        )
        .where(F.col("AirportCode").isNotNull())
        .where(F.col("StationNumber") != schemas.MISSING_STATION)
        .groupBy("AirportCode")
        .agg(F.max("StationNumber").alias("StationNumber"))
    )


def of_stations(lines: DataFrame, place: tuple[int, int], stations: DataFrame) -> DataFrame:
    """Lines whose station number, at ``place``, is among the stations': nothing else of the others is looked at.

    Spark would push a parser's test of whole lines below the join again; it doesn't push it through the explode.
    """
    near = lines.join(stations.select("StationNumber"), fixed_int(LINE, *place) == F.col("StationNumber"), "left_semi")
    return near.select(F.explode(F.array(LINE)).alias(LINE))


_TIME = ["Year", "Month", "Day", "Hour"]

# Numbers of the measures in the roll-up; the weather code comes last.
_CODE = len(schemas.HOURLY_MEASURES)


def _long_readings(readings: DataFrame, station: list[str]) -> DataFrame:
    """One row per station, hour, measure and different value, with its occurrences.

    ``slot`` is the packed hour with the measure's number in its last three bits.
    """
    values = [F.col(name).cast("double") for name in schemas.HOURLY_MEASURES]
    values.append(code_to_number(F.col("PresentWeatherCode")).cast("double"))
    hours = readings.select(*station, (pack_hour(*_TIME) * 8).alias("slot"), *[v.alias(f"v{k}") for k, v in enumerate(values)])
    pairs = [F.struct((F.col("slot") + k).alias("slot"), F.col(f"v{k}").alias("value")) for k in range(len(values))]
    long = hours.select(*station, F.inline(F.array(*pairs)))
    return long.groupBy(*station, "slot", "value").agg(F.count("*").alias("n"))


def rollup_hourly(readings: DataFrame, by_wban: bool = True) -> DataFrame:
    """One row per station (and WBAN) and hour.

    Maxima ignore missing codes unless there is nothing else; minima need no
    such care because every code is larger than any reading. With
    ``by_wban=False`` a station-hour has one row even if it reports under
    several WBANs.

    The first grouping leaves one row per different value. It is hashed on the
    value too, so a station-hour with very many readings is spread over all
    tasks, and every statistic follows from it, distinct counts included. What
    is left of a station-hour is bounded by the width of the fields, and comes
    together as narrow rows rather than as wide partial results: the hour and the measure are
    one number. Weather codes travel as numbers: text in an aggregate would make Spark sort, not hash.
    """
    station = [name for name in ("StationNumber", "WBAN") if by_wban or name != "WBAN"]
    at, measure = F.shiftright("slot", 3), F.pmod("slot", F.lit(8))
    statistics = []
    for number, name in enumerate(schemas.HOURLY_MEASURES):
        mine, kind = F.when(measure == number, F.col("value")), readings.schema[name].dataType
        statistics += [
            max_valid(mine, schemas.MISSING[name]).cast(kind).alias(f"Max{name}"),
            F.min(mine).cast(kind).alias(f"Min{name}"),
            F.count(mine).alias(f"Distinct{name}"),
        ]
    code = F.max(F.when(measure == _CODE, F.col("value"))).cast("long")
    return (
        _long_readings(readings, station)
        .repartition(*station, at)
        .groupBy(*station, at.alias("at"))
        .agg(
            *statistics,
            number_to_code(code).alias("MaxPresentWeatherCode"),
            F.sum(F.when(measure == _CODE, F.col("n"))).alias("NumOfRec"),
        )
        .select(*station, *[part.alias(name) for name, part in zip(_TIME, unpack_hour(F.col("at")))], *schemas.ROLLUP_COLUMNS)
    )
