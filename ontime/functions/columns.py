"""Column expressions shared by the operators.

Each helper takes and returns a ``Column``, so that everything built from them
stays inside whole-stage code generation and can be pruned and pushed down.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ontime import schemas

# Blanks as the record layouts understand them: space and control characters.
_BLANKS = "".join(chr(code) for code in range(33))


def strip(text: Column) -> Column:
    """Remove leading and trailing spaces and control characters."""
    return F.trim(text, F.lit(_BLANKS))


def fixed(line: str, start: int, length: int) -> Column:
    """The stripped text of a fixed-width field; ``start`` counts from 1."""
    return strip(F.expr(f"substring({line}, {start}, {length})"))


def fixed_int(line: str, start: int, length: int) -> Column:
    """A fixed-width integer field, NULL when it is not a number."""
    return F.expr(f"try_cast(substring({line}, {start}, {length}) as int)")


def fixed_double(line: str, start: int, length: int) -> Column:
    """A fixed-width decimal field, NULL when it is not a number."""
    return F.expr(f"try_cast(substring({line}, {start}, {length}) as double)")


def to_int(text: Column) -> Column:
    """Text to int; NULL rather than an error on malformed text."""
    return text.try_cast("int")


def to_double(text: Column) -> Column:
    """Text to double; NULL rather than an error on malformed text."""
    return text.try_cast("double")


def tail_after(line: Column, marker: str) -> Column:
    """Stripped text behind the first ``marker``, NULL where it is absent."""
    at = F.instr(line, marker)
    return F.when(at > 0, strip(F.substr(line, at + len(marker))))


def precipitation48(hours: Column, depth: Column, exact: bool = False) -> Column:
    """Precipitation scaled to 48 hours, in inches.

    The hourly rate is a whole number unless ``exact``: the division truncates.
    A zero period is read as an hourly reading.
    """
    missing = (hours == schemas.MISSING_PRECIPITATION_HOURS) | (
        depth == schemas.MISSING_PRECIPITATION_DEPTH
    )
    rate = F.try_divide(depth, hours)
    rate = rate if exact else rate.cast("int")
    per_hour = F.when(hours == 0, depth.cast("double")).otherwise(rate.cast("double"))
    scaled = per_hour * float(schemas.PRECIPITATION_WINDOW_HOURS) * schemas.INCHES_PER_MILLIMETRE
    return F.when(missing, float(schemas.MISSING["Precipitation48"])).otherwise(scaled)


def hhmm_to_hour(hhmm: Column) -> Column:
    """Hour of a clock time written as HHMM; 2400 gives 24."""
    return F.floor(hhmm / 100).cast("int")


def icao_to_airport(icao: Column) -> Column:
    """Airport code of a four-letter station call sign (``KSFO`` -> ``SFO``)."""
    return F.substring(icao, 2, 4)


def flag(condition: Column, else_null: bool = False) -> Column:
    """1 where the condition holds, otherwise 0 (or NULL)."""
    hit = F.when(condition, 1)
    return hit if else_null else hit.otherwise(0)


def measure_if(condition: Column, measure: Column) -> Column:
    """The measure where the condition holds, otherwise 0."""
    return F.when(condition, measure).otherwise(0)


def delay_bucket(minutes: Column, buckets=None, on_time: str | None = None) -> Column:
    """Label of the right-closed bucket that holds a positive delay.

    ``buckets`` is a list of (largest minutes, label), the last one open ended.
    ``on_time`` labels a delay of zero. NULL and negative delays get no label.
    """
    buckets = schemas.QUARTILE_BUCKETS if buckets is None else buckets
    closed = [(minutes <= top, label) for top, label in buckets if top is not None]
    opened = [(F.lit(True), label) for top, label in buckets if top is None]
    first, *rest = closed + opened
    positive = reduce(lambda case, arm: case.when(*arm), rest, F.when(*first))
    label = F.when(minutes > 0, positive)
    return label if on_time is None else label.when(minutes == 0, on_time)


def max_valid(measure: Column, missing) -> Column:
    """Largest value that is not the missing code, as an aggregate.

    The code itself comes back when every value is missing: it is larger than
    any reading, so the minimum then equals the code.
    """
    return F.coalesce(F.max(F.nullif(measure, F.lit(missing))), F.min(measure))


def code_to_number(code: Column) -> Column:
    """A code of up to four ASCII characters as a number of the same order; NULL for any other."""
    number = F.lit(0).cast("long")
    for place in range(1, 5):
        number = number * 256 + F.ascii(F.substring(code, place, 1))
    return F.when(code.rlike(r"^[\x01-\x7F]{0,4}$"), number)


def number_to_code(number: Column) -> Column:
    """The code that :func:`code_to_number` made a number of."""
    characters = []
    for shift in (24, 16, 8, 0):
        character = F.shiftright(number, shift).bitwiseAND(F.lit(255))
        characters.append(F.when(character > 0, F.char(character)).otherwise(F.lit("")))
    return F.when(number.isNotNull(), F.concat(*characters))


# Bits of a packed hour: nine each for month, day and hour, the year above them. Zero stands for NULL.
_PART_BITS, _PART_OFFSET, _NO_YEAR = 9, 256, -(2**31)


def pack_hour(year: str, month: str, day: str, hour: str) -> Column:
    """Four integer columns as one of 59 bits, NULL included; a part of more than two digits and a sign fails the query."""
    packed = F.coalesce(F.col(year), F.lit(_NO_YEAR)).cast("long")
    for name in (month, day, hour):
        small = F.abs(F.col(name)) < _PART_OFFSET
        part = F.when(F.col(name).isNull(), 0).when(small, F.col(name) + _PART_OFFSET)
        part = part.otherwise(F.raise_error(F.lit(f"{name} has too many digits")).cast("int"))
        packed = packed * (1 << _PART_BITS) + part
    return packed


def unpack_hour(packed: Column) -> list[Column]:
    """The columns that :func:`pack_hour` made one of: year, month, day, hour."""
    year = F.nullif(F.shiftright(packed, 3 * _PART_BITS).cast("int"), F.lit(_NO_YEAR))
    parts = [
        F.nullif(F.shiftright(packed, k * _PART_BITS).bitwiseAND((1 << _PART_BITS) - 1).cast("int") - _PART_OFFSET, F.lit(-_PART_OFFSET))
        for k in (2, 1, 0)
    ]
    return [year, *parts]


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def log10_minutes(minutes: Column) -> Column:
    """log10 of a positive delay, NULL otherwise."""
    return F.log10(minutes)


def minutes_from_log10(value: Column) -> Column:
    return F.pow(F.lit(10.0), value)


def pct(part: Column, whole: Column) -> Column:
    """Whole-number percentage, NULL when there is nothing to divide by."""
    return F.round(F.try_divide(part, whole) * 100)


def all_of(conditions) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def all_known(names: list[str]) -> Column:
    """Whether none of the named columns is NULL."""
    return F.expr(" and ".join(f"{name} is not null" for name in names))
