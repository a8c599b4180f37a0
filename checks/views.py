"""Station, weather and flight shaped views of the test tables.

The SQL text runs in Spark and in DuckDB alike. Every line item is both a
weather reading and a flight. Days fold to 1-7 and hours to 0-3 so that joins
hit; missing codes, malformed groups, unreadable lines, invalid ids and NULL
delays are planted.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ontime.operators.rejects import counting_session
from ontime.plans import pipelines
from ontime.schemas import FLIGHT_SCHEMA
from ontime.sources.catalog import read_enriched, write_enriched
from ontime.sources.files import read_gsod_lines, read_isd_lines
from ontime.sources.shared import new_folder

FX_STATIONS = """
select cast(case when s_suppkey % 10 = 3 then '999999'
                 when s_suppkey % 10 = 7 then concat('A', lpad(cast(s_suppkey as varchar(9)), 5, '0'))
                 else cast(700000 + s_suppkey as varchar(9)) end as varchar(9)) as USAF,
  case when n_nationkey % 5 = 4 then 'CA' else 'US' end as Country,
  case when s_suppkey % 13 = 12 then null
       else concat('K', lpad(cast(n_nationkey as varchar(9)), 3, '0')) end as ICAO
from {supplier} join {nation} on s_nationkey = n_nationkey
"""

FX_ISD_LINES = """
select case when l_partkey % 41 = 0 then substr(line, 1, 60) else line end as value
from (select l_partkey, concat('0000', cast(700000 + l_suppkey as varchar(40)),
  case when l_partkey % 17 = 0 then '99999' else lpad(cast(l_linenumber % 2 as varchar(40)), 5, '0') end,
  cast(year(l_shipdate) as varchar(40)), lpad(cast(month(l_shipdate) as varchar(40)), 2, '0'),
  lpad(cast(1 + day(l_shipdate) % 7 as varchar(40)), 2, '0'),
  case when l_partkey % 43 = 0 then 'xx' else lpad(cast(l_partkey % 4 as varchar(40)), 2, '0') end,
  lpad('', 40, 'x'),
  case when l_orderkey % 11 = 0 then '9999' else lpad(cast(l_orderkey % 200 as varchar(40)), 4, '0') end, '1',
  case when l_orderkey % 13 = 0 then '99999'
       else lpad(cast((l_orderkey * 37) % 22001 as varchar(40)), 5, '0') end, 'xxx',
  case when l_orderkey % 17 = 0 then '999999'
       else lpad(cast((l_orderkey * 53) % 160001 as varchar(40)), 6, '0') end, 'xxx',
  case when l_orderkey % 7 = 0 then '+9999'
       when l_orderkey % 400 < 100 then concat('-', lpad(cast(100 - l_orderkey % 400 as varchar(40)), 4, '0'))
       else concat('+', lpad(cast(l_orderkey % 400 - 100 as varchar(40)), 4, '0')) end, 'xxxxxxx',
  case when l_orderkey % 19 = 0 then '99999' else cast(10000 + l_orderkey % 400 as varchar(40)) end, '1ADD',
  case when l_partkey % 3 = 0 then ''
       when l_partkey % 29 = 0 then 'AA1zz000131'
       else concat('AA1', lpad(cast(l_partkey % 8 as varchar(40)), 2, '0'),
         case when l_partkey % 31 = 0 then 'q0q0' else lpad(cast(l_partkey % 60 as varchar(40)), 4, '0') end,
         '31') end,
  case when l_partkey % 5 = 0
       then concat('AT1AU01', case when l_partkey % 2 = 0 then 'RA  ' else 'FG  ' end, '1')
       else '' end) as line
from {lineitem}) as lines
"""

FX_GSOD_LINES = """
select case when l_partkey % 41 = 0 then substr(line, 1, 60) else line end as value
from (select l_partkey, concat(cast(case when l_partkey % 23 = 0 then 999999 else 700000 + l_suppkey end as varchar(40)),
  ' ', lpad(cast(l_linenumber % 2 as varchar(40)), 5, '0'), '  ',
  cast(year(l_shipdate) as varchar(40)), lpad(cast(month(l_shipdate) as varchar(40)), 2, '0'),
  lpad(cast(1 + day(l_shipdate) % 7 as varchar(40)), 2, '0'), '  ',
  lpad(cast(20 + l_orderkey % 70 as varchar(40)), 4, ' '), '.5', lpad('', 38, ' '),
  lpad(cast(l_orderkey % 10 as varchar(40)), 3, ' '), '.0', lpad('', 5, ' '),
  lpad(cast(l_partkey % 30 as varchar(40)), 3, ' '), '.2', lpad('', 5, ' '),
  case when l_orderkey % 9 = 0 then '999.9'
       else concat(lpad(cast(l_partkey % 30 + 5 as varchar(40)), 3, ' '), '.1') end, lpad('', 25, ' '),
  case when l_orderkey % 6 = 0 then '99.99'
       else concat(' ', cast(l_partkey % 4 as varchar(40)), '.25') end, '  ',
  case when l_orderkey % 5 <> 0 then '999.9'
       else concat(lpad(cast(l_partkey % 20 as varchar(40)), 3, ' '), '.0') end, '  ',
  case when l_partkey % 43 = 0 then 'x' else cast(l_orderkey % 2 as varchar(40)) end,
  cast(l_partkey % 2 as varchar(40)),
  case when l_partkey % 5 = 0 then '1' else '0' end, case when l_partkey % 50 = 0 then '1' else '0' end,
  case when l_partkey % 7 = 0 then '1' else '0' end,
  case when l_partkey % 97 = 0 then '1' else '0' end) as line
from {lineitem}) as lines
"""

_FLIGHTS = """
select cast(year(l_shipdate) as int) as Year, cast(month(l_shipdate) as int) as Month,
  cast(1 + day(l_shipdate) % 7 as int) as DayOfMonth, cast(1 + l_partkey % 7 as int) as DayOfWeek,
  cast((l_partkey % 4) * 100 + (l_orderkey + l_partkey) % 60 as int) as DepTime,
  cast(case when l_orderkey % 101 = 0 then 2400 else (l_partkey % 4) * 100 + l_orderkey % 60 end as int)
    as CRSDepTime,
  cast(case when l_orderkey % 50 = 0 then null else 600 + l_orderkey % 60 end as int) as ArrTime,
  cast(600 + l_partkey % 60 as int) as CRSArrTime,
  concat(l_returnflag, l_linestatus) as UniqueCarrier, cast(l_orderkey as varchar(20)) as FlightNum,
  case when l_partkey % 6 = 0 then 'NA' else concat('N', cast(l_suppkey as varchar(20))) end as TailNum,
  cast(90 + l_partkey % 40 as int) as ActualElaspedTime, cast(90 + l_orderkey % 40 as int) as CRSElapsedTime,
  cast(60 + l_partkey % 40 as int) as AirTime, cast(floor(l_quantity) - 12 as int) as ArrDelay,
  cast(floor(l_quantity) - 10 as int) as DepDelay,
  lpad(cast(s_nationkey as varchar(9)), 3, '0') as Origin,
  lpad(cast((s_nationkey + 7) % 25 as varchar(9)), 3, '0') as Dest,
  cast(100 + l_partkey % 2000 as int) as Distance, cast(l_partkey % 30 as int) as TaxiIn,
  cast(l_orderkey % 40 as int) as TaxiOut,
  cast(case when l_orderkey % 50 = 0 then 1 else 0 end as int) as Cancelled,
  case when l_orderkey % 50 = 0 then 'B' else null end as CancellationCode,
  cast(case when l_orderkey % 70 = 0 then 1 else 0 end as int) as Diverted,
  cast(case when l_orderkey % 9 = 0 then null else l_partkey % 15 end as int) as CarrierDelay,
  cast(case when l_orderkey % 9 = 0 then null else {weather_delay} end as int) as WeatherDelay,
  cast(case when l_orderkey % 9 = 0 then null else l_orderkey % 25 end as int) as NASDelay,
  cast(case when l_orderkey % 9 = 0 then null else 0 end as int) as SecurityDelay,
  cast(case when l_orderkey % 9 = 0 then null else l_partkey % 35 end as int) as LateAircraftDelay
from {lineitem} join {supplier} on l_suppkey = s_suppkey
"""

FX_FLIGHTS = _FLIGHTS.replace("{weather_delay}", "case when l_orderkey % 3 = 0 then l_partkey % 90 else 0 end")

# The planted rule: an airport-hour has one of five kinds of weather, a flight the delay of its kind. Kinds differ
# by a gap in each measure, and no value of a flight alone tells the kind.
_KIND = "greatest(0, (s_nationkey * 3 + month(l_shipdate) * 5 + (1 + day(l_shipdate) % 7) * 2 + l_partkey % 4) % 8 - 3)"
PLANTED_CODES = ["0", "FG", "RA", "SN", "TS"]
PLANTED_MINUTES = [0, 8, 20, 40, 100]


def _by_kind(kind: str, values: list) -> str:
    return f"case {kind} " + " ".join(f"when {k} then {value!r}" for k, value in enumerate(values)) + " end"


FX_PLANTED_FLIGHTS = _FLIGHTS.replace("{weather_delay}", _by_kind(_KIND, PLANTED_MINUTES))

FX_PLANTED_LINES = f"""
select concat('0000', cast(700000 + l_suppkey as varchar(40)), lpad(cast(l_linenumber % 2 as varchar(40)), 5, '0'),
  cast(year(l_shipdate) as varchar(40)), lpad(cast(month(l_shipdate) as varchar(40)), 2, '0'),
  lpad(cast(1 + day(l_shipdate) % 7 as varchar(40)), 2, '0'), lpad(cast(l_partkey % 4 as varchar(40)), 2, '0'),
  lpad('', 40, 'x'), lpad(cast(100 * kind + 10 + l_orderkey % 20 as varchar(40)), 4, '0'), '1',
  lpad(cast(20000 - 3000 * kind - l_orderkey % 100 as varchar(40)), 5, '0'), 'xxx',
  lpad(cast(150000 - 20000 * kind - l_orderkey % 500 as varchar(40)), 6, '0'), 'xxx', '+0100', 'xxxxxxx',
  cast(10300 - 60 * kind - l_orderkey % 20 as varchar(40)), '1ADD',
  'AA101', lpad(cast(10 * kind + l_orderkey % 4 as varchar(40)), 4, '0'), '31',
  case when kind = 0 then '' else concat('AT1AU01', {_by_kind("kind", PLANTED_CODES)}, '  1') end) as value
from (select *, {_KIND} as kind from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey) as readings
"""

# Weather that isn't known, as (column, which flights).
PLANTED_HOLES = [("MaxPrecipitation48", 11), ("MinVisibility", 13), ("MaxPresentWeatherCode", 17)]


# Station catalogue columns that the reader expects, from a row of fx_stations.
FX_STATION_FILE = """
select USAF, cast(length(ICAO) as varchar(9)) as WBAN, concat('station ', USAF) as StationN, Country,
  case when Country = 'US' then 'NY' else null end as State, ICAO, cast(10.5 as double) as Latitude,
  cast(-20.25 as double) as Longtitude, cast(3 as double) as Elevation, '19980101' as Begin,
  '20071231' as End
from {fx_stations}
"""

# A flight as a line of CSV: NULL as NA, some carriers quoted with a comma in
# them, some rows with a value too few, a value too many, or text for a number.
FX_FLIGHT_LINES = """
select concat_ws(',', cast(Year as varchar(9)), cast(Month as varchar(9)), cast(DayOfMonth as varchar(9)),
  cast(DayOfWeek as varchar(9)), cast(DepTime as varchar(9)), cast(CRSDepTime as varchar(9)),
  coalesce(cast(ArrTime as varchar(9)), 'NA'), cast(CRSArrTime as varchar(9)),
  case when DayOfWeek = 3 then concat('"', UniqueCarrier, ',x"') else UniqueCarrier end, FlightNum,
  coalesce(TailNum, 'NA'), cast(ActualElaspedTime as varchar(9)), cast(CRSElapsedTime as varchar(9)),
  cast(AirTime as varchar(9)), cast(ArrDelay as varchar(9)), cast(DepDelay as varchar(9)), Origin, Dest,
  case when AirTime = 62 then 'far' else cast(Distance as varchar(9)) end, cast(TaxiIn as varchar(9)),
  cast(TaxiOut as varchar(9)), cast(Cancelled as varchar(9)), coalesce(CancellationCode, 'NA'),
  cast(Diverted as varchar(9)), coalesce(cast(CarrierDelay as varchar(9)), 'NA'),
  coalesce(cast(WeatherDelay as varchar(9)), 'NA'), coalesce(cast(NASDelay as varchar(9)), 'NA'),
  coalesce(cast(SecurityDelay as varchar(9)), 'NA'),
  case when AirTime = 61 then null else coalesce(cast(LateAircraftDelay as varchar(9)), 'NA') end,
  case when AirTime = 60 then 'more' else null end) as line
from {fx_flights}
"""

# Scoring requests: two thirds name the weather as well.
FX_REQUESTS = """
select FlightNum, concat_ws(',', cast(Month as varchar(9)), cast(Day as varchar(9)),
  cast(DayOfWeek as varchar(9)), cast(CRSDepHour as varchar(9)), UniqueCarrier, Origin, Dest,
  case when CRSDepTime % 3 <> 0 then concat_ws(',', cast(MaxWindSpeed as varchar(9)),
    cast(MinCeilingHeight as varchar(9)), cast(MinVisibility as varchar(9)), cast(MaxPressure as varchar(9)),
    cast(cast(floor(MaxPrecipitation48) as int) as varchar(9)), MaxPresentWeatherCode) end) as request
from {hourly}
"""

# The same of planted flights, whose weather requests name; the delay model has seen no flight of unknown visibility or code.
FX_PLANTED_REQUESTS = """
select FlightNum, concat_ws(',', cast(Month as varchar(9)), cast(Day as varchar(9)),
  cast(DayOfWeek as varchar(9)), cast(CRSDepHour as varchar(9)), UniqueCarrier, Origin, Dest,
  cast(MaxWindSpeed as varchar(9)), cast(MinCeilingHeight as varchar(9)), cast(MinVisibility as varchar(9)),
  cast(MaxPressure as varchar(9)), cast(cast(floor(coalesce(MaxPrecipitation48, 9999)) as int) as varchar(9)),
  MaxPresentWeatherCode) as request
from {planted} where MinVisibility is not null and MaxPresentWeatherCode is not null
"""

# Delayed flights with a made-up class, score and prediction of log10 minutes.
FX_PREDICTIONS = """
select FlightNum, case when WeatherDelay > 25 then 1 else 0 end as label,
  cast(case when DepDelay > 15 then 1 else 0 end as double) as prediction,
  cast((DepDelay + 3 * TaxiOut + 100) % 50 as double) / 50 as score,
  WeatherDelay, cast(DepTime % 10 as double) / 5 as log_minutes
from {hourly} where WeatherDelay > 0
"""

# Raw files are compressed, as the archives that publish them do. Such a file can't be split, and Spark deals files by their bytes: parts are
# so short that what opening one counts for gives a task about as many lines as 128 MB of plain text.
_PACKED = {"compression": "gzip", "maxRecordsPerFile": 50_000}

# What this process wrote: (application, test folder, name) -> path and, of enriched tables, columns.
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType | None]] = {}


class Views:
    """The views over one folder of test tables.

    Weather lines, CSV files and enriched tables are written to the shared
    folder once per session and read back, as raw files and saved tables are:
    a parser then sees a text column, not the expression that made it, and a
    report reads the saved table.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder.rstrip("/")

    def counting(self) -> "Views":
        """The same views in a session that may count rows."""
        return Views(counting_session(self.spark), self._folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def _view(self, sql: str, *tables: str) -> DataFrame:
        return self.spark.sql(sql, **{name: self.table(name) for name in tables})

    def _written(self, name: str, write) -> tuple[str, StructType | None]:
        key = (self.spark.sparkContext.applicationId, self._folder, name)
        if key not in _WRITTEN:
            path = new_folder(self.spark, name)
            _WRITTEN[key] = (path, write(path))
        return _WRITTEN[key]

    def _once(self, name: str, write) -> str:
        return self._written(name, write)[0]

    def _saved(self, name: str, make) -> DataFrame:
        """The enriched table that ``make`` gives, written once and read back."""
        return read_enriched(self.spark, *self._written(name, lambda path: write_enriched(make(), path)))

    def stations(self) -> DataFrame:
        return self._view(FX_STATIONS, "supplier", "nation")

    def isd_file(self) -> str:
        """Path of the hourly weather lines."""
        return self._once("isd", self._view(FX_ISD_LINES, "lineitem").write.options(**_PACKED).text)

    def isd_lines(self) -> DataFrame:
        return read_isd_lines(self.spark, self.isd_file())

    def gsod_file(self) -> str:
        """Path of the daily weather lines."""
        return self._once("gsod", self._view(FX_GSOD_LINES, "lineitem").write.options(**_PACKED).text)

    def gsod_lines(self) -> DataFrame:
        return read_gsod_lines(self.spark, self.gsod_file())

    def flights(self) -> DataFrame:
        return self._view(FX_FLIGHTS, "lineitem", "supplier")

    def station_file(self) -> str:
        """Path of the station catalogue as CSV."""
        rows = self.spark.sql(FX_STATION_FILE, fx_stations=self.stations())
        return self._once("stations", lambda path: rows.write.csv(path, header=True))

    def flight_file(self) -> str:
        """Path of the flights as CSV, with unreadable rows."""
        lines = self.spark.sql(FX_FLIGHT_LINES, fx_flights=self.flights())
        header = ",".join(field.split()[0] for field in FLIGHT_SCHEMA.split(", "))
        # One column under a name that is the header; the separator never occurs.
        file = lines.withColumnRenamed("line", header)
        return self._once(
            "flights",
            lambda path: file.write.options(**_PACKED).csv(path, header=True, sep="\x01", quote="", escapeQuotes=False),
        )

    def hourly_flights(self) -> DataFrame:
        """The hourly pipeline, from raw inputs."""
        return pipelines.hourly_flights(self.stations(), self.isd_lines(), self.flights())

    def daily_flights(self) -> DataFrame:
        """The daily pipeline, from raw inputs."""
        return pipelines.daily_flights(self.stations(), self.gsod_lines(), self.flights())

    def hourly(self) -> DataFrame:
        """The saved table of flights with hourly weather."""
        return self._saved("hourly", self.hourly_flights)

    def daily(self) -> DataFrame:
        """The saved table of flights with daily weather."""
        return self._saved("daily", self.daily_flights)

    def planted_lines(self) -> DataFrame:
        lines = self._view(FX_PLANTED_LINES, "lineitem", "supplier")
        return read_isd_lines(self.spark, self._once("planted-isd", lines.write.options(**_PACKED).text))

    def _planted(self) -> DataFrame:
        flights = self._view(FX_PLANTED_FLIGHTS, "lineitem", "supplier")
        joined = pipelines.hourly_flights(self.stations(), self.planted_lines(), flights)
        unknown = {name: F.when(F.col("FlightNum").cast("bigint") % n != 0, F.col(name)) for name, n in PLANTED_HOLES}
        return joined.withColumns(unknown)

    def planted(self) -> DataFrame:
        """The saved table of flights whose delay follows the weather, with unknown weather."""
        return self._saved("planted", self._planted)

    def planted_requests(self) -> DataFrame:
        return self.spark.sql(FX_PLANTED_REQUESTS, planted=self.planted())

    def requests(self) -> DataFrame:
        return self.spark.sql(FX_REQUESTS, hourly=self.hourly())

    def timed_requests(self) -> DataFrame:
        """Requests next to the departure time of their flight."""
        timed = FX_REQUESTS.replace("select FlightNum", "select FlightNum, CRSDepTime", 1)
        return self.spark.sql(timed, hourly=self.hourly())

    def predictions(self) -> DataFrame:
        return self.spark.sql(FX_PREDICTIONS, hourly=self.hourly())
