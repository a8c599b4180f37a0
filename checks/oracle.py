"""DuckDB SQL for the registered queries, over the same test tables."""

import re

from checks import views

_NAMES = {name: name for name in ("lineitem", "supplier", "nation")}

# Building blocks, in order of use. Columns are quoted where DuckDB needs it.
_BLOCKS = {
    "fx_stations": views.FX_STATIONS.format(**_NAMES),
    "fx_isd_lines": views.FX_ISD_LINES.format(**_NAMES),
    "fx_gsod_lines": views.FX_GSOD_LINES.format(**_NAMES),
    "fx_flights": views.FX_FLIGHTS.format(**_NAMES),
    "airports": """
select substr(ICAO, 2, 4) as AirportCode, max(try_cast(USAF as integer)) as StationNumber
from fx_stations
where Country = 'US' and ICAO is not null and try_cast(USAF as integer) <> 999999
group by substr(ICAO, 2, 4)
""",
    "isd_split": """
select value, try_cast(substr(value, 5, 6) as integer) as StationNumber, trim(substr(value, 11, 5)) as WBAN,
  try_cast(substr(value, 16, 4) as integer) as Year, try_cast(substr(value, 20, 2) as integer) as Month,
  try_cast(substr(value, 22, 2) as integer) as Day, try_cast(substr(value, 24, 2) as integer) as Hour,
  try_cast(substr(value, 66, 4) as integer) as WindSpeed,
  try_cast(substr(value, 71, 5) as integer) as CeilingHeight,
  try_cast(substr(value, 79, 6) as integer) as Visibility,
  try_cast(substr(value, 88, 5) as integer) as Temp, try_cast(substr(value, 100, 5) as integer) as Pressure,
  case when strpos(value, 'AA1') > 0 then trim(substr(value, strpos(value, 'AA1') + 3)) end as aa,
  case when strpos(value, 'AT1') > 1 then trim(substr(value, strpos(value, 'AT1') + 3)) end as present
from fx_isd_lines
""",
    "isd_checked": """
select *, length(value) >= 104 and StationNumber is not null and Year is not null and Month is not null
  and Day is not null and Hour is not null and WindSpeed is not null and CeilingHeight is not null
  and Visibility is not null and Temp is not null and Pressure is not null as good,
  case when aa is null then 0 else coalesce(try_cast(substr(aa, 1, 2) as integer), 99) end as PrecipitationHour,
  case when aa is null then 0
       else coalesce(case when length(aa) >= 6 then try_cast(substr(aa, 3, 4) as integer) end, 9999) end
    as Precipitation,
  case when length(present) >= 4 then rtrim(substr(present, 5, 4)) else '0' end as PresentWeatherCode
from isd_split
""",
    "isd": """
select StationNumber, WBAN, Year, Month, Day, Hour, WindSpeed, CeilingHeight, Visibility, Temp, Pressure,
  PrecipitationHour, Precipitation,
  cast(case when PrecipitationHour = 99 or Precipitation = 9999 then 9999
       when PrecipitationHour = 0 then cast(Precipitation as double) * 48 * cast(0.0393700787 as double)
       else cast(Precipitation // PrecipitationHour as double) * 48 * cast(0.0393700787 as double) end as double)
    as Precipitation48,
  PresentWeatherCode
from isd_checked where good and WBAN <> '99999'
""",
    "hourly_rollup": """
select StationNumber, WBAN, Year, Month, Day, Hour,
  coalesce(max(nullif(WindSpeed, 9999)), 9999) as MaxWindSpeed, min(WindSpeed) as MinWindSpeed,
  count(distinct WindSpeed) as DistinctWindSpeed,
  coalesce(max(nullif(CeilingHeight, 99999)), 99999) as MaxCeilingHeight,
  min(CeilingHeight) as MinCeilingHeight, count(distinct CeilingHeight) as DistinctCeilingHeight,
  coalesce(max(nullif(Visibility, 999999)), 999999) as MaxVisibility, min(Visibility) as MinVisibility,
  count(distinct Visibility) as DistinctVisibility,
  coalesce(max(nullif(Temp, 9999)), 9999) as MaxTemp, min(Temp) as MinTemp,
  count(distinct Temp) as DistinctTemp,
  coalesce(max(nullif(Pressure, 99999)), 99999) as MaxPressure, min(Pressure) as MinPressure,
  count(distinct Pressure) as DistinctPressure,
  coalesce(max(nullif(Precipitation48, 9999)), 9999) as MaxPrecipitation48,
  min(Precipitation48) as MinPrecipitation48, count(distinct Precipitation48) as DistinctPrecipitation48,
  max(PresentWeatherCode) as MaxPresentWeatherCode, count(*) as NumOfRec
from isd group by StationNumber, WBAN, Year, Month, Day, Hour
""",
    "hourly_airport": """
select a.AirportCode, w.* exclude (StationNumber, WBAN)
from hourly_rollup w join airports a on w.StationNumber = a.StationNumber
""",
    "hourly": """
select f.Year, f.Month, f.DayOfMonth as Day, cast(floor(f.CRSDepTime / 100) as integer) as CRSDepHour,
  f.DayOfWeek, f.Origin, f.Dest, f.DepTime, f.CRSDepTime, f.ArrTime, f.CRSArrTime, f.UniqueCarrier,
  f.FlightNum, f.DepDelay, f.TaxiOut, f.Cancelled, f.CancellationCode, f.CarrierDelay, f.WeatherDelay,
  f.NASDelay, f.SecurityDelay, f.LateAircraftDelay, w.* exclude (AirportCode, Year, Month, Day, Hour)
from fx_flights f join hourly_airport w
  on f.Origin = w.AirportCode and f.Year = w.Year and f.Month = w.Month and f.DayOfMonth = w.Day
  and cast(floor(f.CRSDepTime / 100) as integer) = w.Hour
""",
    "gsod_split": """
select value, try_cast(substr(value, 1, 6) as integer) as StationNumber, trim(substr(value, 8, 5)) as WBAN,
  try_cast(substr(value, 15, 4) as integer) as Year, try_cast(substr(value, 19, 2) as integer) as Month,
  try_cast(substr(value, 21, 2) as integer) as Day,
  try_cast(trim(substr(value, 25, 6)) as double) as Temp,
  try_cast(trim(substr(value, 69, 5)) as double) as Visibility,
  try_cast(trim(substr(value, 79, 5)) as double) as WindSpeed,
  try_cast(trim(substr(value, 89, 5)) as double) as MaxWindSpeed,
  try_cast(trim(substr(value, 119, 5)) as double) as Precipitation,
  try_cast(trim(substr(value, 126, 5)) as double) as SnowDepth,
  try_cast(substr(value, 133, 1) as integer) as Fog, try_cast(substr(value, 134, 1) as integer) as Rain,
  try_cast(substr(value, 135, 1) as integer) as Snow, try_cast(substr(value, 136, 1) as integer) as Hail,
  try_cast(substr(value, 137, 1) as integer) as Thunder, try_cast(substr(value, 138, 1) as integer) as Tornado
from fx_gsod_lines
""",
    "gsod_checked": """
select *, length(value) >= 138 and StationNumber is not null and Year is not null and Month is not null
  and Day is not null and Temp is not null and Visibility is not null and WindSpeed is not null
  and MaxWindSpeed is not null and Precipitation is not null and SnowDepth is not null and Fog is not null
  and Rain is not null and Snow is not null and Hail is not null and Thunder is not null
  and Tornado is not null as good
from gsod_split
""",
    "gsod": "select * exclude (value, good) from gsod_checked where good and StationNumber <> 999999",
    "daily_airport": """
select a.AirportCode, w.* exclude (StationNumber, WBAN)
from gsod w join airports a on w.StationNumber = a.StationNumber
""",
    "daily": """
select f.Year, f.Month, f.DayOfMonth as Day, f.DayOfWeek, f.Origin, f.Dest, f.DepTime, f.CRSDepTime,
  f.ArrTime, f.CRSArrTime, f.UniqueCarrier, f.FlightNum, f.DepDelay, f.TaxiOut, f.Cancelled,
  f.CancellationCode, f.CarrierDelay, f.WeatherDelay, f.NASDelay, f.SecurityDelay, f.LateAircraftDelay,
  o.Temp as OriginTemp, o.Visibility as OriginVisibility, o.WindSpeed as OriginWindSpeed,
  o.MaxWindSpeed as OriginMaxWindSpeed, o.Precipitation as OriginPrecipitation,
  o.SnowDepth as OriginSnowDepth, o.Fog as OriginFog, o.Rain as OriginRain, o.Snow as OriginSnow,
  o.Hail as OriginHail, o.Thunder as OriginThunder, o.Tornado as OriginTornado,
  d.Temp as DestTemp, d.Visibility as DestVisibility, d.WindSpeed as DestWindSpeed,
  d.MaxWindSpeed as DestMaxWindSpeed, d.Precipitation as DestPrecipitation,
  d.SnowDepth as DestSnowDepth, d.Fog as DestFog, d.Rain as DestRain, d.Snow as DestSnow,
  d.Hail as DestHail, d.Thunder as DestThunder, d.Tornado as DestTornado
from fx_flights f
join daily_airport o on f.Origin = o.AirportCode and f.Year = o.Year and f.Month = o.Month
  and f.DayOfMonth = o.Day
join daily_airport d on f.Dest = d.AirportCode and f.Year = d.Year and f.Month = d.Month
  and f.DayOfMonth = d.Day
""",
    "valid_hourly": """
select * from hourly where MaxWindSpeed < 9999 and MinCeilingHeight < 99999 and MinVisibility < 999999
  and MaxPressure < 99999 and MaxPrecipitation48 < 9999
""",
    "fx_station_file": views.FX_STATION_FILE.format(fx_stations="fx_stations"),
    "fx_requests": views.FX_REQUESTS.format(hourly="hourly"),
    "fx_predictions": views.FX_PREDICTIONS.format(hourly="hourly"),
}


# The hourly chain once more, over the planted lines and flights.
_CHAIN = ["fx_isd_lines", "isd_split", "isd_checked", "isd", "hourly_rollup", "hourly_airport", "fx_flights", "hourly"]
_SOURCES = {"fx_isd_lines": views.FX_PLANTED_LINES, "fx_flights": views.FX_PLANTED_FLIGHTS}
for _name in _CHAIN:
    _text = _SOURCES[_name].format(**_NAMES) if _name in _SOURCES else _BLOCKS[_name]
    _BLOCKS[f"planted_{_name}"] = re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"planted_\1", _text)
# The joined tables without the flights that the file reader rejects.
_BLOCKS["file_flights"] = "select * from fx_flights where AirTime not in (60, 61, 62)"
for _name in ("hourly", "daily"):
    _BLOCKS[f"file_{_name}"] = re.sub(r"\bfx_flights\b", "file_flights", _BLOCKS[_name])
_HOLES = ", ".join(
    f"case when cast(FlightNum as bigint) % {n} <> 0 then {name} end as {name}" for name, n in views.PLANTED_HOLES
)
_BLOCKS["planted"] = f"select * replace ({_HOLES}) from planted_hourly"
_BLOCKS["planted_requests"] = views.FX_PLANTED_REQUESTS.format(planted="planted")
#: The kind of weather of each flight with a known delay, which the wind tells by its gaps.
_BLOCKS["planted_kinds"] = "select *, MaxWindSpeed // 100 as kind from planted where WeatherDelay >= 0"


def with_blocks(sql: str) -> str:
    """The statement behind the building blocks that it needs."""

    def names_in(text: str) -> list[str]:
        return [name for name in _BLOCKS if re.search(rf"\b{name}\b", text)]

    needed, queue = set(), names_in(sql)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += [other for other in names_in(_BLOCKS[name]) if other != name]
    blocks = [f"{name} as ({text})" for name, text in _BLOCKS.items() if name in needed]
    sql = sql.strip()
    rest = f", {sql[5:]}" if sql.startswith("with ") else f" {sql}"
    return "with " + ", ".join(blocks) + rest
