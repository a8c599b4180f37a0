"""Record layouts, missing-value codes and labels.

Everything in this module is a fixed value: file layouts published with the
data sets, the codes those layouts use for "missing", and the names and labels
that downstream tables are expected to carry.
"""

# ---------------------------------------------------------------------------
# CSV layouts
# ---------------------------------------------------------------------------

STATION_SCHEMA = (
    "USAF int, WBAN int, StationN string, Country string, State string, ICAO string, "
    "Latitude double, Longtitude double, Elevation double, Begin string, End string"
)

FLIGHT_SCHEMA = (
    "Year int, Month int, DayOfMonth int, DayOfWeek int, DepTime int, CRSDepTime int, "
    "ArrTime int, CRSArrTime int, UniqueCarrier string, FlightNum string, TailNum string, "
    "ActualElaspedTime int, CRSElapsedTime int, AirTime int, ArrDelay int, DepDelay int, "
    "Origin string, Dest string, Distance int, TaxiIn int, TaxiOut int, Cancelled int, "
    "CancellationCode string, Diverted int, CarrierDelay int, WeatherDelay int, "
    "NASDelay int, SecurityDelay int, LateAircraftDelay int"
)

FLIGHT_NULL_TEXT = "NA"

# ---------------------------------------------------------------------------
# Fixed-width layouts, as name -> (first character, length),
# counting characters from 1
# ---------------------------------------------------------------------------

HOURLY_LINE_LENGTH = 104
HOURLY_FIELDS = {
    "StationNumber": (5, 6),
    "WBAN": (11, 5),
    "Year": (16, 4),
    "Month": (20, 2),
    "Day": (22, 2),
    "Hour": (24, 2),
    "WindSpeed": (66, 4),
    "CeilingHeight": (71, 5),
    "Visibility": (79, 6),
    "Temp": (88, 5),
    "Pressure": (100, 5),
}

DAILY_LINE_LENGTH = 138
DAILY_KEY_FIELDS = {
    "StationNumber": (1, 6),
    "WBAN": (8, 5),
    "Year": (15, 4),
    "Month": (19, 2),
    "Day": (21, 2),
}
DAILY_MEASURE_FIELDS = {
    "Temp": (25, 6),
    "Visibility": (69, 5),
    "WindSpeed": (79, 5),
    "MaxWindSpeed": (89, 5),
    "Precipitation": (119, 5),
    "SnowDepth": (126, 5),
}
DAILY_FLAG_FIELDS = {
    "Fog": (133, 1),
    "Rain": (134, 1),
    "Snow": (135, 1),
    "Hail": (136, 1),
    "Thunder": (137, 1),
    "Tornado": (138, 1),
}

PRECIPITATION_MARKER = "AA1"
PRESENT_WEATHER_MARKER = "AT1"

# ---------------------------------------------------------------------------
# Codes for "missing" and conversion constants
# ---------------------------------------------------------------------------

MISSING_STATION = 999999
MISSING_WBAN = "99999"
MISSING_PRECIPITATION_HOURS = 99
MISSING_PRECIPITATION_DEPTH = 9999
NO_PRESENT_WEATHER = "0"
MISSING = {
    "WindSpeed": 9999,
    "CeilingHeight": 99999,
    "Visibility": 999999,
    "Temp": 9999,
    "Pressure": 99999,
    "Precipitation48": 9999,
}

PRECIPITATION_WINDOW_HOURS = 48
INCHES_PER_MILLIMETRE = 0.0393700787

# ---------------------------------------------------------------------------
# Delay categories, as (largest minutes in the category, label)
# ---------------------------------------------------------------------------

ON_TIME_LABEL = "0.On Time Arrival"
QUARTILE_BUCKETS = [
    (12, "1.Less than 12 Minutes"),
    (25, "2.Between 12 Minutes and 25 Minutes"),
    (55, "3.Between 25 Minutes and 55 Minutes"),
    (None, "5.Beyond 55 minutes"),
]
HOUR_BUCKETS = [
    (15, "1.Less than 15 Minutes"),
    (60, "2.Between 15 Minutes and 1 Hour"),
    (120, "3.Between 1 Hour and 2 Hours"),
    (240, "4.Between 2 Hours and 4 Hours"),
    (None, "5.Beyond 4 Hours"),
]
COARSE_BUCKETS = [
    (15, "1.Less than 15 Minutes"),
    (120, "2.Between 15 Minutes and 2 Hour"),
    (None, "3.Beyond 2 Hours"),
]

# ---------------------------------------------------------------------------
# Seasons by month, table names, model inputs
# ---------------------------------------------------------------------------

SEASON_MONTHS = {
    "winter": (10, 11, 1, 2, 3),
    "summer": (4, 5, 6, 7, 8, 9),
}

HOURLY_TABLE = "flights_weatherhourly"
DAILY_TABLE = "flights_dailyweather"

FLIGHT_INPUTS = ["Month", "Day", "DayOfWeek", "CRSDepHour", "UniqueCarrier", "Origin", "Dest"]
WEATHER_INPUTS = [
    "MaxWindSpeed",
    "MinCeilingHeight",
    "MinVisibility",
    "MaxPressure",
    "MaxPrecipitation48",
    "MaxPresentWeatherCode",
]
WEATHER_INPUT_DEFAULTS = {
    "MaxWindSpeed": 9999,
    "MinCeilingHeight": 99999,
    "MinVisibility": 999999,
    "MaxPressure": 99999,
    "MaxPrecipitation48": 9999,
    "MaxPresentWeatherCode": "0",
}

# ---------------------------------------------------------------------------
# Names derived from the values above
# ---------------------------------------------------------------------------

HOURLY_MEASURES = list(MISSING)
DAILY_MEASURES = list(DAILY_MEASURE_FIELDS)
DAILY_FLAGS = list(DAILY_FLAG_FIELDS)
READING_KEYS = ["StationNumber", "WBAN", "Year", "Month", "Day", "Hour"]
DELAY_CAUSES = [
    "CarrierDelay",
    "WeatherDelay",
    "NASDelay",
    "SecurityDelay",
    "LateAircraftDelay",
]
ROLLUP_COLUMNS = [
    f"{stat}{measure}" for measure in HOURLY_MEASURES for stat in ("Max", "Min", "Distinct")
] + ["MaxPresentWeatherCode", "NumOfRec"]
