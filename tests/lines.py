"""Hand-made weather lines."""


def isd_line(
    station="722950", wban="23174", date="20060102", hour="05", wind="0046", ceiling="22000",
    visibility="016093", temp="+0150", pressure="10132", extra="",
):
    line = f"0000{station}{wban}{date}{hour}".ljust(65, "x")
    line = (line + wind).ljust(70, "1") + ceiling
    line = line.ljust(78, "x") + visibility
    line = line.ljust(87, "x") + temp
    line = line.ljust(99, "x") + pressure
    return line + extra


def gsod_line(
    station="722950", wban="23174", date="20060102", temp="  55.5", visibility="  9.8", wind="  4.2",
    max_wind=" 12.0", precipitation=" 0.10", snow="999.9", flags="010000",
):
    line = f"{station} {wban}".ljust(14) + date
    line = line.ljust(24) + temp
    line = line.ljust(68) + visibility
    line = line.ljust(78) + wind
    line = line.ljust(88) + max_wind
    line = line.ljust(118) + precipitation
    line = line.ljust(125) + snow
    return line.ljust(132) + flags


def frame(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")
