"""Names: aircraft file names, ICAO codes, airports and routes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom.constants import ICAO_REGIONS, MARKER_PATTERN


def aircraft_from_filename(filename: Column) -> Column:
    """struct(registration, type, route, format) of N_REG_TYPE or DATE_TIME_REG_ROUTE names; null for others."""
    parts = F.split(F.replace(filename, F.lit(".kml"), F.lit("")), "_")
    raw = parts[1]
    numbered_reg = F.when(raw.startswith("D") & (F.length(raw) > 1), F.concat(F.lit("D-"), F.substring(raw, 2, 1000))).otherwise(raw)
    none = F.lit(None).cast("string")
    numbered = F.struct(numbered_reg.alias("registration"), parts[2].alias("type"), none.alias("route"), F.lit("numbered").alias("format"))
    charter = F.struct(F.get(parts, F.lit(2)).alias("registration"), none.alias("type"), F.nullif(F.get(parts, F.lit(3)), F.lit("")).alias("route"), F.lit("charterware").alias("format"))
    return F.when((F.size(parts) == 3) & parts[0].rlike(r"^\d+$"), numbered).when((F.size(parts) >= 4) & parts[0].contains("-"), charter)


def icao_codes(name: Column) -> Column:
    """Words of four capitals that begin with the letter of a region, in order."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\b([A-Z]{4})\b"), F.lit(1))
    return F.filter(found, lambda c: F.lit(ICAO_REGIONS).contains(F.substring(c, 1, 1)))


def is_marker(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) == "") | name.rlike(MARKER_PATTERN)


def route_ends(name: Column) -> tuple[Column, Column]:
    """Start and end of `A - B` with exactly two parts, else nulls."""
    parts = F.split(name, " - ")
    two = F.size(parts) == 2
    return F.when(two, F.trim(F.get(parts, F.lit(0)))), F.when(two, F.trim(F.get(parts, F.lit(1))))


def display_name(name: Column, at_end: bool) -> Column:
    """The airport of a route's start or end, if it holds a code or several words; markers and `Unknown` give null."""
    start, end = route_ends(name)
    one = F.coalesce(end if at_end else start, name)
    bad = F.coalesce(name, F.lit("")).isin("", "Airport", "Unknown") | name.rlike(r"^(Log Start|Takeoff|Landing|Log Stop):\s*.+$")
    kept = (one != "Unknown") & (one.rlike(r"\b[A-Z]{4}\b") | one.rlike(r"\S\s+\S"))
    return F.when(~bad & kept, one)


def clean_airport(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(" Airport"), F.lit("")), F.lit(" Airfield"), F.lit(""))


def label(name: Column) -> Column:
    """The first word of four capitals, else APT."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\b([A-Z]{4})\b", 1), F.lit("")), F.lit("APT"))


def flag(country: Column) -> Column:
    """The two regional indicator letters of an ISO code of two letters."""
    code = F.upper(country)
    return F.when(code.rlike("^[A-Z]{2}$"), F.concat(*[_letter(F.substring(code, i, 1)) for i in (1, 2)]))


def _letter(c: Column) -> Column:
    return F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(c) + F.lit(0xA6 - 65)))), "UTF-8")


def country_name(name: Column, code: Column) -> Column:
    """A country's name if one is known for its code, else the code, else `Unknown`."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.upper(F.trim(code)), F.lit("")), F.lit("Unknown"))
