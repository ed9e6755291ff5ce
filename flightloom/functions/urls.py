"""The state of a map view in a URL's query, read and written as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags of what is shown, and those of a first view, which are not written.
FLAGS, FIRST_FLAGS = 9, "100100000"


def query_of(url: Column) -> Column:
    """What stands between the first question mark and the fragment; empty without one."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def parameter(query: Column, name: str) -> Column:
    """The first value of a parameter, decoded, null if it is not there. Escapes that are none stay as they are."""
    found = F.get(F.filter(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1) == name), F.lit(0))
    value = F.when(found.contains("="), F.regexp_extract(found, "^[^=]*=(.*)$", 1)).otherwise(F.when(found.isNotNull(), F.lit("")))
    return F.coalesce(F.try_url_decode(value), value)


def _leading(text: Column, pattern: str, kind: str) -> Column:
    """The number that a text begins with, whatever follows it."""
    return F.nullif(F.regexp_extract(text, rf"^\s*({pattern})", 1), F.lit("")).try_cast(kind)


_REAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def state(query: Column) -> Column:
    """struct(year, aircraft, selected, visible, lat, lng, zoom) of y, a, p, v, lat, lng and z.

    Empty values are null. Selected paths are those parts of p that begin with a whole number. Of six to nine flags those
    that are not written are off; any other number of them says nothing. Latitude and longitude count together and in
    range only; zoom is held within 1 to 18.
    """
    get = lambda name: F.nullif(parameter(query, name), F.lit(""))
    selected = F.filter(F.transform(F.split(get("p"), ","), lambda x: _leading(x, "[+-]?[0-9]+", "bigint")), lambda x: x.isNotNull())
    flags = get("v")
    visible = F.when(F.length(flags).between(6, FLAGS), F.rpad(F.regexp_replace(flags, "[^1]", "0"), FLAGS, "0"))
    lat, lng = _leading(get("lat"), _REAL, "double"), _leading(get("lng"), _REAL, "double")
    placed = lat.between(-90, 90) & lng.between(-180, 180)
    zoom = _leading(get("z"), _REAL, "double")
    return F.struct(
        get("y").alias("year"), get("a").alias("aircraft"), F.coalesce(selected, F.array().cast("array<bigint>")).alias("selected"), visible.alias("visible"),
        F.when(placed, lat).alias("lat"), F.when(placed, lng).alias("lng"), F.when(zoom.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(18.0), zoom))).alias("zoom"),
    )


def written(view: Column) -> Column:
    """The query that says a state(): the year whatever it is, no aircraft if it is all, no flags if they are the first ones."""
    pair = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), F.url_encode(value)))
    fixed = lambda value, digits: F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))
    return F.concat_ws(
        "&",
        pair("y", view["year"]), pair("a", F.nullif(view["aircraft"], F.lit("all"))), pair("p", F.array_join(F.transform(view["selected"], lambda x: x.cast("string")), ",")),
        pair("v", F.nullif(view["visible"], F.lit(FIRST_FLAGS))), pair("lat", fixed(view["lat"], 6)), pair("lng", fixed(view["lng"], 6)), pair("z", fixed(view["zoom"], 2)),
    )


def data_key(name: str, year: Column) -> Column:
    """The name under which a year's part of a dataset is kept and looked up."""
    return F.upper(F.replace(F.concat(F.lit(f"{name}_"), F.coalesce(year, F.lit("all"))), F.lit("-"), F.lit("_")))
