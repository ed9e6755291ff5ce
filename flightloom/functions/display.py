"""Values behind the map's colours, sizes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom.constants import KM_PER_NM, METERS_TO_FEET

#: Red, green and blue at the start and the end of each fifth of the range.
ALTITUDE_RAMP = (((80, 0), (160, 255), (255, 255)), ((0, 0), (255, 255), (255, 0)), ((0, 255), (255, 255), (0, 0)), ((255, 255), (255, 165.75), (0, 0)), ((255, 255), (165, 66), (0, 66)))
SPEED_RAMP = (((0, 0), (128, 255), (255, 255)), ((0, 0), (255, 255), (255, 0)), ((0, 255), (255, 255), (0, 0)), ((255, 255), (255, 127.5), (0, 0)), ((255, 255), (128, 0), (0, 0)))


def half_up(x: Column) -> Column:
    """Rounds halves up, towards the larger number."""
    return F.floor(x + 0.5)


def ramp(value: Column, low: Column, high: Column, bands=ALTITUDE_RAMP) -> Column:
    """`rgb(r,g,b)` of a value within a range, through bands that each cover a fifth of it."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.greatest(high - low, F.lit(1.0))))
    band = F.least(F.floor(share * 5), F.lit(4)).cast("int")
    t = share * 5 - band
    ends = F.array(*[F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in colours]) for colours in bands])
    parts = [half_up(ends[band][k][0] + (ends[band][k][1] - ends[band][k][0]) * t).cast("string") for k in range(3)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))


def to_rgba(rgb: Column, opacity: float) -> Column:
    return F.concat(F.lit("rgba("), F.regexp_extract(rgb, r"\((.*)\)", 1), F.lit(f",{opacity})"))


def segment_style(selected: Column, any_selected: Column) -> Column:
    """struct(weight, opacity) of a segment on the map."""
    return F.struct(F.when(selected, 6).otherwise(4).alias("weight"), F.when(selected, 1.0).when(any_selected, 0.1).otherwise(0.85).alias("opacity"))


def airport_opacity(count: Column, most: Column) -> Column:
    return F.when(most == 0, 1.0).otherwise(0.3 + count / most * 0.7)


def airport_size(count: Column, most: Column) -> Column:
    return F.when(most == 0, 3.0).otherwise(3.0 + count / most * 5.0)


def auto_zoom(altitude: Column, speed: Column) -> Column:
    """Zoom 10 to 16: further out, the higher and faster, measured against 5000 and 100."""
    factor = (F.least(altitude / 5000, F.lit(2.0)) + F.least(speed / 100, F.lit(2.0))) / 2
    return F.greatest(F.lit(10), F.least(F.lit(16), half_up(16 - factor * 3))).cast("int")


def zoom_class(zoom: Column) -> Column:
    return F.when(zoom >= 14, "xlarge").when(zoom >= 12, "large").when(zoom >= 10, "medium").when(zoom >= 8, "medium-small").when(zoom >= 6, "small").otherwise("")


def fleet_class(flights: Column, low: Column, high: Column) -> Column:
    """Quartile of an aircraft's flights between the fleet's least and most; `high` if all are equal."""
    share = (flights - low) / (high - low)
    named = F.when(share >= 0.75, "high").when(share >= 0.5, "medium-high").when(share >= 0.25, "medium-low").otherwise("low")
    return F.concat(F.lit("fleet-aircraft-"), F.when(high == low, "high").otherwise(named))


def distance_label(km: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(km, digits)), F.lit(" km"))


def altitude_label(meters: Column) -> Column:
    return F.concat(half_up(meters * METERS_TO_FEET).cast("string"), F.lit(" ft"))


def speed_label(knots: Column) -> Column:
    return F.concat(half_up(knots).cast("string"), F.lit(" kt"))


def altitude_legend(feet: Column) -> Column:
    return F.concat(half_up(feet).cast("string"), F.lit(" ft ("), half_up(feet / METERS_TO_FEET).cast("string"), F.lit(" m)"))


def speed_legend(knots: Column) -> Column:
    return F.concat(half_up(knots).cast("string"), F.lit(" kt ("), half_up(knots * KM_PER_NM).cast("string"), F.lit(" km/h)"))


def distance_legend(nm: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(nm, 1)), F.lit(" nm ("), F.format_string("%.1f", F.round(nm * KM_PER_NM, 1)), F.lit(" km)"))


def nearest_fifty(feet: Column) -> Column:
    """The altitude that a segment's note shows."""
    return half_up(feet / 50) * 50


def track_label(degrees: Column) -> Column:
    """Three digits and the sign of degrees."""
    return F.concat(F.lpad(half_up(degrees).cast("string"), 3, "0"), F.lit("°"))


def progress(t: Column, last: Column) -> Column:
    """How much of a replay is over, in per cent."""
    return F.when(last == 0, 0.0).otherwise(F.least(F.lit(100.0), t / last * 100))


def escaped(text: Column) -> Column:
    """Text as markup shows it: the five signs of markup by name."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text
