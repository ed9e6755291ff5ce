"""Filtered statistics over exported segments and path info."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom import constants as c
from flightloom.functions.display import half_up
from flightloom.functions.names import label


@dataclass(frozen=True)
class FilterSpec:
    """What a user chose: a year or all, an aircraft or all, and selected paths."""

    year: str = "all"
    aircraft: str = "all"
    selected: tuple[int, ...] = ()
    isolate: bool = False

    def matches(self) -> Column:
        """The condition on path info; a path without a year matches no single year."""
        year = F.lit(True) if self.year == "all" else F.coalesce(F.col("year").cast("string") == self.year, F.lit(False))
        craft = F.lit(True) if self.aircraft == "all" else F.coalesce(F.col("registration") == self.aircraft, F.lit(False))
        chosen = F.col("path_id").isin(*self.selected) if self.isolate and self.selected else F.lit(True)
        return year & craft & chosen


def toggled(selected: Column, path_id: Column) -> Column:
    """An array of selected paths with one of them added, or taken out if it was there."""
    return F.when(F.array_contains(selected, path_id), F.array_remove(selected, path_id)).otherwise(F.array_append(selected, path_id))


def cleared(selected: Column) -> Column:
    """Nothing selected: an empty array of the same kind."""
    return F.filter(selected, lambda x: F.lit(False))


def trips(segments: DataFrame, info: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row: flights chosen, their km and nm, and the mean of both a flight; 0 for none. A flight without segments counts."""
    chosen = filtered_paths(info, spec)
    far = filtered_segments(segments, chosen).agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("km"), F.lit(1).alias("one"))
    rows = chosen.agg(F.count("*").alias("flights"), F.lit(1).alias("one")).join(far, "one").withColumn("nm", F.col("km") / c.KM_PER_NM)
    mean = lambda x: F.when(F.col("flights") > 0, F.col(x) / F.col("flights")).otherwise(0.0).alias(f"mean_{x}")
    return rows.select("flights", "km", "nm", mean("km"), mean("nm"))


def paths_of_airport(info: DataFrame, airport: str) -> DataFrame:
    """(path_id) of the paths that begin or end at an airport: selecting it selects these."""
    return airport_edges(info).where(F.col("airport") == airport).select("path_id").distinct()


def aircraft_of_year(segments: DataFrame, info: DataFrame, spec: FilterSpec) -> tuple[DataFrame, FilterSpec]:
    """(registration, aircraft_type, flights, first_path) of the chosen year's aircraft, and the choice, reset to all
    aircraft if the chosen one did not fly that year."""
    year = filtered_paths(info, replace(spec, aircraft="all")).where(F.coalesce("registration", F.lit("")) != "")
    rows = year.groupBy("registration").agg(F.min_by("aircraft_type", "path_id").alias("aircraft_type"), F.count("*").alias("flights"), F.min("path_id").alias("first_path"))
    kept = spec.aircraft == "all" or not rows.where(F.col("registration") == spec.aircraft).isEmpty()
    return rows, spec if kept else replace(spec, aircraft="all")


def by_path(segments: DataFrame, chunk: int = 1_000) -> DataFrame:
    """(path_id, part, segments): a path's segments as arrays in their order, at most `chunk` in one, so that no path is
    too long for a row."""
    listed = F.struct("seg_idx", "lat1", "lon1", "lat2", "lon2", "altitude_ft", "groundspeed_knots", "time")
    return segments.groupBy("path_id", F.floor(F.col("seg_idx") / chunk).alias("part")).agg(F.sort_array(F.collect_list(listed)).alias("segments"))


def defaults(segments: DataFrame, info: DataFrame) -> DataFrame:
    """One row: what a first view shows: the latest year, whether any segment has a speed, and the ranges of colours."""
    year = info.agg(F.max(F.when(F.col("year") != 0, F.col("year"))).alias("year"), F.lit(1).alias("one"))
    timing = ranges(segments).withColumn("has_timing", F.col("moving") > 0).drop("moving").withColumn("one", F.lit(1))
    return year.join(timing, "one").drop("one")


def filtered_paths(info: DataFrame, spec: FilterSpec) -> DataFrame:
    return info.where(spec.matches())


def filtered_segments(segments: DataFrame, info: DataFrame) -> DataFrame:
    return segments.join(info.select("path_id"), "path_id", "left_semi")


def rendered(segments: DataFrame, info: DataFrame, spec: FilterSpec, keep_unknown: bool = False) -> DataFrame:
    """Segments to draw; those without path info go, unless `keep_unknown`, as in a live redraw."""
    rows = segments.join(info.select("path_id", "year", "registration", F.lit(True).alias("known")), "path_id", "left")
    return rows.where((F.col("known") & spec.matches()) | (F.col("known").isNull() & F.lit(keep_unknown)))


def airport_edges(info: DataFrame) -> DataFrame:
    """(path_id, airport): each path's ends, a round trip once."""
    ends = F.array_distinct(F.filter(F.array("start_airport", "end_airport"), lambda a: a.isNotNull() & (a != "")))
    return info.select("path_id", F.explode(ends).alias("airport"))


def airport_counts(info: DataFrame, per_end: bool = False) -> DataFrame:
    """(airport, flights): a round trip counts once, or twice `per_end`; first_seen settles ties."""
    ends = F.filter(F.array("start_airport", "end_airport"), lambda a: a.isNotNull() & (a != ""))
    rows = info.select("path_id", F.posexplode(ends if per_end else F.array_distinct(ends)).alias("end", "airport"))
    out = rows.groupBy("airport").agg(F.count("*").alias("flights"), F.min(F.struct("path_id", "end")).alias("first"))
    return out.select("airport", "flights", "first")


def markers(info: DataFrame) -> DataFrame:
    """(airport, flights, label, home): what the map shows at each airport, and which one is the home base."""
    counts = airport_counts(info)
    home = home_base(counts).select(F.col("home_base").alias("airport"), F.lit(True).alias("home"))
    rows = counts.join(home, "airport", "left")
    return rows.select("airport", "flights", label(F.col("airport")).alias("label"), F.coalesce("home", F.lit(False)).alias("home"))


def home_base(counts: DataFrame) -> DataFrame:
    """One row: the airport with most flights, the first seen of equals."""
    return counts.agg(F.min_by("airport", F.struct(-F.col("flights"), "first")).alias("home_base"), F.max("flights").alias("flights"))


def per_path(segments: DataFrame) -> DataFrame:
    """One row a path: its segments, km, least and greatest altitude, speeds above 0, cruise, times, climb, and its first
    and last known altitude. Cruise is above 304.8 m over sea level with a speed. One shuffle by path serves all of it."""
    upto = Window.partitionBy("path_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("climb", F.greatest(F.col("altitude_m") - F.last("altitude_m", ignorenulls=True).over(upto), F.lit(0.0)))
    knots = F.when(F.col("groundspeed_knots") > 0, F.col("groundspeed_knots"))
    nm = F.when((F.col("altitude_m") > c.QUERY_CRUISE_ALTITUDE_M) & knots.isNotNull(), F.col("km") / c.KM_PER_NM)
    at = F.when(F.col("altitude_m").isNotNull(), F.col("seg_idx"))
    return rows.groupBy("path_id").agg(
        F.count("*").alias("segments"),
        F.sum("km").alias("km"),
        F.min("altitude_m").alias("low_m"),
        F.max("altitude_m").alias("high_m"),
        F.max(knots).alias("max_kt"),
        F.sum(knots).alias("sum_kt"),
        F.count(knots).alias("moving"),
        F.sum(nm).alias("cruise_nm"),
        F.sum(nm / knots).alias("cruise_h"),
        (F.max("time") - F.min("time")).alias("s"),
        F.sum("climb").alias("climb"),
        F.min_by("altitude_m", at).alias("first"),
        F.max_by("altitude_m", at).alias("last"),
    )


def along_paths(paths: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """One row: the aggregates `sums` of per_path() rows, each a sum or an extreme, and gain_m, the climbs of all paths and
    between each path and the next in the order of `keys`.

    Paths are dealt into ranges of their keys; a path looks back within its range, and the ranges' ends, one row each, are
    compared in the end. So no task orders all paths. Paths without altitude are passed over.
    """
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    upto = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = paths.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    rows = rows.withColumn("up", F.coalesce("climb", F.lit(0.0)) + F.coalesce(F.greatest(F.col("first") - F.last("last", ignorenulls=True).over(upto), F.lit(0.0)), F.lit(0.0)))
    at = F.when(F.col("first").isNotNull(), F.struct(*keys))
    each = rows.groupBy("part").agg(*[x.alias(n) for n, x in sums.items()], F.sum("up").alias("up"), F.min_by("first", at).alias("first"), F.max_by("last", at).alias("last"))
    ends = F.sort_array(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("part", "first", "last"))))
    again = lambda name: F.min(name) if name.startswith("min") else F.max(name) if name.startswith("max") else F.sum(name)
    whole = each.agg(*[again(n).alias(n) for n in sums], F.coalesce(F.sum("up"), F.lit(0.0)).alias("up"), ends.alias("ends"))
    steps = F.transform("ends", lambda x, i: F.when(i > 0, F.greatest(x["first"] - F.get("ends", i - 1)["last"], F.lit(0.0))).otherwise(0.0))
    return whole.withColumn("gain_m", F.col("up") + F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).drop("up", "ends")


def gain_across(segments: DataFrame, *before: str) -> DataFrame:
    """One row, gain_m: the sum of climbs over the whole list, in the order (*before, path_id, seg_idx), where `before`
    are columns of one value a path."""
    paths = per_path(segments)
    if before:
        paths = paths.join(segments.groupBy("path_id").agg(*[F.first(x).alias(x) for x in before]), "path_id")
    return along_paths(paths, [*before, "path_id"])


def statistics(segments: DataFrame, info: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row of statistics for the chosen year and aircraft.

    Cruise speed is distance over the sum of distance by speed; the mode is the most frequent altitude in cruise, rounded
    to 100 ft, the lowest of equals. Empty choices give zeros.
    """
    chosen = filtered_paths(info, spec)
    rows = filtered_segments(segments, chosen)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sums = along_paths(
        per_path(rows),
        ["path_id"],
        segments=F.sum("segments"),
        km=F.sum("km"),
        min_m=F.min("low_m"),
        max_m=F.max("high_m"),
        max_kt=F.max("max_kt"),
        sum_kt=F.sum("sum_kt"),
        moving=F.sum("moving"),
        cruise_nm=F.sum("cruise_nm"),
        cruise_h=F.sum("cruise_h"),
        max_km=F.max("km"),
        s=F.sum("s"),
    )
    sums = sums.select(
        F.coalesce("segments", F.lit(0).cast("long")).alias("segments"),
        zero(F.col("km")).alias("total_km"),
        zero(F.col("min_m")).alias("min_altitude_m"),
        zero(F.col("max_m")).alias("max_altitude_m"),
        zero(F.col("max_kt")).alias("max_groundspeed_knots"),
        zero(F.try_divide("sum_kt", "moving")).alias("average_groundspeed_knots"),
        zero(F.try_divide("cruise_nm", "cruise_h")).alias("cruise_speed_knots"),
        zero(F.col("max_km")).alias("longest_flight_km"),
        zero(F.col("s")).alias("flight_seconds"),
        "gain_m",
        F.lit(1).alias("one"),
    )
    cruising = (F.col("altitude_m") > c.QUERY_CRUISE_ALTITUDE_M) & (F.col("groundspeed_knots") > 0)
    bins = rows.where(cruising).groupBy((half_up(F.col("altitude_ft") / 100) * 100).alias("bin")).count()
    mode = bins.agg(F.coalesce(F.min_by("bin", F.struct(-F.col("count"), F.col("bin"))), F.lit(0)).alias("cruise_altitude_ft"), F.lit(1).alias("one"))
    craft = F.when(F.col("registration") != "", F.col("registration"))
    heads = chosen.agg(F.count("*").alias("num_paths"), F.count_distinct(craft).alias("num_aircraft"), F.lit(1).alias("one"))
    ports = airport_edges(chosen).agg(F.count_distinct("airport").alias("num_airports"), F.lit(1).alias("one"))
    out = heads
    for part in (ports, sums, mode):
        out = out.join(part, "one")
    return out.drop("one").withColumn("total_nm", F.col("total_km") / c.KM_PER_NM).withColumn("total_points", F.col("segments") * 2).drop("segments")


def ranges(segments: DataFrame) -> DataFrame:
    """One row: colour ranges of altitude (default 0 to 10,000 ft) and speed above 0 (0 to 200 kt), segments and paths."""
    moving = F.when(F.col("groundspeed_knots") > 0, F.col("groundspeed_knots"))
    return segments.agg(
        F.count("*").alias("segments"),
        F.count_distinct("path_id").alias("paths"),
        F.coalesce(F.min("altitude_ft"), F.lit(0.0)).alias("min_ft"),
        F.coalesce(F.max("altitude_ft"), F.lit(10000.0)).alias("max_ft"),
        F.coalesce(F.min(moving), F.lit(0.0)).alias("min_kt"),
        F.coalesce(F.max(moving), F.lit(200.0)).alias("max_kt"),
        F.count(moving).alias("moving"),
    )


def distinct_coordinates(segments: DataFrame) -> DataFrame:
    both = segments.select(F.explode(F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))).alias("at"))
    return both.select("at.lat", "at.lon").distinct()


def visible_airports(all_info: DataFrame, spec: FilterSpec) -> DataFrame:
    """(airport, visible): whether a path that matches reaches the airport."""
    seen = airport_edges(filtered_paths(all_info, spec)).select("airport").distinct().withColumn("visible", F.lit(True))
    return airport_edges(all_info).select("airport").distinct().join(seen, "airport", "left").select("airport", F.coalesce("visible", F.lit(False)).alias("visible"))


#: Cells within which a point counts in full, and over which its weight falls to nothing.
RADIUS, BLUR = 10, 15


def heat(points: DataFrame, degrees: float = 0.001, radius: int = RADIUS, blur: int = BLUR) -> DataFrame:
    """(row, col, heat): density() spread by a kernel that is the product of one along rows and one along columns: 1 up to
    `radius` cells away, falling evenly to 0 over `blur` more. An addition of this library.

    Points are counted by cell first; then each cell's count goes to the cells of its row, is summed, and each sum to those of
    its column: 2 * (2k + 1) rows a cell instead of (2k + 1) squared.
    """
    reach = radius + blur - 1
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    weight = F.least(F.lit(1.0), (radius + blur - F.abs(F.col("away"))) / blur)
    out = density(points, degrees).select("row", "col", F.col("points").cast("double").alias("heat"))
    for axis, other in (("col", "row"), ("row", "col")):
        out = out.select(other, axis, "heat", offsets.alias("away")).groupBy(other, (F.col(axis) + F.col("away")).alias(axis)).agg(F.sum(F.col("heat") * weight).alias("heat"))
    return out.select("row", "col", "heat")


def density(points: DataFrame, degrees: float = 0.001) -> DataFrame:
    """Points in each cell of a grid: what a heat layer draws. An addition of this library."""
    return points.groupBy(F.floor(F.col("lat") / degrees).alias("row"), F.floor(F.col("lon") / degrees).alias("col")).agg(F.count("*").alias("points"))
