"""Statistics of tracks and of exported segments, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom import constants as c
from flightloom.functions.names import is_marker, route_ends
from flightloom.operators.tracks import along, first_by
from flightloom.plans.filters import gain_across


def basic(points: DataFrame, legs: DataFrame) -> DataFrame:
    """One row: distance, altitude gain within paths, altitude range, points and paths."""
    gain = F.greatest(F.col("alt_m") - F.lag("alt_m").over(along()), F.lit(0.0))
    heights = points.withColumn("gain", gain).agg(
        F.count("*").alias("total_points"),
        F.count_distinct("path_id").alias("num_paths"),
        F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain_m"),
        F.min("alt_m").alias("min_altitude_m"),
        F.max("alt_m").alias("max_altitude_m"),
    )
    far = legs.agg(F.coalesce(F.sum("km"), F.lit(0.0)).alias("distance_km"), F.lit(1).alias("one"))
    return heights.withColumn("one", F.lit(1)).join(far, "one").drop("one")


def altitude_range(points: DataFrame) -> DataFrame:
    """One row with defaults of 0 and 1000 where no altitude is known."""
    return points.agg(F.coalesce(F.min("alt_m"), F.lit(0.0)).alias("low"), F.coalesce(F.max("alt_m"), F.lit(1000.0)).alias("high"))


def flight_time(points: DataFrame) -> DataFrame:
    """One row: seconds of all paths with two timestamps or more that span some time, and how many those are."""
    each = points.groupBy("path_id").agg(F.count("us").alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("s")).where("n >= 2 AND s > 0")
    return each.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("total_seconds"), F.count("*").alias("timed_paths"))


def path_info(points: DataFrame, legs: DataFrame, paths: DataFrame) -> DataFrame:
    """One row a path: ends, airports of its route, seconds, km, nm, and segment_count, its points less one."""
    start, end = route_ends(F.col("airport_name"))
    shape = points.groupBy("path_id").agg(
        F.min_by("lat", "seq").alias("start_lat"),
        F.min_by("lon", "seq").alias("start_lon"),
        F.max_by("lat", "seq").alias("end_lat"),
        F.max_by("lon", "seq").alias("end_lon"),
        ((F.max("us") - F.min("us")) / 1e6).alias("seconds"),
        F.min("us").alias("start_us"),
        (F.count("*") - 1).alias("segment_count"),
    )
    far = legs.groupBy("path_id").agg(F.sum("km").alias("km"))
    rows = paths.join(shape, "path_id").join(far, "path_id", "left").withColumn("km", F.coalesce("km", F.lit(0.0)))
    return rows.select("*", (F.col("km") / c.KM_PER_NM).alias("nm"), start.alias("start_airport"), end.alias("end_airport"))


def aircraft(info: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row a registration: flights by distinct file names, seconds and km of paths of two points or more, the years in
    which they lasted, the type first seen, and the model, or else the type. `place` ranks them by flights, the first seen
    of equals first; its window holds one row an aircraft."""
    known = info.where(F.coalesce("registration", F.lit("")) != "")
    counts = F.col("segment_count") >= 1
    began = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col("start_us") if "start_us" in info.columns else F.lit(None).cast("long")) / 86_400_000_000 * 1000).cast("int")))
    rows = known.groupBy("registration").agg(
        F.count_distinct("filename").alias("flights"),
        first_by("aircraft_type", "path_id").alias("aircraft_type"),
        F.sum(F.when(counts, F.col("seconds")).otherwise(0.0)).alias("seconds"),
        F.sum(F.when(counts, F.col("km")).otherwise(0.0)).alias("km"),
        F.array_join(F.sort_array(F.collect_set(F.when(counts & (F.col("seconds") > 0), began))), ",").alias("years"),
        F.min("path_id").alias("first_path"),
    )
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("flights"), "first_path")))
    if models is None:
        return rows.withColumn("model", F.col("aircraft_type"))
    return rows.join(models, "registration", "left").withColumn("model", F.coalesce("model", "aircraft_type"))


def aircraft_distances(segments: DataFrame, info: DataFrame) -> DataFrame:
    """(registration, km, seconds) from exported segments: each segment's km by its path's registration, and the time from
    the first to the last timed segment of each path with two of them."""
    each = segments.groupBy("path_id").agg(F.sum("km").alias("km"), F.when(F.count("time") >= 2, F.max("time") - F.min("time")).alias("s"))
    known = info.where(F.coalesce("registration", F.lit("")) != "").select("path_id", "registration")
    rows = known.join(each, "path_id").groupBy("registration").agg(F.sum("km").alias("km"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"))
    return rows


def record(points: DataFrame, legs: DataFrame, info: DataFrame) -> DataFrame:
    """All statistics of a set of tracks in one row: points, paths that are no markers, distance, climb and altitudes in both
    units, flight time, mean speed over it, aircraft, and their distinct types in order. Paths of one point count as paths
    and points only."""
    long_paths = info.where("segment_count >= 1").select("path_id")
    sums = basic(points.join(long_paths, "path_id", "left_semi"), legs).drop("total_points", "num_paths").withColumn("one", F.lit(1))
    time = flight_time(points).withColumn("one", F.lit(1))
    total = points.agg(F.count("*").alias("total_points"), F.lit(1).alias("one"))
    craft = F.when(F.col("registration") != "", F.col("registration"))
    kinds = F.collect_set(F.when(F.col("aircraft_type") != "", F.col("aircraft_type")))
    heads = info.agg(F.count_if(~is_marker(F.col("airport_name"))).alias("num_paths"), F.count_distinct(craft).alias("num_aircraft"), F.array_join(F.sort_array(kinds), ",").alias("aircraft_types"), F.lit(1).alias("one"))
    rows = total.join(heads, "one").join(sums, "one").join(time, "one").drop("one")
    nm = F.col("distance_km") / c.KM_PER_NM
    rows = rows.withColumn("distance_nm", nm).withColumn("average_groundspeed_knots", F.when((F.col("total_seconds") > 0) & (nm > 0), nm / (F.col("total_seconds") / 3600)).otherwise(0.0))
    for name in ("gain", "min_altitude", "max_altitude"):
        rows = rows.withColumn(f"{name}_ft", F.col(f"{name}_m") * c.METERS_TO_FEET)
    return rows


def cruise(rows: DataFrame) -> DataFrame:
    """One row: cruise distance, seconds and speed, highest and lowest groundspeed above 0, and the altitude bin with most
    seconds in cruise, weighed by the windows' seconds; of equal bins the one met first."""
    sums = rows.agg(
        F.sum(F.when(F.col("cruising"), F.col("window_km"))).alias("cruise_km"),
        F.sum(F.when(F.col("cruising"), F.col("window_s"))).alias("cruise_seconds"),
        F.max(F.when(F.col("gs") > 0, F.col("gs"))).alias("max_gs"),
        F.min(F.when(F.col("gs") > 0, F.col("gs"))).alias("min_gs"),
        F.lit(1).alias("one"),
    )
    mode = histogram(rows).agg(F.min_by("bin_ft", F.struct(-F.round("seconds", 6), "first_path", "first_seg")).alias("mode_bin_ft"), F.lit(1).alias("one"))
    speed = F.col("cruise_km") / c.KM_PER_NM / (F.col("cruise_seconds") / 3600)
    return sums.join(mode, "one").drop("one").withColumn("cruise_knots_weighted", F.coalesce(speed, F.lit(0.0)))


def cruise_by_year(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """A year's share of cruise(), one row a year: km and seconds in cruise, highest and lowest groundspeed above 0, the longest
    path's km, and the histogram of altitudes: bin to its seconds and the place where it was met first, (path, segment). Rows
    of paths without a year have a row of their own. A histogram has as many entries as there are altitudes."""
    known = rows.join(paths.select("path_id", "year"), "path_id", "left")
    each = known.groupBy("year", "path_id").agg(
        F.sum(F.when(F.col("cruising"), F.col("window_km"))).alias("cruise_km"),
        F.sum(F.when(F.col("cruising"), F.col("window_s"))).alias("cruise_seconds"),
        F.max(F.when(F.col("gs") > 0, F.col("gs"))).alias("max_gs"),
        F.min(F.when(F.col("gs") > 0, F.col("gs"))).alias("min_gs"),
        F.sum("km").alias("km"),
    )
    sums = each.groupBy("year").agg(F.sum("cruise_km").alias("cruise_km"), F.sum("cruise_seconds").alias("cruise_seconds"), F.max("max_gs").alias("max_gs"), F.min("min_gs").alias("min_gs"), F.max("km").alias("longest_km"))
    bins = known.where("cruising").groupBy("year", "bin_ft").agg(F.sum("window_s").alias("seconds"), F.min(F.struct("path_id", "seg_idx")).alias("first"))
    maps = bins.groupBy(F.col("year").alias("of_year")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin_ft", F.struct("seconds", "first"))))).alias("histogram"))
    return sums.join(maps, F.col("year").eqNullSafe(F.col("of_year")), "left").drop("of_year")


def merged_years(parts: DataFrame) -> DataFrame:
    """One row from the rows of cruise_by_year(), of any years and in any number of tables put together, as cruise() would have
    it of all: the bin with most seconds in all histograms, of equals the one met first, by year, path and segment."""
    bins = parts.select("year", F.explode("histogram").alias("bin_ft", "h")).groupBy("bin_ft").agg(F.sum("h.seconds").alias("seconds"), F.min(F.struct(F.col("year").isNull(), "year", "h.first")).alias("first"))
    mode = bins.agg(F.min_by("bin_ft", F.struct(-F.round("seconds", 6), "first")).alias("mode_bin_ft"), F.lit(1).alias("one"))
    sums = parts.agg(F.lit(1).alias("one"), F.sum("cruise_km").alias("cruise_km"), F.sum("cruise_seconds").alias("cruise_seconds"), F.max("max_gs").alias("max_gs"), F.min("min_gs").alias("min_gs"), F.max("longest_km").alias("longest_km"))
    return sums.join(mode, "one").drop("one")


def histogram(rows: DataFrame) -> DataFrame:
    """(bin_ft, seconds, first_path, first_seg): seconds in cruise at each altitude bin."""
    first = F.min(F.struct("path_id", "seg_idx"))
    out = rows.where("cruising").groupBy("bin_ft").agg(F.sum("window_s").alias("seconds"), first.alias("first"))
    return out.select("bin_ft", "seconds", F.col("first.path_id").alias("first_path"), F.col("first.seg_idx").alias("first_seg"))


def reconciled(segments: DataFrame, years: DataFrame) -> DataFrame:
    """One row from exported segments: points, altitude range, gain over the list of years and paths, mean speeds, and the
    mode of the rounded altitude of timed segments in cruise. Cruise begins 1,000 ft above the lowest segment."""
    rows = segments.join(years.select("path_id", "year"), "path_id", "left")
    low = rows.agg((F.min("altitude_m") * c.METERS_TO_FEET).alias("low_ft"), F.lit(1).alias("one"))
    rows = rows.withColumn("one", F.lit(1)).join(low, "one").drop("one")
    feet = F.col("altitude_m") * c.METERS_TO_FEET
    moving = F.col("groundspeed_knots") > 0
    cruising = (feet > F.col("low_ft") + c.CRUISE_AGL_FT) & moving
    bins = F.when(cruising & F.col("time").isNotNull(), F.bround(F.col("altitude_ft") / 100, 0) * 100)
    rows = rows.withColumn("bin", bins).withColumn("cruise_gs", F.when(cruising, F.col("groundspeed_knots")))
    sums = rows.agg(
        (2 * F.count("*")).alias("total_points"),
        F.min("altitude_m").alias("min_altitude_m"),
        F.max("altitude_m").alias("max_altitude_m"),
        F.avg(F.when(moving, F.col("groundspeed_knots"))).alias("average_groundspeed_mean"),
        F.avg("cruise_gs").alias("cruise_speed_mean"),
        F.lit(1).alias("one"),
    )
    counted = rows.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.min(F.struct("year", "path_id", "seg_idx")).alias("first"))
    mode = counted.agg(F.min_by("bin", F.struct(-F.col("n"), F.col("first"))).alias("mode_ft"), F.lit(1).alias("one"))
    timed = rows.where("time IS NOT NULL").groupBy("path_id").agg(F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("s")).where("n >= 2")
    total = timed.agg(F.sum("s").alias("flight_seconds"), F.lit(1).alias("one"))
    climbs = gain_across(rows, "year").withColumn("one", F.lit(1))
    return sums.join(mode, "one").join(total, "one").join(climbs, "one").drop("one")
