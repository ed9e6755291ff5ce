"""Points to segments: distance, speed, cruise and their sums. All windows share one partitioning by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightloom import constants as c
from flightloom.functions.geo import haversine_km
from flightloom.sources.shared import checkpointed


def by_path() -> WindowSpec:
    return Window.partitionBy("path_id")


def along() -> WindowSpec:
    return by_path().orderBy("seq")


def validated(points: DataFrame) -> DataFrame:
    """Rows with a latitude and longitude in range; altitudes out of range become null, those below sea level 0."""
    lat, lon, alt = F.col("lat"), F.col("lon"), F.col("alt_m")
    inside = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    level = F.when(alt.between(c.MIN_ALTITUDE_M, c.MAX_ALTITUDE_M), F.greatest(alt, F.lit(0.0)))
    return points.where(inside).withColumn("alt_m", level)


def legs(points: DataFrame) -> DataFrame:
    """One row for each point and its successor in the path: both ends, distance in km, seconds and instant speed in kt.

    The speed is 0 where the seconds are unknown or below the least, or it would be above the highest.
    """
    ahead = [F.lead(x).over(along()).alias(f"{x}2") for x in _POINT]
    return _measured(points.select("path_id", "seq", *_POINT, *ahead))


_POINT = ("us", "lat", "lon", "alt_m")


def _measured(rows: DataFrame) -> DataFrame:
    rows = rows.where("lat2 IS NOT NULL").select("path_id", (F.col("seq") - 1).alias("seg_idx"), "seq", *_POINT, *[f"{x}2" for x in _POINT])
    rows = rows.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).withColumn("dt", (F.col("us2") - F.col("us")) / 1e6)
    knots = F.col("km") / c.KM_PER_NM / (F.col("dt") / 3600)
    return rows.withColumn("speed", F.when((F.col("dt") >= c.MIN_SEGMENT_SECONDS) & (knots <= c.MAX_GROUNDSPEED_KNOTS), knots).otherwise(0.0))


def with_groundspeed(legs_: DataFrame) -> DataFrame:
    """Adds window_km, window_s and gs: the speed over the legs that start within a minute before or after and have a
    speed; where there is none, the path's mean speed, with no window sums."""
    half = c.SPEED_WINDOW_SECONDS * 1_000_000 // 2
    around = by_path().orderBy("us").rangeBetween(-half, half)
    moving = F.col("speed") != 0
    rows = legs_.withColumn("window_km", F.coalesce(F.sum(F.when(moving, F.col("km"))).over(around), F.lit(0.0))).withColumn("window_s", F.coalesce(F.sum(F.when(moving, F.col("us2") - F.col("us"))).over(around), F.lit(0)) / 1e6)
    lasting = (F.max("us2").over(by_path()) - F.min("us").over(by_path())) / 1e6
    return _speeds(rows, lasting, F.sum("km").over(by_path()) / c.KM_PER_NM / (lasting / 3600))


def _speeds(rows: DataFrame, lasting: Column, mean: Column) -> DataFrame:
    """gs from the window sums, or from the path's mean speed and the seconds that it lasts."""
    knots = F.col("window_km") / c.KM_PER_NM / (F.col("window_s") / 3600)
    windowed = F.when((F.col("window_s") >= c.MIN_SEGMENT_SECONDS) & (knots <= c.MAX_GROUNDSPEED_KNOTS), knots).otherwise(0.0)
    fallback = F.when((lasting > 0) & (F.col("km") > 0) & (mean > 0) & (mean <= c.MAX_GROUNDSPEED_KNOTS), mean).otherwise(0.0)
    rows = rows.withColumn("windowed", F.when(F.col("us").isNotNull(), windowed).otherwise(0.0)).withColumn("fallback", fallback)
    used = F.col("windowed") > 0
    rows = rows.withColumn("gs", F.when(used, F.col("windowed")).otherwise(F.col("fallback")))
    for x in ("window_km", "window_s"):
        rows = rows.withColumn(x, F.when(used, F.col(x)).otherwise(0.0))
    return rows.drop("windowed", "fallback")


def with_cruise(rows: DataFrame) -> DataFrame:
    """Adds agl_ft (mean altitude above the path's lowest point), cruising, and the altitude bin."""
    return _with_cruise(rows, F.least(F.min("alt_m").over(by_path()), F.min("alt_m2").over(by_path())))


def _with_cruise(rows: DataFrame, low: Column) -> DataFrame:
    agl = ((F.col("alt_m") + F.col("alt_m2")) / 2 - low) * c.METERS_TO_FEET
    rows = rows.withColumn("agl_ft", agl)
    cruising = (F.col("agl_ft") > c.CRUISE_AGL_FT) & (F.col("window_s") >= c.MIN_SEGMENT_SECONDS) & (F.col("gs") > 0)
    return rows.withColumn("cruising", F.coalesce(cruising, F.lit(False))).withColumn("bin_ft", (F.col("agl_ft") / c.ALTITUDE_BIN_FT).cast("long") * c.ALTITUDE_BIN_FT)


def segments(rows: DataFrame) -> DataFrame:
    """The exported segments: rounded half to even; legs between equal coordinates go, after all sums were taken."""
    return _segments(rows, F.min("us").over(by_path()))


def _segments(rows: DataFrame, begin: Column) -> DataFrame:
    level = (F.col("alt_m") + F.col("alt_m2")) / 2
    out = rows.select(
        "path_id",
        "seg_idx",
        F.col("lat").alias("lat1"),
        F.col("lon").alias("lon1"),
        "lat2",
        "lon2",
        (F.bround(level * c.METERS_TO_FEET / 100, 0) * 100).alias("altitude_ft"),
        F.bround(level, 0).alias("altitude_m"),
        F.bround("gs", 1).alias("groundspeed_knots"),
        F.bround((F.col("us") - begin) / 1e6, 1).alias("time"),
        "km",
    )
    return out.where("lat1 <> lat2 OR lon1 <> lon2")


def altitude_samples(points: DataFrame, from_end: bool = False) -> DataFrame:
    """(path_id, low, high, variation) over the first or last k points with k = min(50, n div 4); none unless n > 10 and
    k > 5."""
    order = by_path().orderBy(F.desc("seq") if from_end else F.asc("seq"))
    n = F.count("*").over(by_path())
    k = F.least(F.lit(c.SAMPLE_MOST), F.floor(n / 4))
    rows = points.select("path_id", "alt_m", F.row_number().over(order).alias("at"), n.alias("n"), k.alias("k"))
    rows = rows.where((F.col("n") > 10) & (F.col("k") > c.SAMPLE_LEAST) & (F.col("at") <= F.col("k")))
    return rows.groupBy("path_id").agg(F.min("alt_m").alias("low"), F.max("alt_m").alias("high"), (F.max("alt_m") - F.min("alt_m")).alias("variation"))


def flight_phases(points: DataFrame) -> DataFrame:
    """(path_id, mid_flight_start, valid_landing) from the altitudes at both ends of a path."""
    ends = points.groupBy("path_id").agg(F.min_by("alt_m", "seq").alias("start_alt"), F.max_by("alt_m", "seq").alias("end_alt"))
    first = altitude_samples(points).select("path_id", F.col("variation").alias("start_variation"))
    last = altitude_samples(points, from_end=True).select("path_id", F.col("variation").alias("end_variation"))
    rows = ends.join(first, "path_id", "left").join(last, "path_id", "left")
    mid = (F.col("start_alt") > c.MID_FLIGHT_ALTITUDE_M) & (F.col("start_variation") < c.MID_FLIGHT_VARIATION_M)
    landed = F.when(F.col("end_variation").isNull(), F.col("end_alt") < c.LANDING_FALLBACK_M).otherwise((F.col("end_variation") < c.LANDING_VARIATION_M) | (F.col("end_alt") < c.LANDING_ALTITUDE_M))
    return rows.select("path_id", F.coalesce(mid, F.lit(False)).alias("mid_flight_start"), landed.alias("valid_landing"))


def first_by(value: str, *order: Column | str) -> Column:
    """The value of the row that comes first in the order: ties in a ranking are settled by stating them here."""
    return F.min_by(value, F.struct(*order))


#: Points of a path above which it is split; points and seconds of a piece of it.
LONG_PATH, PIECE_POINTS, PIECE_SECONDS = 1_000_000, 100_000, 3_600


def legs_split(points: DataFrame, piece_points: int = PIECE_POINTS) -> DataFrame:
    """legs() for paths of any length: the same rows, but no task holds a path. Points are dealt into pieces by their number;
    the last of a piece meets the first of the next, a row a piece, which alone are ordered along a whole path."""
    dealt = points.withColumn("piece", F.floor(F.col("seq") / piece_points)).repartition("path_id", "piece")
    own = F.struct(*_POINT)
    heads = dealt.groupBy("path_id", "piece").agg(F.min_by(own, "seq").alias("head"))
    after = heads.select("path_id", "piece", F.lead("head").over(by_path().orderBy("piece")).alias("after"))
    within = Window.partitionBy("path_id", "piece").orderBy("seq")
    rows = dealt.withColumn("ahead", F.lead(own).over(within)).join(after, ["path_id", "piece"]).withColumn("ahead", F.coalesce("ahead", "after"))
    return _measured(rows.select("path_id", "seq", *_POINT, *[F.col(f"ahead.{x}").alias(f"{x}2") for x in _POINT]))


def with_groundspeed_split(legs_: DataFrame, piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """with_groundspeed() for paths of any length: the same rows, but no task holds a path.

    A path's legs are dealt into pieces of time. Legs within half a window of a piece's end go to the piece beside it as well,
    where they only lend their sums; so each leg finds its whole window in its own piece. What concerns the path as a
    whole is summed over its pieces, a row each, and joined piece by piece. Legs without a time have no window and are dealt by their number.
    """
    half = c.SPEED_WINDOW_SECONDS * 1_000_000 // 2
    wide = F.lit(max(piece_seconds * 1_000_000, half)).cast("long")
    piece = lambda us: F.floor(us / wide)
    own = F.coalesce(piece(F.col("us")), -1 - F.col("seg_idx") % 64)
    beside = F.array_distinct(F.array_compact(F.array(own, piece(F.col("us") - half), piece(F.col("us") + half))))
    spread = legs_.withColumn("own_piece", own).withColumn("piece", F.explode(beside)).repartition("path_id", "piece")
    around = Window.partitionBy("path_id", "piece").orderBy("us").rangeBetween(-half, half)
    moving = F.col("speed") != 0
    rows = spread.withColumn("window_km", F.coalesce(F.sum(F.when(moving, F.col("km"))).over(around), F.lit(0.0))).withColumn("window_s", F.coalesce(F.sum(F.when(moving, F.col("us2") - F.col("us"))).over(around), F.lit(0)) / 1e6)
    pieces = legs_.withColumn("piece", own).groupBy("path_id", "piece").agg(F.max("us2").alias("end"), F.min("us").alias("begin"), F.sum("km").alias("far"))
    total = pieces.select("path_id", "piece", ((F.max("end").over(by_path()) - F.min("begin").over(by_path())) / 1e6).alias("lasting"), F.sum("far").over(by_path()).alias("path_km"))
    rows = rows.where("piece = own_piece").join(total, ["path_id", "piece"])
    mean = F.col("path_km") / c.KM_PER_NM / (F.col("lasting") / 3600)
    return _speeds(rows, F.col("lasting"), mean).drop("lasting", "path_km", "piece", "own_piece")


def cruised(points: DataFrame, long_path: int = LONG_PATH) -> tuple[DataFrame, DataFrame]:
    """The legs of `points` with groundspeed and cruise, and the exported segments(): those of paths of more than `long_path`
    points are made piece by piece. There are at most as many such paths as that number goes into all points, so their ids
    and what concerns each as a whole are broadcast."""
    ids = checkpointed(points.groupBy("path_id").agg(F.count("*").alias("n")).where(F.col("n") > long_path).select("path_id"))
    if ids.isEmpty():
        rows = with_cruise(with_groundspeed(legs(points)))
        return rows, segments(rows)
    rows = with_cruise(with_groundspeed(legs(points.join(F.broadcast(ids), "path_id", "left_anti"))))
    split = legs_split(points.join(F.broadcast(ids), "path_id", "left_semi"))
    facts = split.groupBy("path_id").agg(F.least(F.min("alt_m"), F.min("alt_m2")).alias("low"), F.min("us").alias("begin"))
    split = with_groundspeed_split(split).join(F.broadcast(facts), "path_id")
    split = _with_cruise(split, F.col("low"))
    parts = _segments(split, F.col("begin"))
    return rows.unionByName(split.drop("low", "begin")), segments(rows).unionByName(parts)
