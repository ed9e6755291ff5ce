"""Replay: positions, bearings and ranges of one path or of many at given times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.geo import bearing

LOOK_AHEAD = 5


def timed(segments: DataFrame) -> DataFrame:
    """Segments with a time; time_range() and as_of() read these."""
    return segments.where(F.col("time").isNotNull())


def time_range(segments: DataFrame) -> DataFrame:
    """(path_id, first, last, low_ft, high_ft, low_kt, high_kt) of each path's timed segments."""
    kt = F.when(F.col("groundspeed_knots") > 0, F.col("groundspeed_knots"))
    return timed(segments).groupBy("path_id").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.min("altitude_ft").alias("low_ft"), F.max("altitude_ft").alias("high_ft"), F.coalesce(F.min(kt), F.lit(0.0)).alias("low_kt"), F.coalesce(F.max(kt), F.lit(200.0)).alias("high_kt"))


def _opening(time: str, seg_idx: str) -> Column:
    """An order in which a path's opening segment is the least: of those with its first time the last."""
    return F.struct(F.col(time).alias("time"), (-F.col(seg_idx)).alias("back"))


def as_of(segments: DataFrame, asked: DataFrame, else_first: bool = True) -> DataFrame:
    """(path_id, t, seg_idx, ...): for each asked (path_id, t) the last segment with time <= t; before the first time the
    last segment with that time, or nothing. Both sides are merged in one sorted window by path, so each is shuffled once."""
    has = ["seg_idx", "lat1", "lon1", "lat2", "lon2", "altitude_m", "groundspeed_knots", "time"]
    ahead = Window.partitionBy("path_id").orderBy("time", "seg_idx")
    rows = timed(segments).select("path_id", *has)
    rows = rows.withColumn("following", F.lead(F.struct(*has)).over(ahead)).select("path_id", F.col("time").alias("t"), F.lit(0).alias("asked"), F.struct(*has, "following").alias("here"))
    kind = rows.schema["here"].dataType
    both = rows.unionByName(asked.select("path_id", F.col("t").cast("double").alias("t"), F.lit(1).alias("asked"), F.lit(None).cast(kind).alias("here")))
    merged = Window.partitionBy("path_id").orderBy("t", "asked", F.col("here.seg_idx"))
    upto = merged.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min_by("here", F.when(F.col("asked") == 0, _opening("t", "here.seg_idx"))).over(Window.partitionBy("path_id"))
    found = F.last("here", ignorenulls=True).over(upto)
    return both.withColumn("here", F.coalesce(found, first) if else_first else found).where("asked = 1").select("path_id", "t", "here.*")


#: Seconds of a bucket of as_of_split().
BUCKET_SECONDS = 3_600


def as_of_split(segments: DataFrame, asked: DataFrame, else_first: bool = True, bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """as_of() for paths of any length: the same rows, but no task holds a path.

    Both sides are dealt into buckets of a path's time and merged within them. What a bucket needs of the others is one row: the
    last segment before it, carried forward over buckets without any, and the first one after it. These rows, two a bucket,
    are the only ones that are ordered along a whole path.
    """
    has = ["seg_idx", "lat1", "lon1", "lat2", "lon2", "altitude_m", "groundspeed_knots", "time"]
    bucket = lambda t: F.floor(t / bucket_seconds).alias("bucket")
    rows = timed(segments).select("path_id", bucket(F.col("time")), *has)
    calls = asked.select("path_id", bucket(F.col("t")), F.col("t").cast("double").alias("t"))
    order = F.struct("time", "seg_idx")
    ends = rows.groupBy("path_id", "bucket").agg(F.max_by(F.struct(*has), order).alias("last"), F.min_by(F.struct(*has), order).alias("first"))
    every = ends.join(calls.select("path_id", "bucket").distinct(), ["path_id", "bucket"], "full")
    along = Window.partitionBy("path_id").orderBy("bucket")
    carried = every.select(
        "path_id", "bucket",
        F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("next"),
    )
    within = Window.partitionBy("path_id", "bucket")
    ahead = rows.withColumn("following", F.lead(F.struct(*has)).over(within.orderBy("time", "seg_idx")))
    here = ahead.select("path_id", "bucket", F.col("time").alias("t"), F.lit(0).alias("asked"), F.struct(*has, "following").alias("here"))
    both = here.unionByName(calls.select("path_id", "bucket", "t", F.lit(1).alias("asked"), F.lit(None).cast(here.schema["here"].dataType).alias("here")))
    upto = within.orderBy("t", "asked", F.col("here.seg_idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("here", F.last("here", ignorenulls=True).over(upto)).where("asked = 1").join(carried, ["path_id", "bucket"])
    of = lambda x, following: F.when(x.isNotNull(), F.struct(*[x[n].alias(n) for n in has], following.alias("following")))
    own = of(F.col("here"), F.coalesce(F.col("here.following"), F.col("after")))
    earlier = of(F.col("before"), F.col("next"))
    return _with_first(found.withColumn("here", F.coalesce(own, earlier)), segments, has, else_first)


def _with_first(found: DataFrame, segments: DataFrame, has: list[str], else_first: bool) -> DataFrame:
    """(path_id, t, ...) of `found`; where nothing came before, the last segment with a path's first time, with the one that
    follows it, if asked for. These two segments of each path are one row."""
    if not else_first:
        return found.select("path_id", "t", "here.*")
    order = F.struct("time", "seg_idx")
    first = timed(segments).groupBy("path_id").agg(F.min_by(F.struct(order.alias("o"), *[F.col(x).alias(x) for x in has]), _opening("time", "seg_idx")).alias("a"))
    rest = timed(segments).join(first, "path_id").where(order > F.col("a.o")).groupBy("path_id").agg(F.min_by(F.struct(*has), order).alias("b"))
    opening = first.join(rest, "path_id", "left").select("path_id", F.struct(*[F.col(f"a.{x}").alias(x) for x in has], F.col("b").alias("following")).alias("opened"))
    return found.join(opening, "path_id", "left").withColumn("here", F.coalesce("here", "opened")).select("path_id", "t", "here.*")


def positions(segments: DataFrame, asked: DataFrame, least_step: float = 0.001) -> DataFrame:
    """(path_id, t, lat, lon, altitude_m, groundspeed_knots) between the end of the segment at hand and the start of the
    next, in proportion to the time gone; the last segment's end after it."""
    rows = as_of(segments, asked)
    nxt = F.col("following")
    step = F.greatest(nxt["time"] - F.col("time"), F.lit(least_step))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("time")) / step))
    mid = lambda a, b: F.when(nxt.isNull(), a).otherwise(a + (b - a) * share)
    return rows.select("path_id", "t", mid(F.col("lat2"), nxt["lat1"]).alias("lat"), mid(F.col("lon2"), nxt["lon1"]).alias("lon"), mid(F.col("altitude_m"), nxt["altitude_m"]).alias("altitude_m"), mid(F.col("groundspeed_knots"), nxt["groundspeed_knots"]).alias("groundspeed_knots"))


def live_positions(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """(path_id, t, lat, lon, bearing) as a running replay shows them: between two segments in proportion to the whole time
    between their starts, without a least step, looking at the next start; at rest the segment's end and own direction."""
    rows = as_of(segments, asked)
    nxt = F.col("following")
    moving = nxt.isNotNull() & (F.col("time") < F.col("t"))
    share = F.try_divide(F.col("t") - F.col("time"), nxt["time"] - F.col("time"))
    at = lambda a, b: F.when(moving, a + (b - a) * share).otherwise(a)
    ahead = bearing(F.col("lat2"), F.col("lon2"), nxt["lat1"], nxt["lon1"])
    own = bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return rows.select("path_id", "t", at(F.col("lat2"), nxt["lat1"]).alias("lat"), at(F.col("lon2"), nxt["lon1"]).alias("lon"), F.when(moving, ahead).otherwise(own).alias("bearing"))


def bounds(segments: DataFrame) -> DataFrame:
    """(path_id, south, north, west, east) of both ends of each path's timed segments."""
    low = lambda x: F.least(F.min(f"{x}1"), F.min(f"{x}2"))
    high = lambda x: F.greatest(F.max(f"{x}1"), F.max(f"{x}2"))
    return timed(segments).groupBy("path_id").agg(low("lat").alias("south"), high("lat").alias("north"), low("lon").alias("west"), high("lon").alias("east"))


def smoothed_bearings(segments: DataFrame) -> DataFrame:
    """(path_id, seg_idx, bearing) from a segment's end to the start of the fifth one on, or of the last; the last
    segment's own direction at the end."""
    order = Window.partitionBy("path_id").orderBy("seg_idx")
    ahead = order.rowsBetween(Window.currentRow, LOOK_AHEAD)
    rows = segments.select("path_id", "seg_idx", "lat1", "lon1", "lat2", "lon2", F.last("lat1").over(ahead).alias("flat"), F.last("lon1").over(ahead).alias("flon"), F.last("seg_idx").over(ahead).alias("far"))
    at_end = F.col("far") == F.col("seg_idx")
    own = bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return rows.select("path_id", "seg_idx", F.when(at_end, own).otherwise(bearing(F.col("lat2"), F.col("lon2"), F.col("flat"), F.col("flon"))).alias("bearing"))


def valid(segments: DataFrame) -> DataFrame:
    """(path_id, segments, timed, replayable)."""
    return segments.groupBy("path_id").agg(F.count("*").alias("segments"), F.count("time").alias("timed"), (F.count("time") > 0).alias("replayable"))
