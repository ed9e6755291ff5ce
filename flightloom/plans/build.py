"""The batch build: KML logs to yearly datasets, airports and metadata."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.operators import airports as ports
from flightloom.operators import stats, tracks
from flightloom.plans import filters
from flightloom.sources import kml, sinks
from flightloom.sources.shared import checkpointed


def tracks_of(spark: SparkSession, source: str, store: str, ending: str = ".kml") -> tuple[DataFrame, DataFrame]:
    """(points, paths) of the logs under `source`, parsed once into `store`: a path is an element with points that have an
    altitude. A path's id follows from its file's path and its place there, so it is the same in every build."""
    kml.parse_new(spark, source, store, ending)
    rows = kml.parsed_store(spark, store, "points").withColumn("path_id", F.xxhash64("path", "at", "element", "kind"))
    rows = tracks.validated(rows).where("alt_m IS NOT NULL")
    points = rows.select("path_id", (F.col("seq") + 1).alias("seq"), F.unix_micros("ts").alias("us"), "lat", "lon", "alt_m", "path", "file", "ts_raw")
    ids = rows.select("path_id", "path", "at").distinct()
    paths = kml.parsed_store(spark, store, "metadata").join(ids, ["path", "at"]).withColumn("filename", F.col("file"))
    return points, paths


def bounds(points: DataFrame) -> DataFrame:
    """One row: least and greatest latitude and longitude, and their middle."""
    b = points.agg(*[f(x).alias(f"{n}_{x}") for x in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    return b.withColumn("mid_lat", (F.col("min_lat") + F.col("max_lat")) / 2).withColumn("mid_lon", (F.col("min_lon") + F.col("max_lon")) / 2)


def build(spark: SparkSession, source: str, out: str, airports: DataFrame | None = None, strip_times: bool = True, ending: str = ".kml") -> None:
    """Writes segments, path info, airports and metadata under `out`; what was parsed is kept beside them, so that a later
    build parses new and changed logs only."""
    points, paths = tracks_of(spark, source, f"{out}/_parsed", ending)
    write(spark, points, paths, out, airports, strip_times)


def write(spark: SparkSession, points: DataFrame, paths: DataFrame, out: str, airports: DataFrame | None = None, strip_times: bool = True) -> None:
    """The datasets of any points and paths, as build() writes them; the airports' visit times only if not `strip_times`."""
    legs, segments = tracks.cruised(points)
    info = stats.path_info(points, legs, paths)
    sinks.write_years(segments, info, out)
    saved, saved_info = (sinks.read_year(spark, out, name) for name in ("segments", "path_info"))
    if airports is not None:
        found = ports.corrected(ports.candidates(saved_info, tracks.flight_phases(points)), airports)
        found = checkpointed(ports.assigned(found))
        kept = checkpointed(ports.exported(ports.gathered(found), airports))
        sinks.write_airports(kept, out, None if strip_times else ports.exported_times(found, kept))
    statistics = filters.statistics(saved.drop("year"), saved_info).withColumn("one", F.lit(1))
    sinks.write_metadata(statistics.join(bounds(points).withColumn("one", F.lit(1)), "one").drop("one"), saved_info, out)


def main() -> None:
    """python -m flightloom.plans.build SOURCE OUT [AIRPORTS_CSV]"""
    source, out, *csv = sys.argv[1:]
    spark = SparkSession.builder.appName("flightloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    build(spark, source, out, ports.lookup(spark, csv[0]) if csv else None)


if __name__ == "__main__":
    main()
