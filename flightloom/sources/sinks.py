"""Datasets written by year, airports and metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.sources.shared import remove_folder


def write_years(segments: DataFrame, info: DataFrame, out: str) -> None:
    """Segments and path info as Parquet, a folder a year; a path without year goes to the null folder. Overwrites.

    Rows are rebalanced by year: a task writes one year, as many tasks to a year as its rows ask for.
    """
    with_year = segments.join(info.select("path_id", "year"), "path_id", "left")
    for name, df in (("segments", with_year), ("path_info", info)):
        df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{out}/{name}")


def years_of(spark: SparkSession, out: str) -> list[int]:
    """The years of a dataset, in order: a folder each."""
    rows = spark.read.parquet(f"{out}/path_info").where("year IS NOT NULL").select("year").distinct()
    return sorted(r["year"] for r in rows.collect())


def combined(spark: SparkSession, out: str, name: str, years: list[int]) -> DataFrame:
    """The parts of some years in one table; years that are not there add nothing."""
    return read_year(spark, out, name).where(F.col("year").isin(*years))


def read_airports(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("lat double, lon double, name string, flight_count long, country string").json(f"{out}/airports")


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """available_years and the statistics, one column each."""
    rows = spark.read.json(f"{out}/metadata")
    return rows.select("available_years", "stats.*")


def read_year(spark: SparkSession, out: str, name: str, year: str = "all") -> DataFrame:
    """One year's part, found by its folder, or all years. Years are `all` or 2000 to 2099."""
    if year != "all" and not (year.isdigit() and 2000 <= int(year) <= 2099):
        raise ValueError(f"no such year: {year!r}")
    if name not in ("segments", "path_info"):
        raise ValueError(f"no such dataset: {name!r}")
    rows = spark.read.parquet(f"{out}/{name}")
    return rows if year == "all" else rows.where(F.col("year") == int(year))


def write_airports(airports: DataFrame, out: str, times: DataFrame | None = None) -> None:
    """The airports, and beside them `times` (lat, lon, part, timestamps), unless they are to be left out for privacy; times
    written before go then too."""
    airports.write.mode("overwrite").json(f"{out}/airports")
    if times is None:
        remove_folder(airports.sparkSession, f"{out}/airport_times")
    else:
        times.write.mode("overwrite").json(f"{out}/airport_times")


def read_airport_times(spark: SparkSession, out: str) -> DataFrame:
    """(lat, lon, part, timestamps); no rows if they were left out."""
    shape = "lat double, lon double, part long, timestamps array<string>"
    try:
        return spark.read.schema(shape).json(f"{out}/airport_times")
    except AnalysisException:
        return spark.createDataFrame([], shape)


def metadata(statistics: DataFrame, info: DataFrame) -> DataFrame:
    """One row of JSON: the statistics, non-finite numbers as 0 and others with one decimal, and the years present."""
    sound = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.bround(c, 1)).alias(c) if t == "double" else F.col(c) for c, t in statistics.dtypes]
    years = info.where("year IS NOT NULL AND year <> 0").agg(F.sort_array(F.collect_set("year")).alias("available_years"), F.lit(1).alias("one"))
    rows = statistics.select(F.struct(*sound).alias("stats"), F.lit(1).alias("one")).join(years, "one").drop("one")
    return rows.select(F.to_json(F.struct("available_years", "stats")).alias("value"))


def write_metadata(statistics: DataFrame, info: DataFrame, out: str) -> None:
    metadata(statistics, info).write.mode("overwrite").text(f"{out}/metadata")
