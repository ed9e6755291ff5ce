"""Moving the times of logs to the first of January, and checking that it was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.functions.times import parsed

#: Fixed value: how logs write the date of a marker.
_MARKER_DATE = r"^(Log Start|Takeoff|Landing|Log Stop):\s*\d{2}\s+\w{3}\s+(\d{4})\s+\d{2}:\d{2}\s+Z"


def shifted(points: DataFrame) -> DataFrame:
    """`points` (file, seq, ts_raw, ...) with ts_shifted: all times of a file move by as much as takes its first to the
    first of January of its year, same time of day; fractions keep their text, unreadable times stay."""
    at = parsed(F.col("ts_raw"))
    first = points.withColumn("at", at).where("at IS NOT NULL").groupBy("file").agg(F.min_by("at", "seq").alias("start"))
    rows = points.withColumn("at", at).join(first, "file", "left")
    days = F.datediff(F.to_date("start"), F.trunc("start", "year"))
    moved = F.timestamp_micros(F.unix_micros("at") - days.cast("long") * 86_400_000_000)
    fraction = F.regexp_extract("ts_raw", r"(\.\d+)", 1)
    text = F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return rows.withColumn("ts_shifted", F.coalesce(text, "ts_raw")).drop("at", "start")


def marker_without_date(name: Column) -> Column:
    """A marker's name with its date cut to the first of January of the year; nothing may follow the date. violations() finds it
    whatever follows."""
    return F.regexp_replace(name, f"{_MARKER_DATE}$", "$1: $2-01-01")


def obfuscated(points: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A whole dataset moved: its points with shifted times in place of their own, and its markers' names without dates.
    New tables; nothing is changed in place."""
    moved = shifted(points)
    columns = [F.col("ts_shifted").alias("ts_raw") if c == "ts_raw" else F.col(c) for c in points.columns]
    return moved.select(*columns), names.withColumn("name", marker_without_date(F.col("name")))


def violations(points: DataFrame, names: DataFrame) -> DataFrame:
    """(file, reason) of files whose first time is not on the first of January, or whose markers (file, name) hold dates."""
    first = points.withColumn("at", parsed(F.col("ts_raw"))).where("at IS NOT NULL").groupBy("file").agg(F.min_by("at", "seq").alias("at"))
    late = first.where((F.month("at") != 1) | (F.dayofmonth("at") != 1)).select("file", F.lit("first time").alias("reason"))
    return late.union(names.where(F.col("name").rlike(_MARKER_DATE)).select("file", F.lit("marker date").alias("reason"))).distinct()
