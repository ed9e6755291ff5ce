"""Views that read the star-schema tables as flight tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def airport_code(number: Column) -> Column:
    """A code of four letters for a number."""
    letter = lambda x: F.char(65 + F.pmod(F.floor(x), F.lit(26)))
    return F.concat(F.lit("E"), letter(number / 676), letter(number / 26), letter(number))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, seq, us, lat, lon, alt_m) from events: a user is a path; microseconds are divided by 1,000."""
    events = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000")
    rows = events.select(
        F.col("user_id").alias("path_id"),
        F.col("event_id"),
        us.alias("us"),
        (F.lit(50.0) + F.col("value") * F.lit(2e-5)).alias("lat"),
        (F.lit(10.0) + (F.col("event_id") % 97) * F.lit(1e-4)).alias("lon"),
        (F.col("value") * 10).alias("alt_m"),
    )
    order = Window.partitionBy("path_id").orderBy("us", "event_id")
    return rows.withColumn("seq", F.row_number().over(order)).drop("event_id")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, year, registration, aircraft_type, airport_name, filename): what a path's file would say of it."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id")).distinct()
    p = F.col("path_id")
    start, end = airport_code(p % 10), airport_code((p * 7 + 3) % 10)
    kinds = F.array(*map(F.lit, ("C172", "DA20", "DA40", "C182")))
    number = F.lpad((p % 7).cast("string"), 3, "0")
    return ids.select(
        p,
        (2024 + p % 3).cast("int").alias("year"),
        F.concat(F.lit("D-E"), number).alias("registration"),
        F.element_at(kinds, (p % 4 + 1).cast("int")).alias("aircraft_type"),
        F.concat_ws(" - ", start, end).alias("airport_name"),
        F.when(p % 2 == 0, F.concat(p.cast("string"), F.lit("_DE"), number, F.lit("_DA20.kml"))).otherwise(F.concat(F.lit("2026-01-12_1513h_OE-"), number, F.lit("_"), start, F.lit("-"), end, F.lit(".kml"))).alias("filename"),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, code, name, lat, lon, country) from supplier."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(k.alias("number"), airport_code(k % 17576).alias("code"), F.concat(F.col("s_name"), F.lit(" Airport")).alias("name"), (48 + (k % 10) * F.lit(0.03)).alias("lat"), (9 + F.floor(k / 10) * F.lit(0.015)).alias("lon"), F.col("n_name").alias("country"))
