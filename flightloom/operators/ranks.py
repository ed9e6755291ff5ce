"""Places of rows among those of equal keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.sources.shared import checkpointed


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, ties: list[str] | None = None) -> DataFrame:
    """`df` with the place (long, from 1) of each row among those of equal `keys` (null is a key), by `order`, then `ties`, nulls
    first. Rows are dealt by ranges of keys and order, so one key's rows spread over many tasks: each range counts its own, and
    begins where the ranges before it end. A range has at most one key that began before it: that bounds the broadcast."""
    dealt = checkpointed(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *keys).orderBy(*order, *(ties or ()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), before.alias("_before")).where("_before > 0")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = dealt.withColumn(name, F.row_number().over(own).cast("long")).join(F.broadcast(starts), same, "left")
    return ranked.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
