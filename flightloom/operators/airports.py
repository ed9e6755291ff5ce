"""Airports: proximity join, de-duplication, names and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightloom import constants as c
from flightloom.functions.geo import cell, haversine_km
from flightloom.functions.names import clean_airport, display_name, icao_codes, is_marker
from flightloom.operators.ranks import rank_within
from flightloom.sources.shared import checkpointed


def near_pairs(places: DataFrame, key: str = "number", km: float = c.AIRPORT_DISTANCE_KM) -> DataFrame:
    """(a, b, km) of places less than `km` apart, a < b.

    Places meet in grid cells: a place joins the cells around its own. The cells' width in longitude follows the latitude
    of their row, so no pair is missed up to 88 degrees, and a join key is a cell, never a whole table.
    """
    step = km / 111.0
    row = cell(F.col("lat"), step)
    # A row's columns are as wide as at its edge nearest to a pole, one row further out for neighbours, and exact there.
    wide = lambda r: F.lit(step) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), (F.greatest(F.abs(r), F.abs(r + 1)) + 1) * step))), F.lit(0.02))
    turn = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    # Columns count from the 180th meridian; the last one of a row may be narrow, so three meet across it.
    columns = lambda r: F.ceil(F.lit(360.0) / wide(r))
    own = places.select(F.col(key).alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), row.alias("r")).withColumn("q", F.floor(turn(F.col("lon2")) / wide(F.col("r"))))
    around = places.select(F.col(key).alias("a"), "lat", "lon", F.explode(F.array(row - 1, row, row + 1)).alias("r"))
    at, n = F.floor(turn(F.col("lon")) / wide(F.col("r"))), columns(F.col("r"))
    across = F.array(F.when(at <= 1, n - 2), F.when(at <= 1, n - 1), F.when(at >= n - 2, F.lit(0)), F.when(at >= n - 2, F.lit(1)))
    around = around.select("a", "lat", "lon", "r", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(at - 1, at, at + 1), across)))).alias("q"))
    pairs = around.join(own, ["r", "q"]).where("a < b")
    pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return pairs.where(F.col("km") < km).select("a", "b", "km")


def clusters(places: DataFrame, key: str = "number", km: float = c.AIRPORT_DISTANCE_KM) -> DataFrame:
    """(key, cluster): places connected through steps below `km`; a cluster is named by its least key.

    Labels sink along the pairs until none changes, and jump to their label's label on the way, so rounds grow with the
    logarithm of the longest chain. This is the order-free rule: a chain is one airport.
    """
    pairs = near_pairs(places, key, km).select("a", "b")
    links = checkpointed(pairs.union(pairs.select("b", "a")))
    labels = checkpointed(places.select(F.col(key).alias("node"), F.col(key).alias("label")).distinct())
    # A label halves its way to the least one at least every round: 64 rounds reach along chains of any length.
    for _ in range(64):
        heard = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        sunk = labels.join(heard, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"))
        jumped = sunk.join(sunk.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = checkpointed(jumped)
        if new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new.select(F.col("node").alias(key), F.col("label").alias("cluster"))
        labels = new
    raise RuntimeError("labels did not settle")


def candidates(info: DataFrame, phases: DataFrame) -> DataFrame:
    """Starts of all paths, then starts and landings of routes: what de-duplication reads, in its order (pass, path, end),
    with the path's timestamp, none for the landing of a path that begins in flight."""
    rows = info.join(phases, "path_id")
    route = F.col("airport_name").contains(" - ") & ~is_marker(F.col("airport_name")) & (F.col("segment_count") >= 1)
    base = ["path_id", F.col("airport_name").alias("name")]
    start = [F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), F.col("timestamp").cast("string").alias("timestamp")]
    end = [F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon"), F.when(~F.col("mid_flight_start"), F.col("timestamp").cast("string")).alias("timestamp")]
    first = rows.where(~is_marker(F.col("airport_name")) & ~F.col("mid_flight_start")).select(F.lit(1).alias("pass"), *base, *start, F.lit(False).alias("at_end"))
    second = rows.where(route & ~F.col("mid_flight_start")).select(F.lit(2).alias("pass"), *base, *start, F.lit(False).alias("at_end"))
    third = rows.where(route & F.col("valid_landing")).select(F.lit(2).alias("pass"), *base, *end, F.lit(True).alias("at_end"))
    return first.union(second).union(third)


def corrected(rows: DataFrame, airports: DataFrame) -> DataFrame:
    """Candidates at the coordinates of the code that their name holds: of two codes in a route the one of this end."""
    codes = icao_codes(F.col("name"))
    two = F.col("name").contains(" - ") & (F.size(codes) == 2)
    code = F.when(two, F.when(F.col("at_end"), codes[1]).otherwise(codes[0])).when(F.size(codes) == 1, codes[0])
    known = airports.groupBy("code").agg(F.max_by(F.struct("lat", "lon"), "number").alias("at"))
    out = rows.withColumn("code", code).join(known, "code", "left")
    return out.withColumn("lat", F.coalesce("at.lat", "lat")).withColumn("lon", F.coalesce("at.lon", "lon")).drop("at")


def _spots(rows: DataFrame) -> DataFrame:
    """(lat, lon, rank, number): one row a pair of coordinates, with its first candidate; `number` sorts them."""
    spots = rows.groupBy("lat", "lon").agg(F.min(F.struct("pass", "path_id", "at_end")).alias("rank"))
    return spots.withColumn("number", F.format_string("%020.10f|%020.10f", F.col("lat") + 90, F.col("lon") + 180))


def gathered(rows: DataFrame) -> DataFrame:
    """One row an airport from its candidates (..., airport): the place and the end of the first, the first name that is no
    marker, else the first one, and `visits`, the distinct timestamps of candidates that are no markers."""
    order = F.struct("pass", "path_id", "at_end")
    named = F.when(F.coalesce("name", F.lit("")) != "", F.struct(is_marker(F.col("name")), order))
    out = rows.groupBy("airport").agg(F.min_by(F.struct("lat", "lon", "at_end"), order).alias("at"), F.min_by("name", named).alias("name"))
    visits = _visits(rows).groupBy("airport").agg(F.count("*").alias("visits"))
    return out.join(visits, "airport", "left").select("at.lat", "at.lon", "name", F.coalesce("visits", F.lit(0).cast("long")).alias("visits"), "at.at_end")


def _visits(rows: DataFrame) -> DataFrame:
    """(airport, timestamp, first): the distinct timestamps of each airport, with the candidate that brought each first."""
    told = rows.where((F.coalesce("timestamp", F.lit("")) != "") & ~is_marker(F.col("name")))
    return told.groupBy("airport", "timestamp").agg(F.min(F.struct("pass", "path_id", "at_end")).alias("first"))


def assigned(rows: DataFrame) -> DataFrame:
    """`rows` with their airport: equal coordinates are one place first, then places connected within the distance. Without an
    order; a chain of places is one airport."""
    spots = checkpointed(_spots(rows))
    return rows.join(spots.join(clusters(spots), "number").select("lat", "lon", F.col("cluster").alias("airport")), ["lat", "lon"])


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row an airport (lat, lon, name, visits, at_end) of assigned() candidates."""
    return gathered(checkpointed(assigned(rows)))


def founders_in_order(spots: DataFrame, km: float = c.AIRPORT_DISTANCE_KM, degrees: float = c.AIRPORT_GRID_DEGREES) -> DataFrame:
    """(number, rank, lat, lon, r, q): the places of `spots` that found an airport: in the order of rank each that has no
    founder before it within `km`, looked for in its own cell of a grid and the eight around it.

    By rounds: a place that is the first to wait in its cell and in those around it founds, for nothing undecided can come
    before it; all that wait within its reach join it. A round compares cells' first places and, once, each waiting place with
    the founders beside it. No task holds a cluster, and work does not grow with the square of a cell's places.
    """
    around = lambda r, q: F.explode(F.array(*[F.struct((F.col(r) + i).alias("r"), (F.col(q) + j).alias("q")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    waiting = checkpointed(spots.select("number", "rank", "lat", "lon", cell(F.col("lat"), degrees).alias("r"), cell(F.col("lon"), degrees).alias("q")))
    found = [waiting.limit(0)]
    while not waiting.isEmpty():
        first = waiting.groupBy("r", "q").agg(F.min(F.struct("rank", "number", "lat", "lon")).alias("first"))
        least = first.select(around("r", "q").alias("at"), F.struct("first.rank", "first.number").alias("key")).groupBy("at.r", "at.q").agg(F.min("key").alias("least"))
        fresh = checkpointed(first.join(least, ["r", "q"]).where(F.struct("first.rank", "first.number") == F.col("least")).select("first.number", "first.rank", "first.lat", "first.lon", "r", "q"))
        near = fresh.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), around("r", "q").alias("at")).select("lat2", "lon2", "at.r", "at.q")
        gone = waiting.join(near, ["r", "q"]).where(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) < km).select("number").distinct()
        waiting = checkpointed(waiting.join(gone, "number", "left_anti"))
        found.append(fresh)
    return checkpointed(reduce(DataFrame.unionByName, found))


def assigned_in_order(rows: DataFrame, km: float = c.AIRPORT_DISTANCE_KM, degrees: float = c.AIRPORT_GRID_DEGREES) -> DataFrame:
    """`rows` with their airport by the order-bound rule: each candidate, in the order (pass, path, end), joins an airport founded
    before it within the distance, the first met cell by cell around its own, else it founds one.

    Airports are further apart than the distance, so few can be within a place's reach: they travel with it, and each of
    its candidates takes the first that was there by then.
    """
    spots = checkpointed(_spots(rows))
    founders = founders_in_order(spots, km, degrees)
    near = founders.select(F.col("number").alias("airport"), F.col("rank").alias("founded"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), (F.col("r") + i).alias("r"), (F.col("q") + j).alias("q")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("at"))
    near = near.select("airport", "founded", "lat2", "lon2", F.struct("at.i", "at.j", "founded").alias("turn"), "at.r", "at.q")
    placed = spots.select("lat", "lon", cell(F.col("lat"), degrees).alias("r"), cell(F.col("lon"), degrees).alias("q"))
    reach = placed.join(near, ["r", "q"]).where(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) < km)
    reach = reach.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("turn", "founded", "airport"))).alias("reach"))
    there = F.filter("reach", lambda x: x["founded"] <= F.struct("pass", "path_id", "at_end"))
    return rows.join(reach, ["lat", "lon"]).select(*rows.columns, F.get(there, F.lit(0))["airport"].alias("airport"))


def deduplicated_in_order(rows: DataFrame) -> DataFrame:
    """One row an airport (lat, lon, name, visits, at_end) of assigned_in_order() candidates."""
    return gathered(checkpointed(assigned_in_order(rows)))


def visit_times(rows: DataFrame, chunk: int = 1_000) -> DataFrame:
    """(airport, part, timestamps): the distinct timestamps of each airport of assigned candidates in the order in which they
    came, at most `chunk` in a row."""
    order = _visits(rows).select("airport", "timestamp", "first.pass", "first.path_id", "first.at_end")
    ranked = rank_within(order, ["airport"], ["pass", "path_id", "at_end"], "place", ties=["timestamp"])
    told = F.transform(F.sort_array(F.collect_list(F.struct("place", "timestamp"))), lambda x: x["timestamp"])
    return ranked.groupBy("airport", F.floor((F.col("place") - 1) / chunk).alias("part")).agg(told.alias("timestamps"))


def exported_times(rows: DataFrame, exported_: DataFrame, chunk: int = 1_000) -> DataFrame:
    """(lat, lon, part, timestamps) of the airports that exported() keeps, as visit_times() has them."""
    order = F.struct("pass", "path_id", "at_end")
    places = rows.groupBy("airport").agg(F.min_by(F.struct("lat", "lon"), order).alias("at")).select("airport", "at.lat", "at.lon")
    return visit_times(rows, chunk).join(places, "airport").join(exported_.select("lat", "lon"), ["lat", "lon"], "left_semi").select("lat", "lon", "part", "timestamps")


def names_of(found: DataFrame) -> DataFrame:
    """One row: how many airports of deduplicated() have a name to show, and these names in order, repeats included."""
    shown = F.when(F.col("at_end"), display_name(F.coalesce("name", F.lit("Unknown")), True)).otherwise(display_name(F.coalesce("name", F.lit("Unknown")), False))
    return found.select(shown.alias("shown")).where(F.coalesce("shown", F.lit("")) != "").agg(F.count("*").alias("num_airports"), F.sort_array(F.collect_list("shown")).alias("airport_names"))


def standard_names(names: DataFrame, airports: DataFrame) -> DataFrame:
    """(name, standard): one known code gives `CODE Name`; a route with two codes has its known ends replaced."""
    known = airports.groupBy("code").agg(clean_airport(F.max_by("name", "number")).alias("clean"))
    codes = icao_codes(F.col("name"))
    rows = names.select("name", codes.alias("codes"), F.get(codes, F.lit(0)).alias("c1"), F.get(codes, F.lit(1)).alias("c2"))
    rows = rows.join(known.select(F.col("code").alias("c1"), F.col("clean").alias("n1")), "c1", "left").join(known.select(F.col("code").alias("c2"), F.col("clean").alias("n2")), "c2", "left")
    full1, full2 = F.concat_ws(" ", "c1", "n1"), F.concat_ws(" ", "c2", "n2")
    parts = F.split("name", " - ")
    route = F.col("name").contains(" - ") & (F.size("codes") == 2)
    any_known = F.col("n1").isNotNull() | F.col("n2").isNotNull()
    left = F.when(F.col("n1").isNotNull(), full1).otherwise(F.get(parts, F.lit(0)))
    right = F.when(F.col("n2").isNotNull(), full2).otherwise(F.get(parts, F.lit(1)))
    standard = F.when(route & any_known, F.concat(left, F.lit(" - "), right)).when((F.size("codes") == 1) & F.col("n1").isNotNull(), full1).otherwise(F.col("name"))
    return rows.select("name", standard.alias("standard"))


def exported(found: DataFrame, countries: DataFrame) -> DataFrame:
    """Airports for export: one a pair of coordinates at four decimals, at least one flight each, with the country of the
    first code in the name."""
    at = F.format_string("%.4f,%.4f", "lat", "lon")
    order = Window.partitionBy(at).orderBy("name", "lat", "lon")
    rows = found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    rows = rows.withColumn("code", F.get(icao_codes(F.col("name")), F.lit(0)))
    country = countries.groupBy("code").agg(F.max_by("country", "number").alias("country"))
    return rows.join(country, "code", "left").select("lat", "lon", "name", F.greatest(F.lit(1).cast("long"), F.col("visits")).alias("flight_count"), "country")


def lookup(spark: SparkSession, csv: str) -> DataFrame:
    """(number, code, name, lat, lon, country) of a CSV of airports: codes of four characters with numeric coordinates and
    a name; of repeated codes `number` tells the last."""
    raw = spark.read.option("header", True).csv(csv)
    rows = raw.select(F.col("ident").alias("code"), F.trim("name").alias("name"), F.expr("try_cast(latitude_deg AS double)").alias("lat"), F.expr("try_cast(longitude_deg AS double)").alias("lon"), F.col("iso_country").alias("country"), F.monotonically_increasing_id().alias("number"))
    return rows.where((F.length("code") == 4) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("name") != ""))
