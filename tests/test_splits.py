"""Paths, places and years that are too long for one task: the split forms give the rows of the plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flightloom.operators import airports, stats, tracks
from flightloom.operators.ranks import rank_within
from flightloom.plans import filters, replay
from flightloom.sources import sinks

LEGS = "path_id long, seq long, us long, lat double, lon double, alt_m double"
SEGMENTS = "path_id long, seg_idx long, lat1 double, lon1 double, lat2 double, lon2 double, altitude_m double, groundspeed_knots double, time double"


def haversine(a, b, radius=6371.0):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rounded(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_groundspeed_of_split_paths_is_the_same(spark, uncoalesced):
    rng = random.Random(1)
    rows, at = [], 0
    for path, n in ((1, 2_000), (2, 90), (3, 1), (4, 40)):
        at = 1_700_000_000_000_000
        for i in range(1, n + 1):
            at += rng.choice([0, 1_000_000, 7_000_000, 60_000_000, 60_000_001, 400_000_000])
            rows.append((path, i, None if path == 4 or rng.random() < 0.02 else at, 50 + i * 1e-4 * rng.random(), 8.0, rng.choice([None, 100.0])))
    points = spark.createDataFrame(rows, LEGS)
    legs = tracks.legs(points)
    for piece in (1, 7, 500, 10**6):
        assert rounded(tracks.legs_split(points, piece).select(legs.columns)) == rounded(legs)
    want = rounded(tracks.with_groundspeed(legs).select("path_id", "seg_idx", "gs", "window_km", "window_s"))
    for piece in (1, 60, 3_600, 10**9):
        assert rounded(tracks.with_groundspeed_split(legs, piece).select("path_id", "seg_idx", "gs", "window_km", "window_s")) == want
    parts = tracks.with_groundspeed_split(tracks.legs_split(points, 100), 60).where("path_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1_000
    whole = tracks.cruised(points)
    for found, plain in zip(tracks.cruised(points, long_path=80), whole, strict=True):
        assert rounded(found.select(plain.columns)) == rounded(plain)


def test_as_of_one_path_with_nine_tenths_of_the_rows(spark, uncoalesced):
    rng = random.Random(2)
    rows = [(1, i, float(i), 0.0, 1.0, 1.0, 5.0, 9.0, round(rng.random() * 90_000, 1)) for i in range(4_500)] + [(p, i, 0.0, 0.0, 1.0, 1.0, 5.0, 9.0, float(rng.choice([None, i * 700, i * 700]) or 0) if i else None) for p in range(2, 52) for i in range(10)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    asked = spark.createDataFrame([(p, rng.choice([-5.0, 0.0, 1e6, rng.random() * 90_000])) for p in range(1, 55) for _ in range(60)], "path_id long, t double")
    for first in (True, False):
        want = rounded(replay.as_of(segments, asked, first))
        for seconds in (100, 3_600, 10**7):
            assert rounded(replay.as_of_split(segments, asked, first, seconds)) == want
    calls = spark.createDataFrame([(1, float(t)) for t in range(0, 90_000, 20)], "path_id long, t double")
    parts = [r["count"] for r in replay.as_of_split(segments, calls, False, 600).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) >= 4_490 and max(parts) < 0.6 * sum(parts)


def test_before_a_path_its_last_segment_with_the_first_time_counts(spark):
    rows = [(1, i, float(i), 0.0, 1.0, 1.0, 5.0, 9.0, t) for i, t in enumerate([3.0, 3.0, 8.0])]
    segments, asked = spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([(1, 1.0)], "path_id long, t double")
    for found in (replay.as_of(segments, asked), replay.as_of_split(segments, asked), replay.as_of_split(segments, asked, bucket_seconds=2)):
        assert [(r["seg_idx"], r["following"]["seg_idx"]) for r in found.collect()] == [(1, 2)]
    assert replay.as_of(segments, asked, False).where("seg_idx IS NOT NULL").isEmpty()


def plain_in_order(rows):
    """{(lat, lon): (name, timestamps)} by walking the candidates one after another."""
    grid, found = {}, []
    key = lambda lat, lon: (math.floor(lat / 0.018), math.floor(lon / 0.018))
    marker = lambda n: not n or n.startswith("Log")
    for p, i, e, name, lat, lon, t in sorted(rows, key=lambda r: r[:3]):
        at = key(lat, lon)
        near = (x for a in (-1, 0, 1) for b in (-1, 0, 1) for x in grid.get((at[0] + a, at[1] + b), ()))
        hit = next((x for x in near if haversine(found[x][:2], (lat, lon)) < 1.5), None)
        told = [t] if t and not marker(name) else []
        if hit is None:
            grid.setdefault(at, []).append(len(found))
            found.append([lat, lon, name, told])
        else:
            found[hit][3] += [x for x in told if x not in found[hit][3]]
            if name and (not found[hit][2] or (marker(found[hit][2]) and not marker(name))):
                found[hit][2] = name
    return {(a, b): (n or None, ts) for a, b, n, ts in found}


def test_places_in_order_match_a_plain_walk(spark):
    rng = random.Random(3)
    spots = [(round(60 + rng.random() * 0.15, 4), round(8 + rng.random() * 0.25, 4)) for _ in range(120)]
    rows = [(rng.randint(1, 2), i, rng.random() < 0.5, rng.choice(["EDDF - EDDM", "Log Start: x", None, f"place {i}"]), *rng.choice(spots), rng.choice([None, "", f"t{i % 50}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "pass int, path_id long, at_end boolean, name string, lat double, lon double, timestamp string")
    want = plain_in_order(rows)
    found = airports.assigned_in_order(df).cache()
    got = {(r["lat"], r["lon"]): r for r in airports.gathered(found).collect()}
    assert {k: (r["name"], r["visits"]) for k, r in got.items()} == {k: (n, len(ts)) for k, (n, ts) in want.items()}
    places = {r["airport"]: (r["lat"], r["lon"]) for r in found.groupBy("airport").agg(F.min_by("lat", F.struct("pass", "path_id", "at_end")).alias("lat"), F.min_by("lon", F.struct("pass", "path_id", "at_end")).alias("lon")).collect()}
    times = {}
    for r in airports.visit_times(found, chunk=3).orderBy("airport", "part").collect():
        assert len(r["timestamps"]) <= 3
        times.setdefault(places[r["airport"]], []).extend(r["timestamps"])
    assert times == {k: ts for k, (_, ts) in want.items() if ts}
    assert airports.deduplicated_in_order(df.limit(0)).count() == 0


def test_a_crowded_place_founds_in_few_rounds(spark):
    df = spark.range(20_000).select(F.lit(1).alias("pass"), F.col("id").alias("path_id"), F.lit(False).alias("at_end"), F.lit("EDDF - EDDM").alias("name"), (50 + F.pmod(F.xxhash64("id"), F.lit(1_000)) * 1e-6).alias("lat"), (8 + F.col("id") * 1e-8).alias("lon"), F.lit("t").alias("timestamp"))
    assert airports.deduplicated_in_order(df).count() == 1


def test_merged_years_have_the_mode_of_all(spark):
    rng = random.Random(4)
    rows = [(p, i, rng.choice([True, True, False]), rng.choice([1000, 1100, 1200, 1300]), float(rng.randint(1, 4)), 1.0, 100.0) for p in range(30) for i in range(20)]
    cruise = spark.createDataFrame(rows, "path_id long, seg_idx long, cruising boolean, bin_ft long, window_s double, km double, gs double").withColumn("window_km", F.col("km"))
    paths = spark.createDataFrame([(p, rng.choice([2024, 2025, None])) for p in range(30)], "path_id long, year int")
    parts = stats.cruise_by_year(cruise, paths)
    want, whole = stats.merged_years(parts).first(), stats.cruise(cruise).first()
    assert (want["mode_bin_ft"], want["cruise_seconds"]) == (whole["mode_bin_ft"], whole["cruise_seconds"])
    again = stats.merged_years(parts.where("year = 2024").unionByName(parts.where("year IS NULL OR year <> 2024"))).first()
    assert again == want
    none = stats.merged_years(stats.cruise_by_year(cruise.where("NOT cruising"), paths)).first()
    assert none["mode_bin_ft"] is None and none["max_gs"] == 100.0


def test_heat_is_the_product_of_two_kernels(spark):
    points = spark.createDataFrame([(50.0005, 8.0005), (50.0005, 8.0005), (50.0035, 8.0105)], "lat double, lon double")
    got = {(r["row"], r["col"]): r["heat"] for r in filters.heat(points, radius=2, blur=3).collect()}
    weight = lambda d: max(0.0, min(1.0, (5 - abs(d)) / 3))
    cells = [(50000, 8000, 2), (50003, 8010, 1)]
    for (r, q), heat in got.items():
        assert heat == pytest.approx(sum(n * weight(r - a) * weight(q - b) for a, b, n in cells))
    assert all((r, q) in got for a, b, _ in cells for r in range(a - 4, a + 5) for q in range(b - 4, b + 5)) and len(got) <= 162


def test_times_of_airports_are_written_or_stripped(spark, tmp_path):
    ports = spark.createDataFrame([(50.0, 8.0, "A", 2, "DE")], "lat double, lon double, name string, flight_count long, country string")
    times = spark.createDataFrame([(50.0, 8.0, 0, ["a", "b"])], "lat double, lon double, part long, timestamps array<string>")
    sinks.write_airports(ports, str(tmp_path), times)
    assert [r["timestamps"] for r in sinks.read_airport_times(spark, str(tmp_path)).collect()] == [["a", "b"]]
    sinks.write_airports(ports, str(tmp_path))
    assert sinks.read_airport_times(spark, str(tmp_path)).count() == 0 and sinks.read_airports(spark, str(tmp_path)).count() == 1


def test_ranks_go_on_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 2]), rng.choice([None, *range(30)]), i) for i in range(600)]
    got = {r["i"]: r["n"] for r in rank_within(spark.createDataFrame(rows, "k long, at long, i long").repartition(5), ["k"], ["at"], "n", ties=["i"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
