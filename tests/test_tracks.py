"""Points, legs and the batch build on small tracks."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from flightloom.functions import times, urls
from flightloom.operators import airports, tracks
from flightloom.plans import filters, privacy
from flightloom.plans.build import build
from flightloom.sources import kml, sinks

SCHEMA = "path_id long, seq int, us long, lat double, lon double, alt_m double"


def haversine(a, b, radius=6371.0):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(h))


def test_validated_points(spark):
    rows = [(1, 1, None, 91.0, 0.0, 5.0), (1, 2, None, 50.0, float("nan"), 5.0), (1, 3, None, 50.0, 8.0, -20.0), (1, 4, None, 50.0, 8.0, 99_999.0), (1, 5, None, None, 8.0, 1.0)]
    got = {r["seq"]: r["alt_m"] for r in tracks.validated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: 0.0, 4: None}


def test_legs_and_groundspeed(spark):
    place = [(50.0, 8.0), (50.0, 8.01), (50.01, 8.01), (50.01, 8.01)]
    rows = [(1, i + 1, i * 20_000_000, a, b, 100.0) for i, (a, b) in enumerate(place)] + [(2, 1, 0, 1.0, 1.0, 0.0)]
    df = tracks.with_groundspeed(tracks.legs(spark.createDataFrame(rows, SCHEMA)))
    got = {r["seg_idx"]: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2]  # a path of one point has no leg
    for i in range(3):
        assert got[i]["km"] == pytest.approx(haversine(place[i], place[i + 1]), rel=1e-9)
    moving = haversine(place[0], place[1]) + haversine(place[1], place[2])
    assert got[0]["gs"] == pytest.approx(moving / 1.852 / (40 / 3600), rel=1e-9)
    assert tracks.segments(df).count() == 2  # the leg between equal places goes


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tracks.segments(tracks.with_cruise(tracks.with_groundspeed(tracks.legs(empty)))).count() == 0
    assert tracks.flight_phases(empty).count() == 0


def log(*placemarks):
    return '<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>' + "".join(placemarks) + "</Document></kml>"


def test_geometries_at_any_depth_and_one_track_a_file(spark, tmp_path):
    point = lambda i: f"<gx:coord>8.{i} 50.{i} {100 + i}</gx:coord>"
    when = lambda i: f"<when>2025-03-01T10:0{i}:00Z</when>"
    multi = "<Placemark><name>Many</name><MultiGeometry><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString><LineString><coordinates>7,8</coordinates></LineString><MultiGeometry><Point><coordinates>9,10,11</coordinates></Point></MultiGeometry></MultiGeometry></Placemark>"
    first = f"<Placemark><name>EDDF - EDDM</name><gx:Track>{when(0)}{when(1)}{point(0)}{point(1)}</gx:Track></Placemark>"
    second = f"<Placemark><name>Later</name><gx:MultiTrack><gx:Track>{when(2)}{point(2)}</gx:Track><gx:Track>{when(3)}{point(3)}</gx:Track></gx:MultiTrack></Placemark>"
    apart = f"<Placemark><name>Times</name><gx:Track>{when(0)}{when(1)}{when(2)}</gx:Track></Placemark><Placemark><name>Places</name><gx:Track>{point(0)}{point(1)}{point(2)}</gx:Track></Placemark>"
    fewer = f"<Placemark><name>x</name><gx:Track>{when(0)}{point(0)}{point(1)}</gx:Track></Placemark>"
    for name, text in (("a.kml", log(multi, first, second)), ("b.KML", log(apart)), ("c.kml", log(fewer)), ("d.kml", log(first).replace("gx:", "")), ("e.txt", log(first)), ("f.kml", "")):
        (tmp_path / name).write_text(text)
    found, points, _ = kml.parsed_logs(spark, str(tmp_path))
    rows = points.collect()
    of = lambda file, kind: sorted((r for r in rows if r["file"] == file and r["kind"] == kind), key=lambda r: (r["at"], r["element"], r["seq"]))
    assert [(r["lon"], r["alt_m"], r["at"]) for r in of("a.kml", "coordinates")] == [(1, 3, 0), (4, 6, 0), (7, None, 0), (9, 11, 0)]
    assert len({r["element"] for r in of("a.kml", "coordinates")}) == 3
    assert [(r["at"], r["seq"], r["alt_m"], r["ts_raw"]) for r in of("a.kml", "track")] == [(1, i, 100 + i, f"2025-03-01T10:0{i}:00Z") for i in range(4)]
    assert [(r["at"], r["seq"], r["ts_raw"]) for r in of("b.KML", "track")] == [(1, i, f"2025-03-01T10:0{i}:00Z") for i in range(3)]
    assert [r["ts_raw"] for r in of("c.kml", "track")] == [None, None] and len(of("d.kml", "track")) == 2
    report = {r["file"]: r["fault"] for r in kml.fault_report(kml.listing(spark, str(tmp_path)), found, points).collect()}
    assert report == {"a.kml": None, "b.KML": None, "c.kml": None, "d.kml": None, "e.txt": "not a .kml file", "f.kml": "empty"}


def test_one_scan_reads_points_and_metadata(spark, tmp_path):
    (tmp_path / "a.kml").write_text(log("<Placemark><name>A</name><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark>"))
    scans = lambda df: df._jdf.queryExecution().toString().count("FileScan xml")
    assert scans(kml.elements(spark, str(tmp_path))) == 1
    found, points, facts = kml.parsed_logs(spark, str(tmp_path))
    assert scans(points) == scans(facts) == scans(found) == 0 and points.count() == 2 and facts.count() == 1


def test_faults_of_logs_are_told_and_malformed_ones_give_nothing(spark, tmp_path):
    line = "<Placemark><name>A</name><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark>"
    texts = {"good [1] a+b.kml": log(line), "cut.kml": log(line, line)[:-40], "entity.kml": log(line, "<Placemark><name>A & B</name></Placemark>"), "text.kml": "no xml", "none.kml": "<kml></kml>", "bare.kml": log("<Placemark><name>x</name></Placemark>"), "bad.kml": log(line.replace("1,2,3 4,5,6", "x,y")), "empty.kml": "", "log.txt": log(line)}
    (tmp_path / "deep").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        (tmp_path / "deep" / name).write_text(text)
    want = {"good [1] a+b.kml": None, "cut.kml": "malformed", "entity.kml": "malformed", "text.kml": "malformed", "none.kml": "no placemarks", "bare.kml": "no coordinates", "bad.kml": "no coordinates", "empty.kml": "empty", "log.txt": "not a .kml file"}
    store = str(tmp_path.parent / f"{tmp_path.name}-store")
    kml.parse_new(spark, str(tmp_path), store)
    rows = kml.store_faults(spark, str(tmp_path), store).collect()
    assert sorted((r["file"], r["fault"]) for r in rows) == sorted([*want.items(), *want.items()], key=lambda x: (x[0], x[1] or ""))
    points = kml.parsed_store(spark, store, "points")
    assert {r["file"] for r in points.collect()} == {"good [1] a+b.kml"} and points.count() == 4
    assert kml.track_points(kml.elements(spark, str(tmp_path), keep_broken=True)).where("file = 'cut.kml'").count() == 4
    assert kml.listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_bare_names_count_only_where_there_are_no_others(spark, tmp_path):
    marked, bare = "<Placemark><gx:Track><gx:coord>1 2 3</gx:coord></gx:Track></Placemark>", "<Placemark><Track><coord>4 5 6</coord></Track></Placemark>"
    line = "<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>7,8,9</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    for name, parts in {"both": (bare, marked), "alone": (bare, bare), "beside": (bare, line)}.items():
        (tmp_path / f"{name}.kml").write_text(log(*parts))
    rows = kml.track_points(kml.elements(spark, str(tmp_path))).collect()
    assert sorted((r["file"], r["lon"], r["at"]) for r in rows) == [("alone.kml", 4, 0), ("alone.kml", 4, 0), ("beside.kml", 7, 1), ("both.kml", 1, 1)]


def test_logs_of_equal_names_keep_apart_and_vanished_ones_go(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    track = lambda n: log("<Placemark><name>A</name><LineString><coordinates>" + " ".join(f"{i},{i},{i}" for i in range(n)) + "</coordinates></LineString></Placemark>")
    for folder, n in (("a", 2), ("b", 3)):
        (logs / folder).mkdir(parents=True)
        (logs / folder / "log.kml").write_text(track(n))
    counts = lambda: sorted(r["count"] for r in kml.parsed_store(spark, store, "points").groupBy("path").count().collect())
    assert kml.parsed_store(spark, store, "points").count() == 0
    assert kml.parse_new(spark, str(logs), store) == 2 and counts() == [2, 3]
    os.utime(logs / "a" / "log.kml", (1_900_000_000, 1_900_000_000))  # touched, but its contents are as they were
    assert kml.parse_new(spark, str(logs), store) == 0 and counts() == [2, 3]
    (logs / "b" / "log.kml").unlink()
    (logs / "c").mkdir()
    (logs / "c" / "log.kml").write_text(track(5))
    assert kml.parse_new(spark, str(logs), store) == 1 and counts() == [2, 5]
    assert sorted(r["count"] for r in kml.parsed_store(spark, store, "points", 1).groupBy("path").count().collect()) == [2, 3]
    (tmp_path / "store" / "manifest" / "version=9").mkdir()  # a version whose job never ended
    assert counts() == [2, 5]
    assert kml.parse_new(spark, str(logs), store) == 0


def test_written_logs_read_back(spark, tmp_path):
    made = kml.synthetic_points(spark, 5, 40)
    rows = made.withColumn("ts_raw", F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).withColumn("name", F.lit("A & <B>"))
    for i, long_points in enumerate((1_000, 15)):
        folder = str(tmp_path / str(i))
        kml.write_logs(rows, folder, long_points)
        found, points, facts = kml.parsed_logs(spark, folder, "*.txt")
        assert found.select("path").distinct().count() == 5 and {r["name"] for r in facts.collect()} == {"A & <B>"}
        got = sorted((r["lat"], r["lon"], r["alt_m"], r["us"]) for r in points.select("lat", "lon", "alt_m", F.unix_micros("ts").alias("us")).collect())
        assert got == sorted((r["lat"], r["lon"], r["alt_m"], r["us"]) for r in made.collect())


def test_dates_of_names_descriptions_and_markers(spark):
    rows = spark.createDataFrame([("03  Mar\t2025", "Flight Jan 12 2026 03:01PM path", "Takeoff: 03 Mar 2025 08:58 Z (RWY 07)"), ("x 2025-03-01", "Flight march 2 2026 12:30AM", "Takeoff: 2025-01-01"), ("3 Mar 2025", "Flight Feb 30 2026 01:00PM", "Landing: 03 Mar 2025 08:58 Z"), (None, "Flight Jan 2 2026 13:00PM", None)], "name string, description string, marker string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = rows.select(times.date_in_name(F.col("name")).alias("d"), times.charter_start(F.col("description")).alias("c")).collect()
        assert [tuple(r) for r in got] == [("03  Mar\t2025", "2026-01-12T15:01:00+00:00"), ("2025-03-01", "2026-03-02T00:30:00+00:00"), (None, None), (None, None)]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    points = spark.createDataFrame([], "file string, seq long, ts_raw string")
    marks = rows.select(F.col("marker").alias("file"), F.col("marker").alias("name"))
    assert {r["file"] for r in privacy.violations(points, marks).collect()} == {"Takeoff: 03 Mar 2025 08:58 Z (RWY 07)", "Landing: 03 Mar 2025 08:58 Z"}


def test_states_of_urls(spark):
    texts = ["https://x.org/?y=2025&a=D-E001&p=1,2,x,7b&v=110101&lat=50.5&lng=8.25&z=99#top", "https://x.org/a?lat=95&lng=1&z=0.2&v=12&y=", "https://x.org/a", "?p=7&z=7.9x&v=11111111112", "?y=2024&y=2025&a=all&lat=-90&lng=-180&v=100100000", "?y=%zz&p=%2C-3%2C", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(urls.state(urls.query_of(F.col("t"))).alias("s")).select("s.*", urls.written(F.col("s")).alias("w")).collect()
    assert tuple(rows[0]) == ("2025", "D-E001", [1, 2, 7], "110101000", 50.5, 8.25, 18.0, "y=2025&a=D-E001&p=1%2C2%2C7&v=110101000&lat=50.500000&lng=8.250000&z=18.00")
    assert tuple(rows[1]) == (None, None, [], None, None, None, 1.0, "z=1.00") and tuple(rows[2])[:7] == (None, None, [], None, None, None, None)
    assert (rows[3]["selected"], rows[3]["visible"], rows[3]["zoom"]) == ([7], None, 7.9)
    assert (rows[4]["year"], rows[4]["lat"], rows[4]["lng"], rows[4]["w"]) == ("2024", -90.0, -180.0, "y=2024&lat=-90.000000&lng=-180.000000")
    assert rows[5]["year"] == "%zz" and rows[5]["selected"] == [-3] and rows[6]["selected"] == []


def test_only_new_and_changed_logs_are_parsed(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    track = lambda n: log("<Placemark><name>A</name><LineString><coordinates>" + " ".join(f"{i},{i},{i}" for i in range(n)) + "</coordinates></LineString></Placemark>")
    (logs / "1_x.kml").write_text(track(2))
    (logs / "2_y.kml").write_text(track(3))
    assert kml.parse_new(spark, str(logs), store) == 2 and kml.parse_new(spark, str(logs), store) == 0
    (logs / "2_y.kml").write_text(track(5))
    os.utime(logs / "2_y.kml", (2_000_000_000, 2_000_000_000))
    (logs / "3_z.kml").write_text(track(1))
    assert kml.parse_new(spark, str(logs), store) == 2
    counts = {r["file"]: r["count"] for r in kml.parsed_store(spark, store, "points").groupBy("file").count().collect()}
    assert counts == {"1_x.kml": 2, "2_y.kml": 5, "3_z.kml": 1}
    assert kml.parsed_store(spark, store, "metadata").count() == 3


def plain_airports(rows):
    """Candidates one after another, as the order-bound rule reads: the places founded."""
    grid, found = {}, []
    for _, _, _, lat, lon in sorted(rows):
        at = (math.floor(lat / 0.018), math.floor(lon / 0.018))
        near = (i for a in (-1, 0, 1) for b in (-1, 0, 1) for i in grid.get((at[0] + a, at[1] + b), ()))
        if not any(haversine(found[i], (lat, lon)) < 1.5 for i in near):
            grid.setdefault(at, []).append(len(found))
            found.append((lat, lon))
    return found


def test_airports_in_order_match_a_plain_walk(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 2), i, rng.random() < 0.5, round(50 + rng.random() * 0.2, 5), round(8 + rng.random() * 0.2, 5)) for i in range(150)]
    df = spark.createDataFrame([(p, i, f"EDDF - EDD{chr(65 + i % 26)}", lat, lon, f"t{i % 40}", e) for p, i, e, lat, lon in rows], "pass int, path_id long, name string, lat double, lon double, timestamp string, at_end boolean")
    got = airports.deduplicated_in_order(df).collect()
    assert sorted((r["lat"], r["lon"]) for r in got) == sorted(plain_airports(rows))
    joined = airports.deduplicated(df).collect()
    assert 0 < len(joined) < len(got) and sum(r["visits"] for r in joined) >= 40


def test_places_meet_across_the_180th_meridian_and_near_poles(spark):
    rng = random.Random(5)
    places = [(rng.choice((0, 45, 70, 86)) + rng.random() * 0.05, x) for x in [180 - rng.random() * 0.05 for _ in range(60)] + [-180 + rng.random() * 0.05 for _ in range(60)]] + [(10.0, 180.0), (10.0, -180.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(places)], "number long, lat double, lon double")
    want = {(i, j) for i in range(len(places)) for j in range(i + 1, len(places)) if haversine(places[i], places[j]) < 1.5}
    assert any((places[i][1] > 0) != (places[j][1] > 0) for i, j in want)
    assert {(r["a"], r["b"]) for r in airports.near_pairs(df).collect()} == want


def test_gain_between_paths_follows_their_order(spark):
    rng = random.Random(2)
    rows = [(p, s, rng.choice((None, 10.0, 40.0, 90.0))) for p in range(40) for s in range(rng.randint(1, 4))] + [(99, 0, None)]
    whole = [a for _, _, a in sorted(rows, key=lambda r: r[:2]) if a is not None]
    df = spark.createDataFrame([(p, s, a, 1.0, 5.0, None) for p, s, a in rows], "path_id long, seg_idx long, altitude_m double, km double, groundspeed_knots double, time double")
    assert filters.gain_across(df).first()["gain_m"] == sum(max(0, b - a) for a, b in zip(whole, whole[1:]))
    assert filters.gain_across(df.where("path_id > 1000")).first()["gain_m"] == 0


def test_airport_table_and_models(spark, tmp_path):
    (tmp_path / "airports.csv").write_text("ident,name,latitude_deg,longitude_deg,iso_country\nEDDF,Frankfurt Airport,50.03,8.57,DE\nEDDF,Frankfurt,50.04,8.58,DE\nXX,Short,1,2,FR\nEDDM,,48,11,DE\nEDDN,Bad,x,11,DE\n")
    rows = airports.lookup(spark, str(tmp_path / "airports.csv"))
    assert [(r["code"], r["name"], r["lat"]) for r in rows.orderBy("number").collect()] == [("EDDF", "Frankfurt Airport", 50.03), ("EDDF", "Frankfurt", 50.04)]
    (tmp_path / "aircraft.json").write_text('{"D-EAGJ": "Diamond DA20", "D-EXYZ": "Cessna"}')
    assert {tuple(r) for r in kml.aircraft_models(spark, str(tmp_path / "aircraft.json")).collect()} == {("D-EAGJ", "Diamond DA20"), ("D-EXYZ", "Cessna")}
    made = kml.synthetic_points(spark, 3, 60).toPandas()
    assert len(made) == 180 and made["alt_m"].between(0, 1800).all()


def test_build_from_logs(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    marks = "".join(f"<when>2025-03-0{d}T10:{m:02d}:00Z</when><gx:coord>{8 + m / 100} 50.0 {500 + m}</gx:coord>" for d in (1,) for m in range(30))
    (logs / "1_DEAGJ_DA20.kml").write_text(
        f'<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document><Placemark><name>EDDF - EDDM</name><gx:Track>{marks}</gx:Track></Placemark></Document></kml>'
    )
    (logs / "broken.kml").write_text("<kml><Placemark><na")
    build(spark, str(logs), out)
    segments = sinks.read_year(spark, out, "segments", "2025").toPandas()
    assert len(segments) == 29 and (segments["groundspeed_knots"] > 0).all()
    assert sinks.read_year(spark, out, "segments", "2024").count() == 0
    meta = json.loads(spark.read.text(f"{out}/metadata").first()[0])
    assert meta["available_years"] == [2025] and meta["stats"]["max_lat"] == 50.0
    assert sinks.years_of(spark, out) == [2025] and sinks.read_metadata(spark, out).first()["num_paths"] == 1
    known = spark.createDataFrame([(1, "EDDF", "Frankfurt Airport", 50.0, 8.0, "DE")], "number long, code string, name string, lat double, lon double, country string")
    build(spark, str(logs), out, known)
    assert [(r["flight_count"], r["country"]) for r in sinks.read_airports(spark, out).where("country IS NOT NULL").collect()] == [(1, "DE")]
    with pytest.raises(ValueError):
        sinks.read_year(spark, out, "segments", "../x")
