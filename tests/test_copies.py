"""Queries over tables that larger copies bring: other ids, crowded folders."""

import datetime

import duckdb

from flightloom.plans import registry
from flightloom.sources import kml

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, users):
    """Three events a user, written as a table."""
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(u * 10 + i, at + datetime.timedelta(hours=i), u, "view", 1.5 * i, "{}") for u in users for i in range(3)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return folder


def test_an_id_that_looks_like_a_year_keeps_its_dialect(spark, tmp_path):
    folder = events(spark, str(tmp_path), [2026, 2027, 20260])
    rows = {r["path_id"]: (r["points"], r["end_timestamp"] is None) for r in registry.queries()["kml_metadata"](spark, folder).collect()}
    assert rows == {2026: (2, False), 2027: (3, True), 20260: (2, False)}


def test_candidates_of_airports_are_made_once(spark, tmp_path):
    folder = events(spark, str(tmp_path), range(4))
    for name in ("supplier", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    found = registry._found(registry.Views(spark, folder))
    assert "Relation" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


def test_crowded_folders_are_loaded_by_their_name(spark, tmp_path, monkeypatch):
    line = "<Placemark><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark>"
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    put = lambda name, text=line: kml.write_each(spark.createDataFrame([(f"log{i}", text) for i in range(4)], "name string, value string"), f"{logs}/{name}")
    put("a")
    assert kml.parse_new(spark, str(logs), store, ".txt") == 4
    monkeypatch.setattr(kml, "NAMED_FILES", 2)
    put("a/within")
    put("b [1] +")
    put("none", "")
    (logs / "none" / "empty.txt").write_text("")
    asked = kml._holding(kml.listing(spark, str(logs), empty=False).select("path"))
    assert all(x.endswith("/") for x in asked) and not any(x != y and x.startswith(y) for x in asked for y in asked)
    assert kml.parse_new(spark, str(logs), store, ".txt") == 12 and kml.parse_new(spark, str(logs), store, ".txt") == 0
    counts = kml.parsed_store(spark, store, "points").groupBy("path").count().collect()
    assert [r["count"] for r in counts] == [2] * 12
    listed = [(r["file"], r["bytes"]) for r in kml.listing(spark, str(logs)).collect()]
    assert len(listed) == 17 and [x for x in listed if not x[1]] == [("empty.txt", 0)]


def test_more_logs_than_a_reader_holds_are_loaded_in_portions(spark, tmp_path, monkeypatch):
    line = "<Placemark><LineString><coordinates>1,2,3 4,5,6</coordinates></LineString></Placemark>"
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    names = [f"{folder}/log{i}.txt" for folder, n in (("few", 2), ("crowded", 9), ("crowded/in it [1] +é\u00a0%41", 3), ("top/a", 2), ("top/b", 1)) for i in range(n)] + ["lone.txt"]
    for name in [*names, "few/_hidden.txt", ".gone/x.txt"]:
        (logs / name).parent.mkdir(parents=True, exist_ok=True)
        (logs / name).write_text(f"<kml>{line}</kml>")
    (logs / "few" / "cut.txt").write_text(f"<kml>{line}<Placemark>")
    (logs / "empty.txt").write_text("")
    monkeypatch.setattr(kml, "LOADED_FILES", 4)
    monkeypatch.setattr(kml, "NAMED_FILES", 3)
    loaded, holding = [], kml._holding
    monkeypatch.setattr(kml, "_holding", lambda files: loaded.append(files.count()) or holding(files))
    listed = {(r["path"], r["bytes"], r["modified"]) for r in kml.listing(spark, str(logs), empty=False).collect()}
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(logs)).selectExpr("_metadata.file_path AS path", "length", "modificationTime").collect()
    assert listed == {("file:///" + r["path"].split(":", 1)[1].lstrip("/"), r["length"], r["modificationTime"]) for r in read} and len(listed) == len(names) + 1
    assert sorted(r["file"] for r in kml.listing(spark, str(logs)).where("bytes = 0").collect()) == ["empty.txt"]
    assert kml.parse_new(spark, str(logs), store, ".txt") == len(names) + 1 and kml.parse_new(spark, str(logs), store, ".txt") == 0
    assert sum(loaded) == 2 * (len(names) + 1) and max(loaded) <= 4
    points = kml.parsed_store(spark, store, "points").groupBy("path").count().collect()
    assert [r["count"] for r in points] == [2] * len(names)
    found, read, _ = kml.parsed_logs(spark, str(logs), "*.txt")
    assert read.count() == 2 * len(names)
    faults = kml.fault_report(kml.listing(spark, str(logs)), found, read, ".txt").where("fault IS NOT NULL").collect()
    assert sorted((r["file"], r["fault"]) for r in faults) == [("cut.txt", "malformed"), ("empty.txt", "empty")]


def test_numbers_are_rounded_as_the_sql_rounds(spark):
    numbers = [16.2515625, 18.646562499999998, 2.0578125, 32.7296875, -18.646562499999998, 1.5, float("nan"), float("inf"), None]
    found = [r["x"] for r in registry._rounded(spark.createDataFrame([(x,) for x in numbers], "x double"), 6).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()]
    assert repr(found) == repr(want) and found[:2] == [16.251562, 18.646563]
