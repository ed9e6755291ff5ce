"""KML logs as DataFrames, through Spark's XML reader with an explicit schema.

A log is known by its path: names may repeat from folder to folder. Its XML is scanned once, into elements(): a row a placemark
with its texts, shapes and times. Points and metadata are made of these rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from urllib.parse import unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightloom.functions.names import aircraft_from_filename
from flightloom.functions.times import charter_start, date_in_name, parsed, year_of
from flightloom.sources.shared import checkpointed, fresh_folder

_SHAPE = "array<struct<coordinates:string>>"
_BORDER = f"array<struct<LinearRing:{_SHAPE}>>"
_TRACK = "array<struct<when:array<string>,coord:array<string>,`gx:coord`:array<string>>>"
_MULTI = f"array<struct<Track:{_TRACK},`gx:Track`:{_TRACK}>>"
_GEOMETRY = {
    "Point": _SHAPE, "LineString": _SHAPE, "LinearRing": _SHAPE, "Polygon": f"array<struct<outerBoundaryIs:{_BORDER},innerBoundaryIs:{_BORDER}>>",
    "Track": _TRACK, "gx:Track": _TRACK, "MultiTrack": _MULTI, "gx:MultiTrack": _MULTI,
}
_INNER = ",".join(f"`{k}`:{v}" for k, v in _GEOMETRY.items())
#: One element of every dialect, with and without the track prefix: any geometry may repeat, collections may hold collections
#: once. What an element lacks is null. Text stays text: inference would cut timestamps.
PLACEMARK = "name string, description string, TimeStamp struct<when:string>, " + ", ".join(f"`{k}` {v}" for k, v in _GEOMETRY.items()) + f", MultiGeometry array<struct<{_INNER},MultiGeometry:array<struct<{_INNER}>>>>"
_CORRUPT = "_corrupt_record"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _each(found: Column, get) -> Column:
    """An array of what `get` finds in each element, none for null."""
    return F.coalesce(F.transform(found, get), F.array())


def _within(p: Column, own) -> Column:
    """What `own` finds in a placemark itself, in its collections, and in theirs."""
    deep = lambda m: F.concat(own(m), F.flatten(_each(m["MultiGeometry"], own)))
    return F.concat(own(p), F.flatten(_each(p["MultiGeometry"], deep)))


def _shapes(p: Column) -> Column:
    text = lambda x: x["coordinates"]
    ring = lambda b: F.flatten(_each(b, lambda x: _each(x["LinearRing"], text)))
    area = lambda g: F.flatten(_each(g["Polygon"], lambda x: F.concat(ring(x["outerBoundaryIs"]), ring(x["innerBoundaryIs"]))))
    return F.filter(_within(p, lambda g: F.concat(*[_each(g[kind], text) for kind in ("Point", "LineString", "LinearRing")], area(g))), lambda x: x.isNotNull())


def _tracks(p: Column) -> Column:
    both = lambda g: F.concat(F.coalesce(g["gx:Track"], F.array()), F.coalesce(g["Track"], F.array()))
    many = lambda g: F.flatten(F.concat(_each(g["gx:MultiTrack"], both), _each(g["MultiTrack"], both)))
    return _within(p, lambda g: F.concat(both(g), many(g)))


def _of_tracks(tracks: Column, field: str) -> Column:
    return F.flatten(_each(tracks, lambda t: F.coalesce(t[field], F.array())))


def _placed(rows: DataFrame, order: list[str], keep_broken: bool) -> DataFrame:
    """Elements of (path, file, *order, placemark): their place in the file, and what the file as a whole decides.

    Track coordinates without their prefix count only in files that hold neither prefixed ones nor other coordinates. Of a
    file with malformed XML nothing is kept, unless `keep_broken`.
    """
    p = F.col("placemark")
    tracks = _tracks(p)
    own = rows.select(
        "path", "file", *order, p[_CORRUPT].isNotNull().alias("broken"), F.trim(p["name"]).alias("name"), p["description"].alias("description"), F.trim(p["TimeStamp"]["when"]).alias("stamp"),
        _shapes(p).alias("shapes"), _of_tracks(tracks, "when").alias("whens"), _of_tracks(tracks, "gx:coord").alias("marked"), _of_tracks(tracks, "coord").alias("plain"),
    )
    whole = Window.partitionBy("path")
    before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.max((F.size("shapes") > 0) | (F.size("marked") > 0)).over(whole)
    own = own.withColumn("at", (F.row_number().over(whole.orderBy(*order)) - 1).cast("long")).withColumn("coords", F.when(known, F.col("marked")).otherwise(F.col("plain"))).withColumn("malformed", F.max("broken").over(whole))
    n, k = F.size("coords"), F.size("whens")
    placed = own.select(
        "path", "file", "at", "name", "description", "stamp", "shapes", "whens", "coords", "broken", "malformed",
        F.min(F.when(n > 0, F.col("at"))).over(whole).alias("track_at"),
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias("coords_before"), F.coalesce(F.sum(k).over(before), F.lit(0)).alias("whens_before"),
        (F.sum(n).over(whole) == F.sum(k).over(whole)).alias("even"), (F.max(F.abs(n - k)).over(whole) == 0).alias("aligned"),
    )
    return placed if keep_broken else placed.where("broken OR NOT malformed")


def _file_name(path: Column) -> Column:
    """The name at the end of a URI. url_decode() would read a plus as a blank."""
    return F.url_decode(F.replace(F.regexp_extract(path, "[^/]*$", 0), F.lit("+"), F.lit("%2B")))


def _uri(path: Column) -> Column:
    """A file's URI in one spelling: local ones come with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def elements(spark: SparkSession, path: str | list[str], glob: str = "*.[kK][mM][lL]", keep_broken: bool = False) -> DataFrame:
    """A row for each placemark of the files under `path`, in one scan and one shuffle by file: path, file (its name), at
    (the placemark's place in the file, from 0, however the file was split), name, description, stamp, shapes, whens, coords, and
    what track_points() needs to know of the whole file.

    A malformed file gives one row that says so (broken) and, unless `keep_broken`, no other. Unreadable files give
    nothing. The plan is lazy: store it, as parsed() does, before more than one thing is read from it.
    """
    raw = spark.read.format("xml").schema(f"{PLACEMARK}, {_CORRUPT} string").option("rowTag", "Placemark").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = [f.name for f in raw.schema]
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))  # within a block the reader keeps the order of the file
    rows = raw.select(_uri(F.col("_metadata.file_path")).alias("path"), _file_name(F.col("_metadata.file_path")).alias("file"), at.alias("order"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("placemark"))
    return _placed(rows.where(" OR ".join(f"placemark.`{n}` IS NOT NULL" for n in names)), ["order"], keep_broken)


def from_text(rows: DataFrame, keep_broken: bool = False) -> DataFrame:
    """elements() of (path, file, at, xml), one placemark's text a row; `at` orders them within their path."""
    read = F.from_xml("xml", f"{PLACEMARK}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return _placed(rows.select("path", "file", F.col("at").alias("order"), read.alias("placemark")), ["order"], keep_broken)


def track_points(found: DataFrame) -> DataFrame:
    """(path, file, at, element, seq, lat, lon, alt_m, ts_raw, kind, ts) of both dialects in elements().

    Each `coordinates` element is a path of `lon,lat[,alt]` tokens parted by blanks. All track coordinates of a file, `lon
    lat alt`, are one path, at the first placemark that has any; they have times only if the file has as many times as
    coordinates, the i-th for the i-th. Tokens that hold no numbers are left out; altitude may be missing.
    """
    shaped = found.select("path", "file", "at", F.posexplode("shapes").alias("element", "text"))
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    none = F.lit(None).cast("string")
    plain = shaped.select("path", "file", "at", "element", F.posexplode(tokens).alias("seq", "token")).select("path", "file", "at", "element", F.col("seq").cast("long").alias("seq"), F.split("token", ",").alias("part"), none.alias("ts_raw"), F.lit("coordinates").alias("kind"))
    token = found.select("path", "file", F.col("track_at").alias("at"), "even", "aligned", "coords_before", F.when(F.col("aligned"), F.col("whens")).alias("whens"), F.posexplode("coords").alias("i", "token"))
    track = token.select("path", "file", "at", F.lit(0).alias("element"), (F.col("coords_before") + F.col("i")).alias("seq"), F.split(F.trim("token"), r"\s+").alias("part"), F.trim(F.when(F.col("aligned"), F.get("whens", F.col("i")))).alias("ts_raw"), F.lit("track").alias("kind"), (F.col("even") & ~F.col("aligned")).alias("apart"))
    # Times that stand in other placemarks than their coordinates meet them by number.
    apart = found.where("even AND NOT aligned").select("path", F.col("whens_before").alias("b"), F.posexplode("whens").alias("i", "other")).select("path", (F.col("b") + F.col("i")).alias("seq"), F.trim("other").alias("other"))
    met = track.where("apart").join(apart, ["path", "seq"], "left").withColumn("ts_raw", F.col("other"))
    both = plain.unionByName(track.where("NOT apart").select(plain.columns)).unionByName(met.select(plain.columns))
    at = lambda i: _number(F.get("part", F.lit(i)))
    rows = both.select("path", "file", "at", "element", "seq", at(1).alias("lat"), at(0).alias("lon"), at(2).alias("alt_m"), "ts_raw", "kind")
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("ts", parsed(F.col("ts_raw")))


def metadata(found: DataFrame) -> DataFrame:
    """(path, file, at, name, timestamp, end_timestamp, year, registration, aircraft_type, airport_name) of each placemark of elements():
    its first and last time, else a date in its name, else its description; a charter's route replaces names not of four
    letters."""
    track = F.when(F.size("whens") > 0, F.col("whens")).when(F.col("stamp").isNotNull(), F.array("stamp"))
    timestamp = F.coalesce(F.trim(F.get(track, F.lit(0))), date_in_name(F.col("name")), charter_start(F.col("description")))
    craft = aircraft_from_filename(F.col("file"))
    rows = found.where("NOT broken").select("path", "file", "at", "name", timestamp.alias("timestamp"), F.when(F.size(track) > 1, F.trim(F.element_at(track, -1))).alias("end_timestamp"), craft.alias("craft"))
    route = F.when(F.col("craft.route").isNotNull() & (F.length(F.coalesce("name", F.lit(""))) != 4), F.replace(F.col("craft.route"), F.lit("-"), F.lit(" - ")))
    return rows.select("path", "file", "at", "name", "timestamp", "end_timestamp", year_of(F.col("timestamp")).alias("year"), F.col("craft.registration").alias("registration"), F.col("craft.type").alias("aircraft_type"), F.coalesce(route, "name").alias("airport_name"))


_LISTED = "path string, file string, bytes long, modified timestamp"


def listing(spark: SparkSession, source: str, empty: bool = True) -> DataFrame:
    """(path, file, bytes, modified) of every file under a folder, or of one file, but for hidden ones; without `empty`, of those
    that are not empty. Contents are not read. A source that is not there gives no rows.

    On a disk tasks walk the folders. In other stores Spark's file index lists them, whose names the driver holds for the time. As
    Spark's file sources pass over empty files, those that it names and no row tells of are added; they are asked one by one
    for their time of change.
    """
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(source)
    store = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(root):
        return spark.createDataFrame([], _LISTED)
    if store.makeQualified(root).toUri().getScheme() == "file":
        found = _walked(spark, store.makeQualified(context._jvm.org.apache.hadoop.fs.Path(unquote(source))).toUri().getPath())
        return found if empty else found.where("bytes > 0")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_to_load(source))
    rows = read.select("_metadata.file_path", "length", "modificationTime")
    found = rows.select(_uri(F.col("file_path")).alias("path"), _file_name(F.col("file_path")).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if not empty:
        return found
    found, jvm = checkpointed(found.coalesce(4 * context.defaultParallelism)), context._jvm
    if len(read._jdf.inputFiles()) <= found.count():  # the names stay in the JVM
        return found
    every = spark.createDataFrame([(x,) for x in read.inputFiles()], "value string")
    none = [r["value"] for r in every.join(found.select("path"), _uri(F.col("value")) == F.col("path"), "left_anti").collect()]
    changed = [(x, 0, store.getFileStatus(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x))).getModificationTime()) for x in none]
    extra = spark.createDataFrame(changed, "path string, bytes long, modified long")
    return found.unionByName(extra.select(_uri(F.col("path")).alias("path"), _file_name(F.col("path")).alias("file"), "bytes", F.timestamp_millis("modified").alias("modified")))


def _quoted(path: str) -> str:
    """A path of the disk as Spark spells its URI: of characters beyond ASCII only blanks and controls are escaped."""
    escaped = lambda c: "".join(f"%{b:02X}" for b in c.encode())
    plain = lambda c: c in "_-!.~'()*,;:$&+=/@" or c.isalnum() if c.isascii() else unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
    return "file://" + "".join(c if plain(c) else escaped(c) for c in path)


def _entries(folder: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(path, file, whether it is a folder, bytes, milliseconds) of what lies in a folder, or of one file, but for what Spark's
    file index passes over: hidden names, names that are no text, and what is gone by now."""
    if os.path.isfile(folder):
        at = os.stat(folder)
        yield folder, os.path.basename(folder), False, at.st_size, at.st_mtime_ns // 1_000_000
        return
    with os.scandir(folder) as entries:
        for x in entries:
            hidden = (x.name.startswith("_") and "=" not in x.name and not x.name.startswith(("_metadata", "_common_metadata"))) or x.name.startswith(".") or x.name.endswith("._COPYING_")
            try:
                x.name.encode()
                at = x.stat()
            except (UnicodeEncodeError, FileNotFoundError):
                continue
            if not hidden:
                yield x.path, x.name, x.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000


def _walked(spark: SparkSession, root: str) -> DataFrame:
    """listing() of a folder that all tasks see, level by level: the folders of a level are dealt to tasks, which pass on what
    they find a few thousand names at a time."""
    shape = "at string, file string, folder boolean, bytes long, modified long, path string"

    def scanned(frames):
        for frame in frames:
            for folder in frame["at"]:
                found = _entries(folder)
                while some := [*islice(found, 5_000)]:
                    rows = pd.DataFrame(some, columns=["at", "file", "folder", "bytes", "modified"])
                    yield rows.assign(path=rows["at"].map(_quoted))

    levels, level = [], spark.createDataFrame([(root,)], "at string")
    while not level.isEmpty():
        levels.append(checkpointed(level.repartition(4 * spark.sparkContext.defaultParallelism, "at").mapInPandas(scanned, shape)))
        level = levels[-1].where("folder").select("at")
    rows = reduce(DataFrame.unionByName, levels).where("NOT folder")
    return rows.select("path", "file", "bytes", F.timestamp_millis("modified").alias("modified"))


def _glob(ending: str) -> str:
    """A pattern of names with this ending, in any case."""
    return "*" + "".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else x for x in ending)


def _to_load(path: str) -> str:
    """A path as a reader takes it: decoded, signs of patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


#: Files up to which a reader is given their names.
NAMED_FILES = 1_000


def _holding(files: DataFrame) -> list[str]:
    """What a reader has to load to see all `files` (path): their names if they are few, else the folders that hold them, none
    within another. What else lies there is read too, so the reader's rows are to be joined with `files`."""
    few = [r["path"] for r in files.select("path").limit(NAMED_FILES + 1).collect()]
    if len(few) <= NAMED_FILES:
        return [*map(_to_load, few)]
    folders = sorted(r["folder"] for r in files.select(F.regexp_replace("path", "[^/]*$", "").alias("folder")).distinct().collect())
    outer: list[str] = []
    for folder in folders:  # what lies within a folder follows it
        if not outer or not folder.startswith(outer[-1]):
            outer.append(folder)
    return [*map(_to_load, outer)]


#: Files up to which a reader may load them at once: the driver holds an index of what is loaded.
LOADED_FILES = 20_000


def _portions(files: DataFrame, there: DataFrame) -> Iterator[DataFrame]:
    """`files` (path), out of all that is `there` (path), in portions for _holding(): what is loaded for one is no more than
    LOADED_FILES files, or NAMED_FILES names or folders, however many there are.

    A folder with more files, all told, is crowded; there are few of them. A file's unit is the outermost folder around
    it that is not crowded, or the file itself in a crowded one. Units go into portions as they come, a few at a time
    through the driver.
    """
    if files.limit(NAMED_FILES + 1).count() <= NAMED_FILES or there.count() <= LOADED_FILES:
        yield files
        return
    parts = F.split("path", "/")
    around = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    outer = there.select(F.explode(around).alias("folder")).groupBy("folder").count()
    crowded = [r["folder"] for r in outer.where(F.col("count") > LOADED_FILES).collect()]
    unit = F.coalesce(F.get(F.filter(around, lambda x: ~x.isin(crowded)), F.lit(0)), "path").alias("unit")
    dealt = checkpointed(files.select("path", unit))
    sizes = there.select(unit).groupBy("unit").count().join(dealt.select("unit").hint("merge"), "unit", "left_semi")
    units, size = [], 0
    for r in checkpointed(sizes.orderBy("unit")).toLocalIterator():
        if units and (size + r["count"] > LOADED_FILES or len(units) == NAMED_FILES):
            yield dealt.where(F.col("unit").isin(units)).select("path")
            units, size = [], 0
        units.append(r["unit"])
        size += r["count"]
    if units:
        yield dealt.where(F.col("unit").isin(units)).select("path")


def fault_report(files: DataFrame, found: DataFrame, points: DataFrame, ending: str = ".kml") -> DataFrame:
    """(path, file, bytes, modified, fault), a row a file of listing(): what is wrong with it as a log, null if nothing.

    In this order: not a file of logs by the end of its name; empty; malformed XML (`found` are its elements()); no placemarks, which a file that cannot
    be read has not either; no coordinates, if none of its points can be read.
    """
    seen = found.groupBy("path").agg(F.max("broken").alias("broken"))
    read = points.select("path").distinct().withColumn("read", F.lit(True))
    fault = F.when(~F.lower("file").endswith(ending), f"not a {ending} file").when(F.col("bytes") == 0, "empty").when(F.col("broken"), "malformed").when(F.col("broken").isNull(), "no placemarks").when(F.col("read").isNull(), "no coordinates")
    return files.join(seen, "path", "left").join(read, "path", "left").select(*files.columns, fault.alias("fault"))


def parsed_logs(spark: SparkSession, path: str | list[str], glob: str = "*.[kK][mM][lL]", keep_broken: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, points and metadata of the logs under `path`: the XML is scanned once, its elements are written and all else
    is made of them. Many logs under one folder are scanned portion by portion."""
    there = checkpointed(listing(spark, path, empty=False).select("path")) if isinstance(path, str) else None
    if there is None or there.count() <= LOADED_FILES:
        found = checkpointed(elements(spark, path, glob, keep_broken))
    else:
        folder = fresh_folder(spark, "elements")
        _write_elements(spark, there, there, None, folder, glob, keep_broken)
        found = spark.read.parquet(folder)
    return found, track_points(found), metadata(found)


def _write_elements(spark: SparkSession, files: DataFrame, there: DataFrame, source: str | None, folder: str, glob: str, keep_broken: bool = False) -> None:
    """elements() of `files` (path), out of what is `there`, written to `folder` portion by portion. If they are all that is there
    and can be loaded at once, `source` says it shorter than their names."""
    for part in _portions(files, there):
        found = elements(spark, source if source and part is files else _holding(part), glob, keep_broken)
        found.join(part.hint("merge"), "path", "left_semi").write.mode("append").parquet(folder)


def files_in_order(files: DataFrame) -> DataFrame:
    """Rows with (file) and `place`: numbered names by number, then the rest by name."""
    number = F.regexp_extract("file", r"^(\d+)", 1)
    return files.withColumn("place", F.struct((number == "").alias("last"), F.when(number != "", number.try_cast("bigint")).alias("number"), F.col("file").alias("name")))


def _versions(spark: SparkSession, store: str) -> list[int]:
    """The complete versions of a store's manifest: those whose job was committed."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    done = lambda name: files.exists(context._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/{name}/_SUCCESS"))
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and done(n))


_MANIFEST = "path string, file string, bytes long, modified timestamp, checksum string, batch string"


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(path, file, bytes, modified, checksum, batch) of the logs that a store holds, in its newest or a given version:
    `batch` is the call that parsed their contents."""
    known = _versions(spark, store)
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest/version={known[-1] if version is None else version}")


def parse_new(spark: SparkSession, source: str, store: str, ending: str = ".kml") -> int:
    """Brings `store` up to date with the logs under `source` and gives the number of files parsed.

    Logs are known by path. Those whose length and time of change are as they were are left alone; of the others the checksum
    is taken, and only new contents are parsed, their XML scanned once, into elements, points and metadata of a new batch.
    A changed log supersedes what it said before, one that is gone goes. The new manifest is a folder of its own, named by
    its version, and counts once its job is committed: readers see the old state or the new, never a part.
    """
    known = _versions(spark, store)
    version, batch = (known[-1] if known else 0) + 1, uuid.uuid4().hex
    old = manifest(spark, store)
    there = checkpointed(listing(spark, source, empty=False))
    now = there.where(F.lower("file").endswith(ending))
    same = ["path", "bytes", "modified"]
    kept = old.join(now.select(*same).hint("merge"), same, "left_semi")
    changed = checkpointed(now.join(old.select(*same).hint("merge"), same, "left_anti"))
    if changed.isEmpty() and kept.count() == old.count():
        return 0  # nothing came, nothing went
    count = 0
    if not changed.isEmpty():
        # Where all are new, the folder says it shorter than its files' names.
        whole, scratch, new = None if known else source, fresh_folder(spark, "checksums"), changed.select("path")
        for part in _portions(new, there):
            sums = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(ending)).load(whole if whole and part is new else _holding(part)).select(_uri(F.col("_metadata.file_path")).alias("path"), F.md5("content").alias("checksum"))
            sums.join(part.hint("merge"), "path", "left_semi").write.mode("append").parquet(scratch)
        sums = changed.join(spark.read.parquet(scratch).hint("merge"), "path")
        fresh = checkpointed(sums.join(old.select("path", "checksum", F.col("batch").alias("parsed_in")).hint("merge"), ["path", "checksum"], "left"))
        todo = fresh.where("parsed_in IS NULL").select("path")
        count = todo.count()
        if count:
            _write_elements(spark, todo, there, whole, f"{store}/elements/batch={batch}", _glob(ending))
            found = spark.read.parquet(f"{store}/elements/batch={batch}")
            track_points(found).write.parquet(f"{store}/points/batch={batch}")
            metadata(found).write.parquet(f"{store}/metadata/batch={batch}")
        kept = kept.unionByName(fresh.select("path", "file", "bytes", "modified", "checksum", F.coalesce("parsed_in", F.lit(batch)).alias("batch")))
    kept.coalesce(1).write.parquet(f"{store}/manifest/version={version}")
    return count


def parsed_store(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """The `elements`, `points` or `metadata` of a store's logs, as the newest version of its manifest has them, or an older one
    as long as nothing is vacuumed."""
    empty = {"points": track_points, "metadata": metadata, "elements": lambda x: x}
    held = manifest(spark, store, version)
    if held.isEmpty():
        return empty[name](from_text(spark.createDataFrame([], "path string, file string, at long, xml string")))
    rows = spark.read.option("basePath", f"{store}/{name}").parquet(f"{store}/{name}")
    return rows.join(held.select("path", "batch").hint("merge"), ["path", "batch"], "left_semi").drop("batch")


def store_faults(spark: SparkSession, source: str, store: str) -> DataFrame:
    """fault_report() of the files under `source` by what parse_new() has kept of them."""
    return fault_report(listing(spark, source), parsed_store(spark, store, "elements"), parsed_store(spark, store, "points"))


def write_each(rows: DataFrame, folder: str, format_: str = "text") -> None:
    """A file a row of `rows` (name, value) under `folder`, as text or as a line of JSON; names are distinct.

    On a disk the tasks write the files themselves, a folder a task, each renamed once it is whole: for Spark's writer
    Hadoop starts a process or two a file there to set its rights, and the driver moves all files one by one in the end. In
    other stores it is Spark's writer, where names are its own and tasks move their files.
    """
    context = rows.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    uri = store.makeQualified(path).toUri()
    spread = rows.repartition(4 * context.defaultParallelism, "name")
    if uri.getScheme() != "file":
        spread.select("value").write.format(format_).option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).save(folder)
        return
    root, ending = uri.getPath(), {"text": ".txt", "json": ".json"}[format_]

    def put(part):
        task = TaskContext.get()
        own = f"{root}/{task.partitionId():05d}"
        os.makedirs(own, exist_ok=True)
        for name, value in part:
            unfinished = f"{own}/_{name}-{task.taskAttemptId()}"
            with open(unfinished, "w", encoding="utf-8", newline="\n") as f:
                f.write(f"{value}\n")
            os.replace(unfinished, f"{own}/{name}{ending}")

    text = F.col("value") if format_ == "text" else F.to_json(F.struct("value"))
    spread.select("name", text.alias("value")).foreachPartition(put)


def write_logs(points: DataFrame, folder: str, long_points: int = 5_000) -> None:
    """A KML log a track of `points` (path_id, seq, lat, lon, alt_m, ts_raw, name): track elements with their times, the name's
    placemark and a description `track ID`.

    A track of up to `long_points` points is one row and becomes a file of its own under `folder`/short, many to a task. Longer
    ones are written in parts of so many points, a folder each in `folder`/long: no track has to fit in a row.
    """
    size = points.groupBy("path_id").agg(F.count("*").alias("points"))
    coord = F.concat(F.coalesce(F.concat(F.lit("<when>"), "ts_raw", F.lit("</when>")), F.lit("")), F.lit("<gx:coord>"), F.concat_ws(" ", "lon", "lat", "alt_m"), F.lit("</gx:coord>"))
    rows = points.join(size, "path_id").select("path_id", "name", "points", F.col("seq"), F.row_number().over(Window.partitionBy("path_id").orderBy("seq")).alias("n"), coord.alias("text"))
    markup = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), "")
    mark = F.concat(F.lit("<Placemark><name>"), markup(F.coalesce(F.first("name"), F.lit(""))), F.lit("</name><description>track "), F.col("path_id"), F.lit("</description><gx:Track>"), body, F.lit("</gx:Track></Placemark>"))
    parts = checkpointed(rows.groupBy("path_id", "points", F.floor((F.col("n") - 1) / long_points).alias("part")).agg(mark.alias("xml")))
    short = parts.where(F.col("points") <= long_points).select(F.col("path_id").cast("string").alias("name"), F.concat(F.lit(_OPEN), "xml", F.lit(_CLOSE)).alias("value"))
    write_each(short, f"{folder}/short")
    long = parts.where(F.col("points") > long_points).select("path_id", "part", "xml")
    if not long.isEmpty():
        ends = lambda part, text: long.select("path_id").distinct().select("path_id", F.lit(part).cast("long").alias("part"), F.lit(text).alias("xml"))
        lines = long.unionByName(ends(-1, _OPEN)).unionByName(ends(2**40, _CLOSE)).repartition("path_id").sortWithinPartitions("path_id", "part")
        lines.select("path_id", "xml").write.partitionBy("path_id").text(f"{folder}/long")


_OPEN, _CLOSE = '<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>', "</Document></kml>"


def aircraft_models(spark: SparkSession, path: str) -> DataFrame:
    """(registration, model) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("registration", "model"))


def synthetic_points(spark: SparkSession, tracks: int, points: int = 50, seed: int = 1) -> DataFrame:
    """Seeded tracks that climb, cruise and descend along a bent line: (path_id, seq, us, lat, lon, alt_m)."""
    t = F.col("seq") / F.lit(float(points))
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "path_id"), F.lit(10_000)) / 10_000
    rows = spark.range(tracks).select(F.col("id").alias("path_id"), F.explode(F.sequence(F.lit(1), F.lit(points))).alias("seq"))
    bend = lambda a, b, m: (1 - t) * (1 - t) * a + 2 * t * (1 - t) * m + t * t * b
    height = F.least(F.lit(1.0), F.least(t, 1 - t) * 5) * (600 + 1200 * draw(5))
    return rows.select("path_id", "seq", (F.lit(1_735_689_600_000_000) + F.col("path_id") * 7_200_000_000 + F.col("seq").cast("long") * 60_000_000).alias("us"), bend(47 + 7 * draw(1), 47 + 7 * draw(2), F.lit(50.5)).alias("lat"), bend(7 + 7 * draw(3), 7 + 7 * draw(4), F.lit(10.5)).alias("lon"), height.alias("alt_m"))
