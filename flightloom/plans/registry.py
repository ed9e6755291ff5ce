"""The registered queries of the track library: operators over the adapter views, with floats rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import constants as c
from flightloom.functions import display, geo, names, times, urls
from flightloom.operators import airports as ports
from flightloom.operators import stats, tracks
from flightloom.plans import build, filters, privacy, replay, review
from flightloom.plans.build import bounds
from flightloom.plans.filters import FilterSpec
from flightloom.sources import adapters, kml, sinks
from flightloom.sources.shared import checkpointed, fresh_folder, remove_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


class Views:
    """The adapter views of one folder, and what most queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.points = adapters.points(spark, sf_dir)
        self.paths = adapters.paths(spark, sf_dir)

    @property
    def legs(self) -> DataFrame:
        return tracks.legs(self.points)

    @property
    def speeds(self) -> DataFrame:
        return tracks.with_groundspeed(self.legs)

    @property
    def cruise(self) -> DataFrame:
        return tracks.with_cruise(self.speeds)

    @property
    def segments(self) -> DataFrame:
        return tracks.segments(self.speeds)

    @property
    def info(self) -> DataFrame:
        return stats.path_info(self.points, self.legs, self.paths)

    @property
    def heads(self) -> DataFrame:
        """Path info without sums: year, aircraft and both airports."""
        start, end = names.route_ends(F.col("airport_name"))
        return self.paths.select("path_id", "year", "registration", "aircraft_type", start.alias("start_airport"), end.alias("end_airport"))

    @property
    def airports(self) -> DataFrame:
        return adapters.airports(self.spark, self.sf_dir)


def _r(name: str, digits: int = 4, alias: str | None = None):
    """Rounded as the SQL rounds: the number times a power of ten. round() with digits goes by the number's decimal text, and
    takes the other way for some that lie within a bit of the middle."""
    scale = F.lit(10.0**digits)
    return (F.round(F.col(name) * scale) / scale).alias(alias or name)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[_r(n, digits) if t == "double" else F.col(n) for n, t in df.dtypes])


@query
def path_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = Views(spark, sf_dir).legs.groupBy("path_id").agg(F.sum("km").alias("km"))
    return far.select("path_id", _r("km"), F.round(F.col("km") / c.KM_PER_NM, 4).alias("nm"))


@query
def segment_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).legs.select("path_id", "seg_idx", _r("km", 6), _r("dt", 6), _r("speed"))


@query
def windowed_groundspeed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).speeds.select("path_id", "seg_idx", _r("gs", 3), _r("window_km", 3), _r("window_s", 6))


@query
def groundspeed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windowed_groundspeed with each path dealt into pieces of time."""
    rows = tracks.with_groundspeed_split(tracks.legs_split(Views(spark, sf_dir).points, piece_points=20), piece_seconds=1_800)
    return rows.select("path_id", "seg_idx", _r("gs", 3), _r("window_km", 3), _r("window_s", 6))


@query
def segments_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).segments.select("path_id", "seg_idx", _r("lat1", 8), _r("lon1", 8), _r("lat2", 8), _r("lon2", 8), "altitude_ft", "altitude_m", "groundspeed_knots", "time", _r("km", 6))


@query
def path_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = Views(spark, sf_dir).info
    return info.select("path_id", "year", "registration", "start_airport", "end_airport", "segment_count", _r("seconds"), _r("km"), _r("nm"), _r("start_lat", 8), _r("start_lon", 8), _r("end_lat", 8), _r("end_lon", 8))


@query
def validated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved about, so that some leave the valid ranges."""
    v = Views(spark, sf_dir).points.select("path_id", "seq", (F.col("lat") * (F.col("path_id") % 3)).alias("lat"), "lon", (F.col("alt_m") * 20 - 3000).alias("alt_m"))
    return tracks.validated(v).agg(F.count("*").alias("points"), F.count("alt_m").alias("with_altitude"), F.sum((F.col("alt_m") == 0).cast("int")).alias("at_zero"), F.round(F.max("alt_m"), 4).alias("highest"))


@query
def altitude_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = Views(spark, sf_dir).points
    both = tracks.altitude_samples(points).withColumn("from_end", F.lit(False)).union(tracks.altitude_samples(points, True).withColumn("from_end", F.lit(True)))
    return _rounded(both)


@query
def flight_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.flight_phases(Views(spark, sf_dir).points)


@query
def basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(stats.basic(v.points, v.legs))


@query
def altitude_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.altitude_range(Views(spark, sf_dir).points))


@query
def flight_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rounded(stats.flight_time(Views(spark, sf_dir).points))
    return out.withColumn("report", times.flight_time_report(F.col("total_seconds"))).withColumn("panel", times.flight_time_panel(F.col("total_seconds")))


@query
def aircraft_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.aircraft(Views(spark, sf_dir).info))


@query
def cruise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.cruise(Views(spark, sf_dir).cruise), 3)


@query
def cruise_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.histogram(Views(spark, sf_dir).cruise), 3)


@query
def cruise_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years' parts of cruise, written and put together: the mode comes of their histograms."""
    v, out = Views(spark, sf_dir), fresh_folder(spark, "cruise")
    stats.cruise_by_year(v.cruise, v.paths).write.parquet(out)
    return _rounded(stats.merged_years(spark.read.parquet(out)), 3)


@query
def cruise_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = stats.cruise_by_year(v.cruise, v.paths)
    bins = F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"].cast("string"), F.lit("@"), e["value"]["first"]["path_id"].cast("string"), F.lit("/"), e["value"]["first"]["seg_idx"].cast("string")))
    total = F.aggregate(F.map_values("histogram"), F.lit(0.0), lambda a, x: a + x["seconds"])
    return _rounded(rows.withColumn("bins", F.array_join(bins, " ")).withColumn("binned_seconds", total).drop("histogram"), 3)


@query
def year_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown"))
    return Views(spark, sf_dir).paths.groupBy(year.alias("year")).agg(F.count("*").alias("paths"))


@query
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).paths.where("year IS NOT NULL AND year <> 0").select("year").distinct()


@query
def reconciled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(stats.reconciled(v.segments, v.heads), 3)


def _filtered(spec: FilterSpec) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = Views(spark, sf_dir)
        return _rounded(filters.statistics(v.segments, v.heads, spec), 3)

    return run


_QUERIES["filtered_statistics"] = _filtered(FilterSpec())
_QUERIES["filtered_statistics_year"] = _filtered(FilterSpec(year="2025"))
_QUERIES["filtered_statistics_aircraft"] = _filtered(FilterSpec(year="2025", aircraft="D-E003"))


@query
def year_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(review.year_stats(v.segments, v.heads.where("year = 2025")), 3)


@query
def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = review.fleet(v.segments, v.heads)
    ends = rows.agg(F.min("flights").alias("low"), F.max("flights").alias("high"), F.lit(1).alias("one"))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")
    return rows.select("registration", "aircraft_type", "flights", _r("seconds", 3), display.fleet_class(F.col("flights"), F.col("low"), F.col("high")).alias("class"))


def _review_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    info = v.heads.where("year = 2025")
    s = _rounded(filters.statistics(v.segments, v.heads, FilterSpec(year="2025")), 3).withColumn("one", F.lit(1))
    first = review.fleet(v.segments, info).agg(F.min_by("registration", F.struct(-F.col("flights"), "registration")).alias("first_aircraft"), F.min_by("aircraft_type", F.struct(-F.col("flights"), "registration")).alias("first_model"), F.lit(1).alias("one"))
    lands = review.by_country(filters.airport_edges(info).select("airport").distinct(), v.airports).where("country <> 'Other'").agg(F.count("*").alias("num_countries"), F.lit(1).alias("one"))
    rows = s.join(first, "one").join(lands, "one")
    return rows.select("total_nm", F.col("num_paths").alias("total_flights"), "num_aircraft", "first_aircraft", "first_model", "num_countries", F.col("cruise_speed_knots").alias("cruise_knots"), (F.col("longest_flight_km") / c.KM_PER_NM).alias("longest_nm"), (F.col("gain_m") * c.METERS_TO_FEET).alias("gain_ft"), F.col("cruise_altitude_ft").alias("cruise_ft"), F.col("flight_seconds").alias("seconds"), (F.col("max_altitude_m") * c.METERS_TO_FEET).alias("max_ft"))


@query
def fleet_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's fleet with the models known of all years: models are known of aircraft that ever were of one type."""
    v = Views(spark, sf_dir)
    models = v.paths.select("registration", F.concat(F.lit("Model of "), "registration").alias("model")).where("aircraft_type = 'C172'").distinct()
    every = stats.aircraft(v.info, models)
    return _rounded(review.with_models(review.fleet(v.segments, v.heads.where("year = 2025")), every), 3)


@query
def aircraft_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(stats.aircraft_distances(v.segments, v.heads), 3)


@query
def statistics_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    marked = v.info.withColumn("airport_name", F.when(F.col("segment_count") % 3 == 0, "Log Start: 03 Mar 2025 08:58 Z").otherwise(F.col("airport_name")))
    return _rounded(stats.record(v.points, v.legs, marked), 3)


@query
def aircraft_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of a year's aircraft, and what is chosen after a choice that did not fly."""
    v = Views(spark, sf_dir)
    rows, spec = filters.aircraft_of_year(v.segments, v.heads, FilterSpec(year="2025", aircraft="D-EXXX"))
    return rows.withColumn("chosen", F.lit(spec.aircraft))


@query
def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.by_path(Views(spark, sf_dir).segments, chunk=50)
    first, last = F.col("segments")[0], F.element_at("segments", -1)
    return rows.select("path_id", "part", F.size("segments").alias("segments"), first["seg_idx"].alias("first_idx"), last["seg_idx"].alias("last_idx"), F.array_join(F.transform("segments", lambda x: x["altitude_ft"].cast("long").cast("string")), ",").alias("altitudes"))


@query
def first_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return filters.defaults(v.segments, v.heads)


@query
def fun_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.diverse(review.facts(_review_row(spark, sf_dir)))


@query
def airport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.airport_counts(Views(spark, sf_dir).heads).select("airport", "flights")
    most = rows.agg(F.max("flights").alias("most"), F.lit(1).alias("one"))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(most), "one")
    return rows.select("airport", "flights", F.round(display.airport_opacity(F.col("flights"), F.col("most")), 6).alias("opacity"), F.round(display.airport_size(F.col("flights"), F.col("most")), 6).alias("size"))


@query
def endpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.airport_counts(Views(spark, sf_dir).heads, per_end=True).select("airport", "flights")


@query
def home_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.home_base(filters.airport_counts(Views(spark, sf_dir).heads))


@query
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.destinations(Views(spark, sf_dir).heads)


@query
def country_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return review.by_country(filters.airport_edges(v.heads).select("airport").distinct(), v.airports)


@query
def path_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.airport_edges(Views(spark, sf_dir).heads)


@query
def airport_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible_airports(Views(spark, sf_dir).heads, FilterSpec(year="2024", aircraft="D-E001"))


@query
def airport_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ports.near_pairs(Views(spark, sf_dir).airports), 6)


@query
def airport_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports.clusters(Views(spark, sf_dir).airports).withColumnRenamed("cluster", "least_number")


def _found(v: Views) -> DataFrame:
    """Candidates of all paths, kept: more than one thing is made of them. Points are numbered once, and stay dealt by path."""
    points = checkpointed(v.points)
    info = stats.path_info(points, tracks.legs(points), v.paths).withColumn("timestamp", F.col("start_us").cast("string"))
    return checkpointed(ports.corrected(ports.candidates(info, tracks.flight_phases(points)), v.airports))


@query
def airport_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(ports.exported(ports.deduplicated(_found(v)), v.airports), 6)


@query
def airport_dedupe_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(ports.exported(ports.deduplicated_in_order(_found(v)), v.airports), 6)


@query
def airport_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visit times of the airports, exported beside them in parts of five, and read back in one."""
    v, out = Views(spark, sf_dir), fresh_folder(spark, "times")
    found = checkpointed(ports.assigned(_found(v)))
    kept = checkpointed(ports.exported(ports.gathered(found), v.airports))
    sinks.write_airports(kept, out, ports.exported_times(found, kept, chunk=5))
    rows = sinks.read_airport_times(spark, out)
    whole = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "timestamps"))), lambda x: x["timestamps"])), ",")
    return _rounded(rows.groupBy("lat", "lon").agg(F.count("*").alias("parts"), F.max(F.size("timestamps")).cast("long").alias("longest"), whole.alias("times")), 6)


@query
def airports_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports written with their times first, then without: none are left."""
    v, out = Views(spark, sf_dir), fresh_folder(spark, "stripped")
    found = checkpointed(ports.assigned(_found(v)))
    kept = checkpointed(ports.exported(ports.gathered(found), v.airports))
    sinks.write_airports(kept, out, ports.exported_times(found, kept))
    before = sinks.read_airport_times(spark, out).select(F.explode("timestamps")).count()
    sinks.write_airports(kept, out)
    after = sinks.read_airport_times(spark, out).count()
    return sinks.read_airports(spark, out).agg(F.count("*").alias("airports")).select("airports", F.lit(before).cast("long").alias("times_before"), F.lit(after).cast("long").alias("times_after"))


@query
def airports_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The airports as they are written, read back."""
    v = Views(spark, sf_dir)
    out = fresh_folder(spark, "airports")
    sinks.write_airports(ports.exported(ports.deduplicated(_found(v)), v.airports), out)
    return _rounded(sinks.read_airports(spark, out), 6)


@query
def metadata_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and years as they are written, read back; doubles have one decimal."""
    v = Views(spark, sf_dir)
    out = fresh_folder(spark, "metadata")
    sinks.write_metadata(filters.statistics(v.segments, v.heads), v.heads, out)
    rows = sinks.read_metadata(spark, out)
    return rows.select(F.array_join(F.transform("available_years", lambda y: y.cast("string")), ",").alias("years"), "num_paths", "num_aircraft", "num_airports", "total_points", "cruise_altitude_ft", F.col("min_altitude_m").cast("double").alias("min_altitude_m"), F.col("max_altitude_m").cast("double").alias("max_altitude_m"))


@query
def airport_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.markers(Views(spark, sf_dir).heads)


@query
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between the times of each log's points and the log's first, in either direction, and of unread text."""
    rows = _log(spark, sf_dir)
    first = rows.groupBy("file").agg(F.min_by("ts_raw", "seq").alias("start"))
    both = rows.join(first, "file")
    return both.select("file", "seq", F.round(times.seconds_between(F.col("start"), F.col("ts_raw")), 3).alias("gone"), F.round(times.seconds_between(F.col("ts_raw"), F.col("start")), 3).alias("back"), times.seconds_between(F.col("start"), F.lit("no time")).alias("unread"))


@query
def airport_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ports.names_of(ports.deduplicated(_found(Views(spark, sf_dir))))
    return rows.select("num_airports", F.array_join("airport_names", ",").alias("airport_names"))


def _drawn(keep_unknown: bool) -> Query:
    """The legs of all paths; those whose airports are both unknown have no path info, as data without it would."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = Views(spark, sf_dir)
        info = v.heads.join(v.airports.select(F.col("code").alias("start_airport")).distinct(), "start_airport", "left_semi")
        rows = filters.rendered(v.legs.select("path_id", "seg_idx"), info, FilterSpec(year="2025"), keep_unknown=keep_unknown)
        style = display.segment_style(F.col("registration") == "D-E003", F.lit(True))
        return rows.select("path_id", "seg_idx", "known", style["weight"].alias("weight"), style["opacity"].alias("opacity"))

    return run


_QUERIES["render_filter"] = _drawn(True)
_QUERIES["render_known"] = _drawn(False)


@query
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of an airport selected, then each toggled once: what stays of each, and the segments of a year's."""
    v = Views(spark, sf_dir)
    chosen = filters.paths_of_airport(v.heads, "EAAD").withColumn("selected", F.lit(True))
    rows = v.heads.join(chosen, "path_id", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    kept = filters.filtered_segments(v.segments, rows.where("selected AND year = 2025")).groupBy("path_id").agg(F.count("*").alias("segments"))
    toggled = filters.toggled(F.when(F.col("selected"), F.array("path_id")).otherwise(F.array().cast("array<bigint>")), F.col("path_id"))
    left = F.size(filters.cleared(F.array("path_id"))).cast("long")
    return rows.join(kept, "path_id", "left").select("path_id", "selected", "segments", (F.size(toggled) > 0).alias("after"), left.alias("cleared"))


@query
def trip_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _rounded(filters.trips(v.segments, v.heads, FilterSpec(year="2025")), 3)


@query
def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers' countries by code: of those in three regions names are known, the others show their code."""
    n, known = adapters.table(spark, sf_dir, "nation"), adapters.table(spark, sf_dir, "region").where("r_regionkey < 3")
    code = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    dim = n.join(known, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(code.alias("code"), F.col("n_name").alias("name"))
    asked = adapters.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("code"))
    return asked.join(dim, "code", "left").select("s_suppkey", names.country_name(F.col("name"), F.col("code")).alias("country"))


@query
def built_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole build: logs, a table of airports and one of models are written; the build reads them, and what it wrote is read
    back, year by year."""
    v, folder = Views(spark, sf_dir), fresh_folder(spark, "build")
    at = F.date_format(F.timestamp_micros(F.col("us") * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = v.points.join(v.paths.select("path_id", "airport_name"), "path_id")
    kml.write_logs(rows.select("path_id", "seq", "lat", "lon", "alt_m", at.alias("ts_raw"), F.col("airport_name").alias("name")), f"{folder}/logs")
    table = v.airports.select(F.col("code").alias("ident"), "name", F.col("lat").alias("latitude_deg"), F.col("lon").alias("longitude_deg"), F.col("country").alias("iso_country"))
    table.orderBy("number").coalesce(1).write.option("header", True).csv(f"{folder}/airports")
    whole = F.to_json(F.map_from_entries(F.collect_list(F.struct("registration", F.concat(F.lit("Model of "), "registration")))))
    v.paths.select("registration").distinct().agg(whole.alias("value")).write.text(f"{folder}/models")
    out = f"{folder}/out"
    build.build(spark, f"{folder}/logs", out, ports.lookup(spark, f"{folder}/airports"), ending=_TEXT)
    again = kml.parse_new(spark, f"{folder}/logs", f"{out}/_parsed", _TEXT)
    parts = sinks.read_year(spark, out, "segments").groupBy("year").agg(F.count("*").alias("segments"), F.round(F.sum("km"), 3).alias("km"))
    info = sinks.read_year(spark, out, "path_info").groupBy("year").agg(F.count("*").alias("paths"))
    more = sinks.read_metadata(spark, out).select(F.col("num_paths").alias("all_paths"), F.lit(1).alias("one"))
    more = more.join(sinks.read_airports(spark, out).agg(F.count("*").alias("airports"), F.lit(1).alias("one")), "one")
    more = more.join(kml.aircraft_models(spark, f"{folder}/models").agg(F.count("*").alias("models"), F.lit(1).alias("one")), "one")
    rows = info.join(parts, "year").withColumn("one", F.lit(1)).join(more, "one").drop("one")
    return rows.withColumn("parsed_again", F.lit(again).cast("long"))


@query
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.ranges(Views(spark, sf_dir).segments)


@query
def distinct_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.distinct_coordinates(Views(spark, sf_dir).segments).agg(F.count("*").alias("coordinates"))


@query
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bounds(Views(spark, sf_dir).points), 8)


@query
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.density(Views(spark, sf_dir).points.select((F.col("lat") + 0.0000123).alias("lat"), (F.col("lon") + 0.0000123).alias("lon")))


@query
def density_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.heat(Views(spark, sf_dir).points.select((F.col("lat") + 0.0000123).alias("lat"), (F.col("lon") + 0.0000123).alias("lon"))), 4)


@query
def combined_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by year, read back year by year as far as there are any, and put together."""
    v = Views(spark, sf_dir)
    out = fresh_folder(spark, "years")
    heads = v.heads.select("path_id", "year", "registration")
    sinks.write_years(v.segments.select("path_id", "seg_idx", "altitude_ft"), heads, out)
    rows = sinks.combined(spark, out, "segments", sinks.years_of(spark, out))
    return rows.groupBy("year").agg(F.count("*").alias("segments"), F.count_distinct("path_id").alias("paths"), F.sum("altitude_ft").cast("long").alias("feet"))


def _asked(segments: DataFrame) -> DataFrame:
    """Times before, within and after each path."""
    last = segments.groupBy("path_id").agg(F.max("time").alias("last"))
    return last.select("path_id", F.explode(F.sequence(F.lit(-1), F.lit(6))).alias("i"), "last").select("path_id", (F.floor(F.col("last") * F.col("i") / 5) + 0.25).alias("t"))


@query
def replay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Views(spark, sf_dir).segments
    return replay.as_of(s, _asked(s), else_first=False).select("path_id", "t", "seg_idx")


@query
def replay_asof_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replay_asof with paths dealt into many buckets."""
    s = Views(spark, sf_dir).segments
    return replay.as_of_split(s, _asked(s), else_first=False, bucket_seconds=50_000).select("path_id", "t", "seg_idx")


@query
def replay_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Views(spark, sf_dir).segments
    return _rounded(replay.positions(s, _asked(s)), 6)


@query
def live_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Views(spark, sf_dir).segments
    return _rounded(replay.live_positions(s, _asked(s)), 5)


@query
def replay_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's bounds, whether its middle and its first corner are near their edge, and half of its replay in per cent."""
    s = Views(spark, sf_dir).segments
    rows = replay.bounds(s).join(replay.time_range(s).select("path_id", "last"), "path_id")
    edges = [F.col(x) for x in ("south", "north", "west", "east")]
    middle = geo.outside_margin((edges[0] + edges[1]) / 2, (edges[2] + edges[3]) / 2, *edges)
    corner = geo.outside_margin(edges[0], edges[2], *[edges[0], edges[1] + 1, edges[2], edges[3] + 1])
    return _rounded(rows.select("path_id", "south", "north", "west", "east", middle.alias("middle_out"), corner.alias("corner_out"), display.progress(F.lit(50.0), F.col("last")).alias("progress")), 8)


@query
def replay_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(replay.smoothed_bearings(Views(spark, sf_dir).segments), 4)


@query
def replay_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Views(spark, sf_dir).segments
    return replay.time_range(s).join(replay.valid(s), "path_id")


@query
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Views(spark, sf_dir).paths.select("path_id", "filename", names.aircraft_from_filename(F.col("filename")).alias("a"))
    return p.select("path_id", "filename", "a.registration", "a.type", "a.route", "a.format")


@query
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kml.files_in_order(Views(spark, sf_dir).paths.select(F.col("filename").alias("file")))
    return rows.select("file", F.col("place.last").alias("unnumbered"), F.col("place.number").alias("number"))


@query
def icao_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("c_mktsegment"), F.lit(" "), adapters.airport_code(F.col("c_custkey")), F.lit(" XABC "), F.col("c_name"))
    rows = adapters.table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return rows.select("c_custkey", F.array_join(names.icao_codes(F.col("name")), ",").alias("codes"), names.label(F.col("name")).alias("label"), names.is_marker(F.col("name")).alias("marker"))


@query
def airport_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    distinct = v.paths.select(F.col("airport_name").alias("name")).distinct()
    rows = ports.standard_names(distinct, v.airports)
    return rows.select("name", "standard", names.display_name(F.col("standard"), False).alias("departure"), names.display_name(F.col("standard"), True).alias("arrival"))


@query
def iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as logs write them: ISO with a zone, a date in a name, and text that is neither."""
    o = adapters.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat("d", F.lit("T08:25:15.5848389Z"))).when(k == 1, F.concat(F.lit("Log "), F.date_format(F.to_date("d"), "dd MMM yyyy"))).otherwise("none")
    rows = o.withColumn("text", text)
    at = times.parsed(F.col("text"))
    return rows.select("o_orderkey", times.year_of(F.regexp_replace("text", "199", "202")).alias("year"), F.unix_micros(at).alias("micros"), times.date_in_name(F.col("text")).alias("dated"))


@query
def obfuscated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return privacy.shifted(rows).select("file", "seq", "ts_shifted")


@query
def obfuscation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose times are not moved, and whose markers hold their start's date, as logs write it, or only its year."""
    rows = _log(spark, sf_dir)
    at = times.parsed(F.col("ts_raw"))
    marks = rows.where("seq = 1").select("file", F.when(F.second(at) < 30, F.concat(F.lit("Takeoff: "), F.date_format(at, "dd MMM yyyy HH:mm"), F.lit(" Z"))).otherwise(F.concat(F.lit("Takeoff: "), F.date_format(at, "yyyy"), F.lit("-01-01"))).alias("name"))
    return privacy.violations(rows, marks)


@query
def obfuscated_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole log moved to the first of January: its markers' names, and that the check finds nothing any more."""
    rows = _log(spark, sf_dir)
    at = times.parsed(F.col("ts_raw"))
    marks = rows.where("seq = 1").select("file", F.concat(F.lit("Landing: "), F.date_format(at, "dd MMM yyyy HH:mm"), F.lit(" Z")).alias("name"))
    moved, named = privacy.obfuscated(rows, marks)
    left = privacy.violations(moved, named).select("file", "reason")
    return named.join(left, "file", "left").select("file", "name", "reason")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log's rows: file, seq, ts_raw."""
    v = Views(spark, sf_dir).points
    at = F.timestamp_micros(F.col("us") * 1000)
    start = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5848380Z"))
    return v.select(F.col("path_id").alias("file"), "seq", start.alias("ts_raw"))


@query
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, labels and zooms of parts' prices and sizes."""
    p = adapters.table(spark, sf_dir, "part")
    x, s = F.col("p_retailprice"), F.col("p_size").cast("double")
    return p.select("p_partkey", display.ramp(s + 0.37, F.lit(1.0), F.lit(51.0)).alias("altitude_colour"), display.ramp(s + 0.37, F.lit(1.0), F.lit(51.0), display.SPEED_RAMP).alias("speed_colour"), display.auto_zoom(x * 4, s * 3).alias("zoom"), display.zoom_class(display.auto_zoom(x * 4, s * 3)).alias("zoom_class"), display.speed_label(s * 1.5).alias("speed_label"), times.clock(F.floor(x * 3).cast("double")).alias("clock"), times.flight_time_panel(F.floor(x * 7).cast("double")).alias("panel"))


@query
def dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = adapters.table(spark, sf_dir, "supplier")
    d = (F.col("s_suppkey") % 181 - 90) + F.lit(0.26)
    return a.select("s_suppkey", geo.dms(d, True).alias("lat"), geo.dms(d, False).alias("lon"))


@query
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = Views(spark, sf_dir).legs
    return legs.select("path_id", "seg_idx", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("bearing"))


def _written(points: DataFrame, chunk: int = 500) -> DataFrame:
    """(path_id, part, xml): placemarks of at most `chunk` points each, so that no path has to fit in a row."""
    v = points.select("path_id", "seq", "us", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt_m", 2).alias("alt_m"))
    coord = F.concat(F.lit("<gx:coord>"), F.concat_ws(" ", "lon", "lat", "alt_m"), F.lit("</gx:coord>"))
    when = F.concat(F.lit("<when>"), F.date_format(F.timestamp_micros(F.col("us") * 1000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</when>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.concat(when, coord).alias("x")))), lambda r: r["x"]), "")
    xml = F.concat(F.lit("<Placemark><name>EDDF - EDDM</name><gx:Track>"), body, F.lit("</gx:Track></Placemark>"))
    return v.groupBy("path_id", F.floor((F.col("seq") - 1) / chunk).alias("part")).agg(xml.alias("xml"))


def _read_back(out: DataFrame) -> DataFrame:
    return out.select(F.col("file").cast("long").alias("path_id"), (F.col("seq") + 1).alias("seq"), "lat", "lon", "alt_m", F.unix_micros("ts").alias("micros"))


@query
def xml_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of paths written as placemarks and read back from text."""
    rows = _written(Views(spark, sf_dir).points).select(F.col("path_id").cast("string").alias("path"), F.col("path_id").cast("string").alias("file"), F.col("part").alias("at"), "xml")
    return _read_back(kml.track_points(kml.from_text(rows)))


@query
def kml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of paths written as logs, one a path, long ones in parts, and read back: the XML is scanned once."""
    folder = fresh_folder(spark, "kml")
    v = Views(spark, sf_dir).points
    at = F.date_format(F.timestamp_micros(F.col("us") * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kml.write_logs(v.select("path_id", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("alt_m", 2).alias("alt_m"), at.alias("ts_raw"), F.lit("EDDF - EDDM").alias("name")), folder, long_points=100)
    found, points, _ = kml.parsed_logs(spark, folder, "*")
    ids = found.where("size(coords) > 0").groupBy("path").agg(F.min(F.regexp_extract("description", r"track (-?\d+)", 1)).alias("track"))
    return _read_back(points.join(ids, "path").withColumn("file", F.col("track")))


@query
def kml_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files of both dialects say of their paths: a track's times, or a charter's description and name."""
    v = Views(spark, sf_dir)
    at = F.timestamp_micros(F.col("us") * 1000)
    first = v.points.groupBy("path_id").agg(F.min(at).alias("t0"), F.max(at).alias("t1"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    track = F.concat(F.lit("<Placemark><name>"), "airport_name", F.lit("</name><gx:Track><when>"), iso("t0"), F.lit("</when><when>"), iso("t1"), F.lit("</when><gx:coord>8 50 1</gx:coord><gx:coord>8 51 2</gx:coord></gx:Track></Placemark>"))
    line = F.concat(F.lit("<Placemark><name>"), "registration", F.lit("</name><description>Flight "), F.date_format("t0", "MMM d yyyy hh:mma"), F.lit(" path</description><LineString><coordinates>8.5,50.25,100 bad 8.75,50.5,200 9,51</coordinates></LineString></Placemark>"))
    rows = v.paths.join(first, "path_id").select(F.col("path_id").cast("string").alias("path"), F.col("filename").alias("file"), F.lit(0).cast("long").alias("at"), F.when(F.col("path_id") % 2 == 0, track).otherwise(line).alias("xml"))
    marks = kml.from_text(rows)
    count = kml.track_points(marks).groupBy("path").agg(F.count("*").alias("points"), F.count("alt_m").alias("with_altitude"), F.round(F.sum("lon"), 4).alias("lon"))
    return kml.metadata(marks).drop("at").join(count, "path").withColumn("path", F.col("path").cast("long")).withColumnRenamed("path", "path_id")


@query
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and notes of parts' prices and sizes, and of customers' names in markup."""
    p = adapters.table(spark, sf_dir, "part")
    x, s = F.col("p_retailprice"), F.col("p_size").cast("double")
    marked = F.concat(F.lit("<b class='x'>"), F.col("p_name"), F.lit(' & "'), F.col("p_brand"), F.lit('"</b>'))
    return p.select("p_partkey", display.altitude_legend(x * 3).alias("altitude"), display.speed_legend(s * 2).alias("speed"), display.distance_legend(s * 7 + 0.26).alias("trip"), display.altitude_label(x + 0.3).alias("feet"), display.distance_label(s * 3 + 0.26, 1).alias("km"), display.nearest_fifty(x * 3).alias("note_ft"), display.track_label(F.floor(s * 7).cast("double")).alias("track"), display.to_rgba(F.lit("rgb(1,2,3)"), 0.15).alias("rgba"), display.escaped(marked).alias("markup"), names.flag(F.substring("p_brand", 1, 2)).alias("flag"))


@query
def url_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States in the URLs of all pages, beside their own parameters: good values, and bad ones that go; read, written, and
    read again."""
    k = F.col("page_id")
    number = lambda x, n: F.format_string(f"%.{n}f", x)
    asked = F.concat(
        F.lit("y="), F.when(k % 5 == 0, "").otherwise((2020 + k % 6).cast("string")), F.lit("&a=D%2DE"), F.lpad((k % 7).cast("string"), 3, "0"), F.lit("&p="), k, F.lit("%2C"), k * 3, F.lit("%2Cx%2C+7b,&v="),
        F.substring(F.lit("1101x01011"), F.lit(1), (k % 11).cast("int")), F.lit("&lat="), number(k * 7 % 400 / 2 - 100, 1), F.lit("&lng="), number(k * 13 % 800 / 2 - 200, 1), F.lit("&z="), number(k % 50 / 2, 1),
    )
    page, part = F.substring_index("url", "#", 1), F.regexp_extract("url", "#.*$", 0)
    pages = adapters.table(spark, sf_dir, "pages").select("page_id", F.concat(page, F.when(page.contains("?"), "&").otherwise("?"), asked, part).alias("url"))
    rows = pages.withColumn("state", urls.state(urls.query_of(F.col("url")))).withColumn("written", urls.written(F.col("state")))
    again = urls.state(F.col("written"))
    same = urls.written(again) == F.col("written")
    return rows.select("page_id", "state.year", "state.aircraft", F.array_join("state.selected", ",").alias("selected"), "state.visible", "state.lat", "state.lng", "state.zoom", "written", same.alias("same"), urls.data_key("path-info", F.col("state.year")).alias("data_key"))


@query
def log_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of each kind count in logs of three dialects: prefixed tracks beside bare ones, bare tracks alone, and
    bare tracks beside other coordinates."""
    k = F.col("path_id") % 3
    v = Views(spark, sf_dir).points.groupBy("path_id").agg(F.count("*").alias("n"))
    bare = F.concat(F.lit("<Placemark><Track>"), F.repeat(F.lit("<coord>9 50 1</coord>"), F.col("n").cast("int")), F.lit("</Track></Placemark>"))
    marked = F.lit("<Placemark><gx:Track><when>2025-01-01T00:00:00Z</when><gx:coord>8 50 1</gx:coord></gx:Track></Placemark>")
    line = F.lit("<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>8,50,1 9,50,1 8,51,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")
    texts = F.when(k == 0, F.array(marked, bare)).when(k == 1, F.array(bare)).otherwise(F.array(bare, line))
    file = F.col("path_id").cast("string")
    found = kml.from_text(v.select(file.alias("path"), file.alias("file"), F.posexplode(texts).alias("at", "xml")).withColumn("at", F.col("at").cast("long")))
    rows = kml.track_points(found).groupBy(F.col("path").cast("long").alias("path_id"), "kind").agg(F.count("*").alias("points"), F.count("ts_raw").alias("timed"))
    return rows


#: Ends of the names that Spark's text writer gives to logs.
_TEXT = ".txt"


@query
def log_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files are at fault, and how: logs of all paths, every sixth of them good, the others cut off, without placemarks,
    without coordinates, or under another name."""
    folder = fresh_folder(spark, "faults")
    k = F.col("path_id") % 6
    line = Views(spark, sf_dir).points.groupBy("path_id").agg(F.array_join(F.collect_list(F.concat_ws(",", "lon", "lat", "alt_m")), " ").alias("line"))
    good = F.concat(F.lit("<kml><Placemark><LineString><coordinates>"), "line", F.lit("</coordinates></LineString></Placemark></kml>"))
    text = F.when(k == 1, F.concat(F.lit("<kml><Placemark><LineString><coordinates>"), "line")).when(k == 2, "<kml></kml>").when(k == 3, "<kml><Placemark><name>no place</name></Placemark></kml>").when(k == 4, "<kml><Placemark><LineString><coordinates>x,y</coordinates></LineString></Placemark></kml>").otherwise(good)
    logs = checkpointed(line.select(k.alias("k"), F.col("path_id").cast("string").alias("name"), text.alias("value")))
    kml.write_each(logs.where("k < 5").select("name", "value"), f"{folder}/logs")
    kml.write_each(logs.where("k = 5").select("name", "value"), f"{folder}/others", "json")
    found, points, _ = kml.parsed_logs(spark, folder, f"*{_TEXT}")
    return kml.fault_report(kml.listing(spark, folder), found, points, _TEXT).groupBy("fault").agg(F.count("*").alias("files"))


@query
def log_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store says of logs after three calls: one year's come first, then the others', then the first year's go."""
    v, store = Views(spark, sf_dir), fresh_folder(spark, "store")
    source = fresh_folder(spark, "logs")
    rows = v.points.join(v.paths.select("path_id", "year"), "path_id").select("path_id", "seq", "lat", "lon", "alt_m", F.concat(F.timestamp_micros(F.col("us") * 1000).cast("string"), F.lit("Z")).alias("ts_raw"), F.concat(F.lit("path "), "path_id").alias("name"), "year")
    kml.write_logs(rows.where("year = 2024"), f"{source}/2024")
    first = kml.parse_new(spark, source, store, _TEXT)
    kml.write_logs(rows.where("year <> 2024"), f"{source}/later")
    then, none = kml.parse_new(spark, source, store, _TEXT), kml.parse_new(spark, source, store, _TEXT)
    remove_folder(spark, f"{source}/2024")
    kml.parse_new(spark, source, store, _TEXT)
    names = kml.parsed_store(spark, store, "metadata").select("path", F.regexp_extract("name", r"path (-?\d+)", 1).cast("long").alias("path_id"))
    rows = kml.parsed_store(spark, store, "points").join(names.hint("merge"), "path").groupBy("path_id").agg(F.count("*").alias("points"), F.round(F.sum("alt_m"), 3).alias("metres"))
    return rows.select("*", F.lit(first).cast("long").alias("parsed_first"), F.lit(then).cast("long").alias("parsed_then"), F.lit(none).cast("long").alias("parsed_again"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["filtered_statistics"](spark, sf_dir)
