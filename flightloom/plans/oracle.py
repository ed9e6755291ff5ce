"""Each registered query as SQL of another engine over the same tables, written independently of the DataFrame code."""

from __future__ import annotations


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(CAST(6371 AS DOUBLE) * 2 * atan2(sqrt({h}), sqrt(greatest(CAST(0 AS DOUBLE), 1 - {h}))))"


def _code(x: str) -> str:
    letter = lambda d: f"chr(CAST(65 + ({x}) // {d} % 26 AS INTEGER))"
    return f"('E' || {letter(676)} || {letter(26)} || {letter(1)})"


_D = "CAST({} AS DOUBLE)".format
_PARTS = {
    "pts": f"""SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS seq,
        CAST(epoch_us(ts) // 1000 AS BIGINT) AS us, {_D(50)} + value * {_D(0.00002)} AS lat,
        {_D(10)} + (event_id % 97) * {_D(0.0001)} AS lon, value * 10 AS alt_m FROM events""",
    "paths": f"""SELECT p AS path_id, CAST(2024 + p % 3 AS INTEGER) AS year, 'D-E' || lpad(CAST(p % 7 AS VARCHAR), 3, '0') AS registration,
        CASE p % 4 WHEN 0 THEN 'C172' WHEN 1 THEN 'DA20' WHEN 2 THEN 'DA40' ELSE 'C182' END AS aircraft_type,
        {_code("p % 10")} AS start_airport, {_code("(p * 7 + 3) % 10")} AS end_airport,
        CASE WHEN p % 2 = 0 THEN CAST(p AS VARCHAR) || '_DE' || lpad(CAST(p % 7 AS VARCHAR), 3, '0') || '_DA20.kml'
             ELSE '2026-01-12_1513h_OE-' || lpad(CAST(p % 7 AS VARCHAR), 3, '0') || '_' || {_code("p % 10")} || '-' || {_code("(p * 7 + 3) % 10")} || '.kml' END AS filename
        FROM (SELECT DISTINCT user_id AS p FROM events)""",
    "apt": f"""SELECT s_suppkey AS number, {_code("s_suppkey % 17576")} AS code, s_name || ' Airport' AS name,
        48 + (s_suppkey % 10) * {_D(0.03)} AS lat, 9 + (s_suppkey // 10) * {_D(0.015)} AS lon, n_name AS country
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "nxt": """SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(alt_m) OVER w AS alt_m2, lead(us) OVER w AS us2
        FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)""",
    "legs0": f"SELECT *, seq - 1 AS seg_idx, {_hav('lat', 'lon', 'lat2', 'lon2')} AS km, (us2 - us) / {_D(1000000)} AS dt FROM nxt WHERE lat2 IS NOT NULL",
    "legs": "SELECT *, CASE WHEN dt >= 0.1 AND km / 1.852 / (dt / 3600) <= 200 THEN km / 1.852 / (dt / 3600) ELSE 0 END AS speed FROM legs0",
    "win": """SELECT *, coalesce(sum(CASE WHEN speed <> 0 THEN km END) OVER r, 0) AS wk, coalesce(sum(CASE WHEN speed <> 0 THEN us2 - us END) OVER r, 0) / CAST(1000000 AS DOUBLE) AS ws,
        (max(us2) OVER p - min(us) OVER p) / CAST(1000000 AS DOUBLE) AS lasting, sum(km) OVER p AS total
        FROM legs WINDOW r AS (PARTITION BY path_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 60000000 FOLLOWING), p AS (PARTITION BY path_id)""",
    "win2": """SELECT *, CASE WHEN ws >= 0.1 AND wk / 1.852 / (ws / 3600) <= 200 THEN wk / 1.852 / (ws / 3600) ELSE 0 END AS windowed,
        CASE WHEN lasting > 0 AND km > 0 AND total / 1.852 / (lasting / 3600) BETWEEN 1e-300 AND 200 THEN total / 1.852 / (lasting / 3600) ELSE 0 END AS fallback FROM win""",
    "spd": """SELECT path_id, seg_idx, us, us2, lat, lon, lat2, lon2, alt_m, alt_m2, km, dt, CASE WHEN windowed > 0 THEN windowed ELSE fallback END AS gs,
        CASE WHEN windowed > 0 THEN wk ELSE 0 END AS window_km, CASE WHEN windowed > 0 THEN ws ELSE 0 END AS window_s FROM win2""",
    "agl": """SELECT *, ((alt_m + alt_m2) / 2 - least(min(alt_m) OVER (PARTITION BY path_id), min(alt_m2) OVER (PARTITION BY path_id))) * 3.28084 AS agl_ft FROM spd""",
    "cru": "SELECT *, agl_ft > 1000 AND window_s >= 0.1 AND gs > 0 AS cruising, CAST(trunc(agl_ft / 100) AS BIGINT) * 100 AS bin_ft FROM agl",
    "hist": """SELECT bin_ft, sum(window_s) AS seconds, min(path_id) AS first_path, arg_min(seg_idx, path_id * CAST(1000000 AS BIGINT) + seg_idx) AS first_seg
        FROM cru WHERE cruising GROUP BY bin_ft""",
    "segs": """SELECT path_id, seg_idx, lat AS lat1, lon AS lon1, lat2, lon2, CAST(round_even((alt_m + alt_m2) / 2 * 3.28084 / 100, 0) * 100 AS DOUBLE) AS altitude_ft,
        CAST(round_even((alt_m + alt_m2) / 2, 0) AS DOUBLE) AS altitude_m, CAST(round_even(gs, 1) AS DOUBLE) AS groundspeed_knots,
        CAST(round_even((us - min(us) OVER (PARTITION BY path_id)) / CAST(1000000 AS DOUBLE), 1) AS DOUBLE) AS time, km FROM spd""",
    "seg": "SELECT * FROM segs WHERE lat1 <> lat2 OR lon1 <> lon2",
    "edges": "SELECT DISTINCT path_id, airport FROM (SELECT path_id, start_airport AS airport FROM paths UNION ALL SELECT path_id, end_airport FROM paths) WHERE airport <> ''",
    "ends": "SELECT path_id, 0 AS e, start_airport AS airport FROM paths UNION ALL SELECT path_id, 1, end_airport FROM paths",
    "counts": "SELECT airport, count(*) AS flights FROM edges GROUP BY 1",
    "asked": """SELECT path_id, floor(last * i / 5) + 0.25 AS t FROM (SELECT path_id, max(time) AS last FROM seg GROUP BY 1), (SELECT unnest(generate_series(-1, 6)) AS i)""",
    "spans": """SELECT *, lead(time) OVER w AS time3, lead(lat1) OVER w AS lat3, lead(lon1) OVER w AS lon3, lead(altitude_m) OVER w AS alt3, lead(groundspeed_knots) OVER w AS kt3
        FROM seg WINDOW w AS (PARTITION BY path_id ORDER BY time, seg_idx)""",
}
#: What each part reads.
_NEEDS = {
    "nxt": "pts", "legs0": "nxt", "legs": "legs0", "win": "legs", "win2": "win", "spd": "win2", "agl": "spd", "cru": "agl", "hist": "cru", "segs": "spd", "seg": "segs",
    "edges": "paths", "ends": "paths", "counts": "edges", "asked": "seg", "spans": "seg",
}


def _sql(body: str, *parts: str) -> str:
    """`body` behind the parts it reads and all that they read, each once."""
    found: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in found:
            found.append(name)

    for p in parts:
        add(p)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in found) + "\n" + body


def _sample(order: str, flag: str) -> str:
    return f"""SELECT path_id, round(min(alt_m), 4) AS low, round(max(alt_m), 4) AS high, round(max(alt_m) - min(alt_m), 4) AS variation, {flag} AS from_end
    FROM (SELECT path_id, alt_m, row_number() OVER (PARTITION BY path_id ORDER BY seq {order}) AS nth, count(*) OVER (PARTITION BY path_id) AS n FROM pts)
    WHERE n > 10 AND least(50, n // 4) > 5 AND nth <= least(50, n // 4) GROUP BY path_id"""


def _statistics(where: str) -> str:
    return _sql(
        f"""
    , ch AS (SELECT * FROM paths WHERE {where}), s AS (SELECT * FROM seg WHERE path_id IN (SELECT path_id FROM ch)),
    each AS (SELECT path_id, sum(km) AS km, max(time) - min(time) AS sec FROM s GROUP BY 1),
    bins AS (SELECT floor(altitude_ft / 100 + 0.5) * 100 AS bin, count(*) AS n FROM s WHERE altitude_m > 304.8 AND groundspeed_knots > 0 GROUP BY 1),
    up AS (SELECT altitude_m - lag(altitude_m) OVER (ORDER BY path_id, seg_idx) AS d FROM s)
    SELECT (SELECT count(*) FROM ch) AS num_paths, (SELECT count(DISTINCT registration) FROM ch) AS num_aircraft,
      (SELECT count(DISTINCT airport) FROM edges WHERE path_id IN (SELECT path_id FROM ch)) AS num_airports,
      round(coalesce(sum(km), 0), 3) AS total_km, coalesce(min(altitude_m), 0) AS min_altitude_m, coalesce(max(altitude_m), 0) AS max_altitude_m,
      round(coalesce(max(groundspeed_knots) FILTER (groundspeed_knots > 0), 0), 3) AS max_groundspeed_knots,
      round(coalesce(avg(groundspeed_knots) FILTER (groundspeed_knots > 0), 0), 3) AS average_groundspeed_knots,
      round(coalesce(sum(km / 1.852) FILTER (altitude_m > 304.8 AND groundspeed_knots > 0) / sum(km / 1.852 / groundspeed_knots) FILTER (altitude_m > 304.8 AND groundspeed_knots > 0), 0), 3) AS cruise_speed_knots,
      (SELECT round(coalesce(max(km), 0), 3) FROM each) AS longest_flight_km, (SELECT round(coalesce(sum(sec), 0), 3) FROM each) AS flight_seconds,
      coalesce((SELECT CAST(bin AS BIGINT) FROM bins ORDER BY n DESC, bin LIMIT 1), 0) AS cruise_altitude_ft,
      (SELECT round(coalesce(sum(d) FILTER (d > 0), 0), 3) FROM up) AS gain_m, round(coalesce(sum(km), 0) / 1.852, 3) AS total_nm, 2 * count(*) AS total_points
    FROM s""",
        "seg",
        "edges",
    )


_BEARING = "fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360, 360)"


def _ramp(bands: list[tuple[str, str, str]]) -> str:
    t = "(x * 5 - {})"
    rows = [" || ',' || ".join(f"CAST(CAST(floor({e.replace('t', t.format(i))} + 0.5) AS BIGINT) AS VARCHAR)" for e in band) for i, band in enumerate(bands)]
    return "'rgb(' || CASE " + " ".join(f"WHEN x * 5 < {i + 1} THEN {r}" for i, r in enumerate(rows[:4])) + f" ELSE {rows[4]} END || ')'"


_ALTITUDE = [("80 * (1 - t)", "160 + 95 * t", "255"), ("0", "255", "255 * (1 - t)"), ("255 * t", "255", "0"), ("255", "255 * (1 - t * 0.35)", "0"), ("255", "165 * (1 - t * 0.6)", "66 * t")]
_SPEED = [("0", "128 + 127 * t", "255"), ("0", "255", "255 * (1 - t)"), ("255 * t", "255", "0"), ("255", "255 * (1 - t * 0.5)", "0"), ("255", "128 * (1 - t)", "0")]
_ZOOM = "CAST(greatest(10, least(16, floor(16 - ((least(p_retailprice * 4 / 5000, 2) + least(CAST(p_size AS DOUBLE) * 3 / 100, 2)) / 2) * 3 + 0.5))) AS INTEGER)"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["path_distance"] = _sql("SELECT path_id, round(sum(km), 4) AS km, round(sum(km) / 1.852, 4) AS nm FROM legs0 GROUP BY 1", "legs0")
    q["segment_speed"] = _sql("SELECT path_id, seg_idx, round(km, 6) AS km, round(dt, 6) AS dt, round(speed, 4) AS speed FROM legs", "legs")
    q["windowed_groundspeed"] = _sql("SELECT path_id, seg_idx, round(gs, 3) AS gs, round(window_km, 3) AS window_km, round(window_s, 6) AS window_s FROM spd", "spd")
    q["groundspeed_split"] = q["windowed_groundspeed"]
    q["segments_projection"] = _sql("SELECT path_id, seg_idx, round(lat1, 8) AS lat1, round(lon1, 8) AS lon1, round(lat2, 8) AS lat2, round(lon2, 8) AS lon2, altitude_ft, altitude_m, groundspeed_knots, time, round(km, 6) AS km FROM seg", "seg")
    q["path_info"] = _sql(
        """, sh AS (SELECT path_id, arg_min(lat, seq) AS start_lat, arg_min(lon, seq) AS start_lon, arg_max(lat, seq) AS end_lat, arg_max(lon, seq) AS end_lon,
        (max(us) - min(us)) / CAST(1000000 AS DOUBLE) AS seconds, count(*) - 1 AS segment_count FROM pts GROUP BY 1),
        far AS (SELECT path_id, sum(km) AS km FROM legs0 GROUP BY 1)
        SELECT path_id, year, registration, start_airport, end_airport, segment_count, round(seconds, 4) AS seconds, round(coalesce(km, 0), 4) AS km,
        round(coalesce(km, 0) / 1.852, 4) AS nm, round(start_lat, 8) AS start_lat, round(start_lon, 8) AS start_lon, round(end_lat, 8) AS end_lat, round(end_lon, 8) AS end_lon
        FROM paths JOIN sh USING (path_id) LEFT JOIN far USING (path_id)""",
        "legs0",
        "paths",
    )
    q["validated_points"] = _sql(
        """, v AS (SELECT lat * (path_id % 3) AS lat, lon, alt_m * 20 - 3000 AS a FROM pts),
        k AS (SELECT CASE WHEN a BETWEEN -1000 AND 50000 THEN greatest(a, 0) END AS a FROM v WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
        SELECT count(*) AS points, count(a) AS with_altitude, CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS at_zero, round(max(a), 4) AS highest FROM k""",
        "pts",
    )
    q["altitude_sample"] = _sql(_sample("", "false") + " UNION ALL " + _sample("DESC", "true"), "pts")
    q["flight_phases"] = _sql(
        f""", a AS ({_sample("", "false")}), b AS ({_sample("DESC", "true")}),
        e AS (SELECT path_id, arg_min(alt_m, seq) AS sa, arg_max(alt_m, seq) AS ea FROM pts GROUP BY 1)
        SELECT path_id, coalesce(sa > 400 AND a.variation < 100, false) AS mid_flight_start,
        CASE WHEN b.variation IS NULL THEN ea < 1000 ELSE b.variation < 50 OR ea < 600 END AS valid_landing
        FROM e LEFT JOIN a USING (path_id) LEFT JOIN b USING (path_id)""",
        "pts",
    )
    q["basic_stats"] = _sql(
        """, g AS (SELECT path_id, alt_m, alt_m - lag(alt_m) OVER (PARTITION BY path_id ORDER BY seq) AS d FROM pts)
        SELECT count(*) AS total_points, count(DISTINCT path_id) AS num_paths, round(coalesce(sum(d) FILTER (d > 0), 0), 4) AS gain_m,
        round(min(alt_m), 4) AS min_altitude_m, round(max(alt_m), 4) AS max_altitude_m, (SELECT round(sum(km), 4) FROM legs0) AS distance_km FROM g""",
        "legs0",
    )
    q["altitude_range"] = _sql("SELECT round(coalesce(min(alt_m), 0), 4) AS low, round(coalesce(max(alt_m), 1000), 4) AS high FROM pts", "pts")
    hm = "CAST(CAST(floor({0} / 3600) AS BIGINT) AS VARCHAR) || 'h ' || CAST(CAST(floor(fmod({0}, 3600) / 60) AS BIGINT) AS VARCHAR) || 'm'"
    q["flight_time"] = _sql(
        f""", e AS (SELECT (max(us) - min(us)) / CAST(1000000 AS DOUBLE) AS s FROM pts GROUP BY path_id HAVING count(us) >= 2 AND max(us) > min(us)),
        t AS (SELECT round(coalesce(sum(s), 0), 4) AS total_seconds, count(*) AS timed_paths FROM e)
        SELECT *, CASE WHEN total_seconds <= 0 THEN '---' WHEN total_seconds >= 3600 THEN {hm.format("total_seconds")} ELSE CAST(CAST(floor(total_seconds / 60) AS BIGINT) AS VARCHAR) || 'm' END AS report,
        {hm.format("total_seconds")} AS panel FROM t""",
        "pts",
    )
    craft = """, t AS (SELECT path_id, min(us) AS us0, (max(us) - min(us)) / CAST(1000000 AS DOUBLE) AS s, count(*) AS n FROM pts GROUP BY 1), d AS (SELECT path_id, sum(km) AS km FROM legs0 GROUP BY 1),
        craft AS (SELECT registration, count(DISTINCT filename) AS flights, arg_min(aircraft_type, path_id) AS aircraft_type,
        round(sum(CASE WHEN n >= 2 THEN s ELSE 0 END), {0}) AS seconds, round(sum(CASE WHEN n >= 2 THEN km ELSE 0 END), {0}) AS km, min(path_id) AS first_path,
        array_to_string(list_sort(list(DISTINCT year(make_timestamp(us0 * 1000))) FILTER (n >= 2 AND s > 0)), ',') AS years FROM paths JOIN t USING (path_id) LEFT JOIN d USING (path_id) GROUP BY registration)"""
    q["aircraft_stats"] = _sql(
        craft.format(4) + " SELECT *, aircraft_type AS model, CAST(row_number() OVER (ORDER BY flights DESC, first_path) AS INTEGER) AS place FROM craft",
        "legs0",
        "paths",
    )
    q["fleet_models"] = _sql(
        """, e AS (SELECT path_id, max(time) - min(time) AS sec FROM seg GROUP BY 1)
        SELECT registration, arg_min(aircraft_type, path_id) AS aircraft_type, count(*) AS flights, round(coalesce(sum(sec), 0), 3) AS seconds,
        CASE WHEN registration IN (SELECT registration FROM paths WHERE aircraft_type = 'C172') THEN 'Model of ' || registration ELSE (SELECT arg_min(aircraft_type, path_id) FROM paths p WHERE p.registration = paths.registration) END AS model
        FROM paths LEFT JOIN e USING (path_id) WHERE year = 2025 GROUP BY registration""",
        "seg",
        "paths",
    )
    q["aircraft_distances"] = _sql(
        """, e AS (SELECT path_id, sum(km) AS km, CASE WHEN count(time) >= 2 THEN max(time) - min(time) END AS s FROM seg GROUP BY 1)
        SELECT registration, round(sum(km), 3) AS km, round(coalesce(sum(s), 0), 3) AS seconds FROM paths JOIN e USING (path_id) GROUP BY 1""",
        "seg",
        "paths",
    )
    q["aircraft_of_year"] = _sql("SELECT registration, arg_min(aircraft_type, path_id) AS aircraft_type, count(*) AS flights, min(path_id) AS first_path, 'all' AS chosen FROM paths WHERE year = 2025 GROUP BY 1", "paths")
    q["segment_groups"] = _sql(
        """SELECT path_id, seg_idx // 50 AS part, CAST(count(*) AS INTEGER) AS segments, min(seg_idx) AS first_idx, max(seg_idx) AS last_idx, string_agg(CAST(CAST(altitude_ft AS BIGINT) AS VARCHAR), ',' ORDER BY seg_idx) AS altitudes
        FROM seg GROUP BY 1, 2""",
        "seg",
    )
    q["first_view"] = _sql(
        """SELECT (SELECT max(year) FROM paths WHERE year <> 0) AS year, count(*) AS segments, count(DISTINCT path_id) AS paths, coalesce(min(altitude_ft), 0) AS min_ft, coalesce(max(altitude_ft), 10000) AS max_ft,
        coalesce(min(groundspeed_knots) FILTER (groundspeed_knots > 0), 0) AS min_kt, coalesce(max(groundspeed_knots) FILTER (groundspeed_knots > 0), 200) AS max_kt, count(*) FILTER (groundspeed_knots > 0) > 0 AS has_timing FROM seg""",
        "seg",
        "paths",
    )
    q["statistics_record"] = _sql(
        """, g AS (SELECT path_id, us, alt_m, alt_m - lag(alt_m) OVER (PARTITION BY path_id ORDER BY seq) AS d, count(*) OVER (PARTITION BY path_id) AS n FROM pts),
        e AS (SELECT (max(us) - min(us)) / CAST(1000000 AS DOUBLE) AS s FROM pts GROUP BY path_id HAVING count(us) >= 2 AND max(us) > min(us)),
        x AS (SELECT (SELECT count(*) FROM pts) AS total_points, (SELECT count(*) FROM (SELECT path_id FROM pts GROUP BY 1 HAVING (count(*) - 1) % 3 <> 0)) AS num_paths,
        (SELECT count(DISTINCT registration) FROM paths) AS num_aircraft, (SELECT array_to_string(list_sort(list(DISTINCT aircraft_type)), ',') FROM paths) AS aircraft_types,
        coalesce(sum(d) FILTER (d > 0), 0) AS gain_m, min(alt_m) AS min_altitude_m, max(alt_m) AS max_altitude_m, (SELECT coalesce(sum(km), 0) FROM legs0) AS distance_km,
        (SELECT coalesce(sum(s), 0) FROM e) AS total_seconds, (SELECT count(*) FROM e) AS timed_paths FROM g WHERE n >= 2)
        SELECT total_points, num_paths, num_aircraft, aircraft_types, round(gain_m, 3) AS gain_m, round(min_altitude_m, 3) AS min_altitude_m, round(max_altitude_m, 3) AS max_altitude_m, round(distance_km, 3) AS distance_km,
        round(total_seconds, 3) AS total_seconds, timed_paths, round(distance_km / 1.852, 3) AS distance_nm, round(distance_km / 1.852 / (total_seconds / 3600), 3) AS average_groundspeed_knots,
        round(gain_m * 3.28084, 3) AS gain_ft, round(min_altitude_m * 3.28084, 3) AS min_altitude_ft, round(max_altitude_m * 3.28084, 3) AS max_altitude_ft FROM x""",
        "legs0",
        "paths",
    )
    q["cruise_stats"] = _sql(
        """SELECT round(sum(window_km) FILTER (cruising), 3) AS cruise_km, round(sum(window_s) FILTER (cruising), 3) AS cruise_seconds,
        round(max(gs) FILTER (gs > 0), 3) AS max_gs, round(min(gs) FILTER (gs > 0), 3) AS min_gs,
        (SELECT bin_ft FROM hist ORDER BY round(seconds, 6) DESC, first_path, first_seg LIMIT 1) AS mode_bin_ft,
        round(coalesce(sum(window_km) FILTER (cruising) / 1.852 / (sum(window_s) FILTER (cruising) / 3600), 0), 3) AS cruise_knots_weighted FROM cru""",
        "hist",
    )
    q["cruise_histogram"] = _sql("SELECT bin_ft, round(seconds, 3) AS seconds, first_path, first_seg FROM hist", "hist")
    q["year_groups"] = _sql("SELECT coalesce(CAST(year AS VARCHAR), 'unknown') AS year, count(*) AS paths FROM paths GROUP BY 1", "paths")
    q["years"] = _sql("SELECT DISTINCT year FROM paths WHERE year <> 0", "paths")
    q["reconciled_stats"] = _sql(
        """, s AS (SELECT seg.*, year FROM seg LEFT JOIN paths USING (path_id)), lo AS (SELECT min(altitude_m) * 3.28084 AS f FROM seg),
        u AS (SELECT *, altitude_m - lag(altitude_m) OVER (ORDER BY year, path_id, seg_idx) AS d, groundspeed_knots > 0 AND altitude_m * 3.28084 > (SELECT f FROM lo) + 1000 AS c FROM s),
        b AS (SELECT CAST(round_even(altitude_ft / 100, 0) * 100 AS DOUBLE) AS bin, count(*) AS n, min(year * CAST(1000000000000 AS BIGINT) + path_id * 1000000 + seg_idx) AS f FROM u WHERE c AND time IS NOT NULL GROUP BY 1),
        t AS (SELECT max(time) - min(time) AS sec FROM seg GROUP BY path_id HAVING count(time) >= 2)
        SELECT 2 * count(*) AS total_points, min(altitude_m) AS min_altitude_m, max(altitude_m) AS max_altitude_m, round(sum(d) FILTER (d > 0), 3) AS gain_m,
        round(avg(groundspeed_knots) FILTER (groundspeed_knots > 0), 3) AS average_groundspeed_mean, round(avg(groundspeed_knots) FILTER (c), 3) AS cruise_speed_mean,
        (SELECT bin FROM b ORDER BY n DESC, f LIMIT 1) AS mode_ft, (SELECT round(sum(sec), 3) FROM t) AS flight_seconds FROM u""",
        "seg",
        "paths",
    )
    q["filtered_statistics"] = _statistics("true")
    q["filtered_statistics_year"] = _statistics("year = 2025")
    q["filtered_statistics_aircraft"] = _statistics("year = 2025 AND registration = 'D-E003'")
    q["year_review"] = _sql(
        """, ch AS (SELECT * FROM paths WHERE year = 2025), s AS (SELECT * FROM seg WHERE path_id IN (SELECT path_id FROM ch)), e AS (SELECT max(time) - min(time) AS sec FROM s GROUP BY path_id)
        SELECT count(*) AS total_flights, count(DISTINCT registration) AS num_aircraft, (SELECT count(DISTINCT airport) FROM edges WHERE path_id IN (SELECT path_id FROM ch)) AS num_airports,
        (SELECT round(coalesce(sum(km), 0) / 1.852, 3) FROM s) AS total_nm, (SELECT round(coalesce(sum(sec), 0), 3) FROM e) AS seconds FROM ch""",
        "seg",
        "edges",
    )
    q["fleet"] = _sql(
        """, e AS (SELECT path_id, max(time) - min(time) AS sec FROM seg GROUP BY 1),
        f AS (SELECT registration, arg_min(aircraft_type, path_id) AS aircraft_type, count(*) AS flights, round(coalesce(sum(sec), 0), 3) AS seconds FROM paths LEFT JOIN e USING (path_id) GROUP BY 1),
        g AS (SELECT *, min(flights) OVER () AS lo, max(flights) OVER () AS hi FROM f)
        SELECT registration, aircraft_type, flights, seconds, 'fleet-aircraft-' || CASE WHEN lo = hi OR (flights - lo) / CAST(hi - lo AS DOUBLE) >= 0.75 THEN 'high'
        WHEN (flights - lo) / CAST(hi - lo AS DOUBLE) >= 0.5 THEN 'medium-high' WHEN (flights - lo) / CAST(hi - lo AS DOUBLE) >= 0.25 THEN 'medium-low' ELSE 'low' END AS class FROM g""",
        "seg",
        "paths",
    )
    q["airport_counts"] = _sql("SELECT airport, flights, round(0.3 + flights / CAST(max(flights) OVER () AS DOUBLE) * 0.7, 6) AS opacity, round(3 + flights / CAST(max(flights) OVER () AS DOUBLE) * 5, 6) AS size FROM counts", "counts")
    q["endpoint_counts"] = _sql("SELECT airport, count(*) AS flights FROM ends GROUP BY 1", "ends")
    q["home_base"] = _sql(
        """, f AS (SELECT airport, min(path_id * 2 + e) AS first FROM ends GROUP BY 1)
        SELECT airport AS home_base, flights FROM counts JOIN f USING (airport) ORDER BY flights DESC, first LIMIT 1""",
        "counts",
        "ends",
    )
    home = "SELECT airport FROM ends GROUP BY 1 ORDER BY count(*) DESC, min(path_id * 2 + e) LIMIT 1"
    q["destinations"] = _sql(f"SELECT DISTINCT airport FROM edges WHERE airport NOT IN ({home})", "edges", "ends")
    q["country_groups"] = _sql(
        """, k AS (SELECT code AS airport, arg_max(country, number) AS country FROM apt GROUP BY 1)
        SELECT coalesce(country, 'Other') AS country, count(*) AS airports, string_agg(airport, ',' ORDER BY airport) AS names FROM (SELECT DISTINCT airport FROM edges) LEFT JOIN k USING (airport) GROUP BY 1""",
        "edges",
        "apt",
    )
    q["path_airports"] = _sql("SELECT path_id, airport FROM edges", "edges")
    q["airport_visibility"] = _sql(
        """SELECT airport, airport IN (SELECT airport FROM edges JOIN paths USING (path_id) WHERE year = 2024 AND registration = 'D-E001') AS visible FROM (SELECT DISTINCT airport FROM edges)""",
        "edges",
    )
    near = f"SELECT x.number AS a, y.number AS b, {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS km FROM apt x JOIN apt y ON x.number < y.number"
    q["airport_proximity"] = _sql(f"SELECT a, b, round(km, 6) AS km FROM ({near}) WHERE km < 1.5", "apt")
    q["airport_clusters"] = _sql(
        f""", e AS (SELECT a, b FROM ({near}) WHERE km < 1.5), l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e)
        , r AS (SELECT number, number AS root FROM apt UNION SELECT y, root FROM r JOIN l ON x = number)
        SELECT number, min(root) AS least_number FROM r GROUP BY 1""",
        "apt",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    found = f""", sh AS (SELECT path_id, arg_min(lat, seq) AS lat1, arg_min(lon, seq) AS lon1, arg_max(lat, seq) AS lat2, arg_max(lon, seq) AS lon2, min(us) AS ts, count(*) AS n, arg_min(alt_m, seq) AS sa, arg_max(alt_m, seq) AS ea FROM pts GROUP BY 1),
        va AS ({_sample("", "false")}), vb AS ({_sample("DESC", "true")}),
        f AS (SELECT sh.*, start_airport, end_airport, coalesce(sa > 400 AND va.variation < 100, false) AS mid, CASE WHEN vb.variation IS NULL THEN ea < 1000 ELSE vb.variation < 50 OR ea < 600 END AS landed
            FROM sh JOIN paths USING (path_id) LEFT JOIN va USING (path_id) LEFT JOIN vb USING (path_id)),
        cand AS (SELECT 1 AS pass, path_id, false AS e, lat1 AS lat, lon1 AS lon, ts, start_airport || ' - ' || end_airport AS name, start_airport AS code FROM f WHERE NOT mid
            UNION ALL SELECT 2, path_id, false, lat1, lon1, ts, start_airport || ' - ' || end_airport, start_airport FROM f WHERE NOT mid AND n >= 2
            UNION ALL SELECT 2, path_id, true, lat2, lon2, CASE WHEN NOT mid THEN ts END, start_airport || ' - ' || end_airport, end_airport FROM f WHERE landed AND n >= 2),
        kn AS (SELECT code, arg_max(lat, number) AS klat, arg_max(lon, number) AS klon, arg_max(country, number) AS country FROM apt GROUP BY 1),
        cor AS (SELECT CAST(pass * 1000000000000 + path_id * 2 + CAST(e AS INTEGER) AS BIGINT) AS rk, coalesce(klat, lat) AS lat, coalesce(klon, lon) AS lon, name, ts, e, path_id FROM cand LEFT JOIN kn USING (code)),
        spot AS (SELECT *, row_number() OVER (ORDER BY lat, lon) AS number FROM (SELECT lat, lon, min(rk) AS rank, arg_min(name, rk) AS name, arg_min(e, rk) AS e FROM cor GROUP BY 1, 2)),
        near AS (SELECT x.number AS a, y.number AS b FROM spot x JOIN spot y ON x.number <> y.number WHERE {_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} < 1.5),
        r AS (SELECT number, number AS root FROM spot UNION SELECT b, root FROM r JOIN near ON a = number),
        own AS (SELECT number, min(root) AS root FROM r GROUP BY 1),
        air AS (SELECT root, arg_min(lat, rank) AS lat, arg_min(lon, rank) AS lon, arg_min(name, rank) AS name, arg_min(e, rank) AS e FROM spot JOIN own USING (number) GROUP BY 1),
        vis AS (SELECT root, count(DISTINCT ts) AS visits FROM cor JOIN spot USING (lat, lon) JOIN own USING (number) WHERE ts IS NOT NULL GROUP BY 1)
        """
    recursive = lambda body: _sql(found + body, "pts", "paths", "apt").replace("WITH ", "WITH RECURSIVE ", 1)
    q["airport_dedupe"] = recursive(
        """SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, name, greatest(1, coalesce(visits, 0)) AS flight_count, country FROM
        (SELECT *, row_number() OVER (PARTITION BY printf('%.4f,%.4f', lat, lon) ORDER BY name, lat, lon) AS nth FROM air LEFT JOIN vis USING (root)) LEFT JOIN kn ON code = substr(name, 1, 4) WHERE nth = 1"""
    )
    q["airport_name_list"] = recursive("SELECT count(*) AS num_airports, string_agg(CASE WHEN e THEN substr(name, 8) ELSE substr(name, 1, 4) END, ',' ORDER BY CASE WHEN e THEN substr(name, 8) ELSE substr(name, 1, 4) END) AS airport_names FROM air")
    q["airports_written"] = q["airport_dedupe"]
    times = """, one AS (SELECT root, lat, lon, row_number() OVER (PARTITION BY printf('%.4f,%.4f', lat, lon) ORDER BY name, lat, lon) AS nth FROM air),
        d AS (SELECT root, ts, min(rk) AS rk FROM cor JOIN spot USING (lat, lon) JOIN own USING (number) WHERE ts IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT lat, lon, count(*) AS n, string_agg(CAST(ts AS VARCHAR), ',' ORDER BY rk) AS times FROM d JOIN one USING (root) WHERE nth = 1 GROUP BY 1, 2)"""
    q["airport_times"] = recursive(times + " SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, (n + 4) // 5 AS parts, least(n, 5) AS longest, times FROM g")
    q["built_datasets"] = _sql(
        found + times + """, y AS (SELECT path_id, CAST(year(make_timestamp(arg_min(us, seq) * 1000)) AS INTEGER) AS year, any_value(us) AS us FROM pts GROUP BY 1),
        s AS (SELECT year, count(*) AS segments, round(sum(km), 3) AS km FROM legs0 JOIN y USING (path_id) WHERE lat <> lat2 OR lon <> lon2 GROUP BY 1), i AS (SELECT year, count(*) AS paths FROM y GROUP BY 1)
        SELECT year, paths, segments, km, (SELECT count(*) FROM y) AS all_paths, (SELECT count(*) FROM one WHERE nth = 1) AS airports, (SELECT count(DISTINCT registration) FROM paths) AS models, CAST(0 AS BIGINT) AS parsed_again FROM i JOIN s USING (year)""",
        "pts",
        "paths",
        "apt",
        "legs0",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    q["airports_stripped"] = recursive(times + " SELECT (SELECT count(*) FROM one WHERE nth = 1) AS airports, CAST((SELECT sum(n) FROM g) AS BIGINT) AS times_before, CAST(0 AS BIGINT) AS times_after")
    beside = "abs(floor({0}.lat / 0.018) - floor({1}.lat / 0.018)) <= 1 AND abs(floor({0}.lon / 0.018) - floor({1}.lon / 0.018)) <= 1 AND {2} < 1.5".replace("0.018", _D(0.018))
    q["airport_dedupe_in_order"] = recursive(
        f""", line AS (SELECT *, row_number() OVER (ORDER BY rank) AS turn FROM spot),
        walk AS (SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(number BIGINT, lat DOUBLE, lon DOUBLE, rank BIGINT)[]) AS founded
            UNION ALL SELECT l.turn, CASE WHEN len(list_filter(founded, lambda f: {beside.format("f", "l", _hav("f.lat", "f.lon", "l.lat", "l.lon"))})) > 0 THEN founded ELSE list_append(founded, {{'number': l.number, 'lat': l.lat, 'lon': l.lon, 'rank': l.rank}}) END FROM walk w JOIN line l ON l.turn = w.turn + 1),
        port AS (SELECT unnest(founded, recursive := true) FROM (SELECT founded FROM walk ORDER BY turn DESC LIMIT 1)),
        met AS (SELECT x.rk, x.path_id, x.lat, x.lon, x.name, x.ts, x.e, p.number AS root, p.lat AS plat, p.lon AS plon,
            row_number() OVER (PARTITION BY x.rk ORDER BY floor(p.lat / {_D(0.018)}), floor(p.lon / {_D(0.018)}), p.rank) AS choice FROM cor x JOIN port p ON p.rank <= x.rk AND {beside.format("p", "x", _hav("x.lat", "x.lon", "p.lat", "p.lon"))}),
        took AS (SELECT * FROM met WHERE choice = 1),
        apr AS (SELECT root, any_value(plat) AS lat, any_value(plon) AS lon, arg_min(name, rk) AS name, count(DISTINCT ts) AS visits FROM took GROUP BY 1)
        SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, name, greatest(1, visits) AS flight_count, country FROM
        (SELECT *, row_number() OVER (PARTITION BY printf('%.4f,%.4f', lat, lon) ORDER BY name, lat, lon) AS nth FROM apr) LEFT JOIN kn ON code = substr(name, 1, 4) WHERE nth = 1"""
    )
    q["metadata_written"] = f"""SELECT '2024,2025,2026' AS years, num_paths, num_aircraft, num_airports, total_points, cruise_altitude_ft, min_altitude_m, max_altitude_m FROM ({_statistics("true")})"""
    q["airport_markers"] = _sql(
        """, f AS (SELECT airport, min(path_id * 2 + e) AS first FROM ends GROUP BY 1)
        SELECT airport, flights, airport AS label, row_number() OVER (ORDER BY flights DESC, first) = 1 AS home FROM counts JOIN f USING (airport)""",
        "counts",
        "ends",
    )
    q["durations"] = _sql(
        """, s AS (SELECT path_id, seq, us * 1000 // 1000000 AS sec, first_value(us * 1000 // 1000000) OVER (PARTITION BY path_id ORDER BY seq) AS sec0 FROM pts)
        SELECT path_id AS file, seq, CAST(sec - sec0 AS DOUBLE) AS gone, CAST(sec0 - sec AS DOUBLE) AS back, CAST(0 AS DOUBLE) AS unread FROM s""",
        "pts",
    )
    cruise = """, e AS (SELECT path_id, sum(km) AS km FROM cru GROUP BY 1), l AS (SELECT year, max(km) AS longest FROM e JOIN paths USING (path_id) GROUP BY 1)
        SELECT {0} round(sum(window_km) FILTER (cruising), 3) AS cruise_km, round(sum(window_s) FILTER (cruising), 3) AS cruise_seconds, round(max(gs) FILTER (gs > 0), 3) AS max_gs,
        round(min(gs) FILTER (gs > 0), 3) AS min_gs, round(max(longest), 3) AS longest_km FROM cru JOIN paths USING (path_id) JOIN l USING (year)"""
    q["cruise_years"] = _sql(
        f"""{cruise.format("year,").replace("SELECT year, round(sum", ", c AS (SELECT year, round(sum", 1)} GROUP BY year),
        h AS (SELECT year, bin_ft, sum(window_s) AS s, arg_min(path_id, path_id * 1000000 + seg_idx) AS p, min(path_id * 1000000 + seg_idx) % 1000000 AS i FROM cru JOIN paths USING (path_id) WHERE cruising GROUP BY 1, 2),
        g AS (SELECT year, string_agg(bin_ft || '@' || p || '/' || i, ' ' ORDER BY bin_ft) AS bins, round(sum(s), 3) AS binned_seconds FROM h GROUP BY 1)
        SELECT c.*, bins, binned_seconds FROM c LEFT JOIN g USING (year)""",
        "cru",
        "paths",
    )
    q["cruise_merged"] = _sql(
        f"""{cruise.format("").replace("SELECT  round(sum", ", c AS (SELECT round(sum", 1)}),
        b AS (SELECT bin_ft, sum(window_s) AS s, min((year, path_id, seg_idx)) AS f FROM cru JOIN paths USING (path_id) WHERE cruising GROUP BY 1)
        SELECT c.*, (SELECT bin_ft FROM b ORDER BY round(s, 6) DESC, f LIMIT 1) AS mode_bin_ft FROM c""",
        "cru",
        "paths",
    )
    facts = (
        ("times_around_the_earth", "distance", "10", "total_nm > 10819.5", "NULL", "round(total_nm / 21639, 1)"),
        ("miles", "distance", "8", "total_nm <= 10819.5 AND total_nm > 1000", "NULL", "floor(total_nm + 0.5)"),
        ("flights_of_the_only_aircraft", "aircraft", "9", "num_aircraft = 1", "craft", "num_paths"),
        ("the_only_aircraft", "aircraft", "7", "false", "NULL", "1"),
        ("two_aircraft", "aircraft", "7", "num_aircraft = 2", "NULL", "2"),
        ("many_aircraft", "aircraft", "8", "num_aircraft >= 3", "NULL", "num_aircraft"),
        ("many_countries", "countries", "9", "lands >= 3", "NULL", "lands"),
        ("two_countries", "countries", "7", "lands = 2", "NULL", "lands"),
        ("miles_a_flight_at_speed", "distance", "8", "floor(total_nm / num_paths + 0.5) > 0 AND cruise_speed_knots > 0", "NULL", "floor(total_nm / num_paths + 0.5)"),
        ("miles_a_flight", "distance", "8", "floor(total_nm / num_paths + 0.5) > 0 AND cruise_speed_knots <= 0", "NULL", "floor(total_nm / num_paths + 0.5)"),
        ("longest_flight_miles", "distance", "8", "longest_flight_km > 0", "NULL", "floor(longest_flight_km / 1.852 + 0.5)"),
        ("feet_climbed", "altitude", "8", "gain_m > 0", "NULL", "floor(gain_m * 3.28084 + 0.5)"),
        ("times_up_the_highest_mountain", "altitude", "9", "gain_m * 3.28084 > 29029", "NULL", "round(gain_m * 3.28084 / 29029, 1)"),
        ("usual_cruise_feet", "altitude", "7", "cruise_altitude_ft > 0", "NULL", "cruise_altitude_ft"),
        ("hours_in_the_air", "time", "4", "flight_seconds > 0", "NULL", "floor(flight_seconds / 3600)"),
        ("cruise_knots", "speed", "3", "cruise_speed_knots > 0", "NULL", "floor(cruise_speed_knots + 0.5)"),
        ("highest_feet", "achievement", "9", "max_altitude_m * 3.28084 > 40000", "NULL", "floor(max_altitude_m * 3.28084 + 0.5)"),
    )
    listed = " UNION ALL ".join(f"SELECT {i} AS ord, '{kind}' AS category, {p} AS priority, '{fact}' AS fact, CAST({who} AS VARCHAR) AS subject, CAST({value} AS DOUBLE) AS value FROM all_of WHERE {when}" for i, (fact, kind, p, when, who, value) in enumerate(facts))
    q["fun_facts"] = _sql(
        f""", st AS ({_statistics("year = 2025")}),
        kc AS (SELECT code AS airport, arg_max(country, number) AS country FROM apt GROUP BY 1),
        all_of AS (SELECT *, (SELECT count(DISTINCT country) FROM edges JOIN paths USING (path_id) JOIN kc USING (airport) WHERE year = 2025) AS lands,
            (SELECT registration FROM paths WHERE year = 2025 GROUP BY 1 ORDER BY count(*) DESC, registration LIMIT 1) AS craft FROM st),
        li AS ({listed}), k1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, ord) > 3 AS extra FROM li),
        k2 AS (SELECT *, row_number() OVER (PARTITION BY extra ORDER BY priority DESC, ord) AS nth, (SELECT count(*) FROM k1 WHERE NOT extra) AS n FROM k1)
        SELECT category, priority, ord, fact, subject, value FROM k2 WHERE CASE WHEN extra THEN nth <= 4 - least(n, 6) ELSE nth <= 6 END""",
        "edges",
        "apt",
    )
    drawn = """, kn AS (SELECT paths.* FROM paths WHERE start_airport IN (SELECT code FROM apt))
        SELECT l.path_id, seg_idx, CASE WHEN p.path_id IS NOT NULL THEN true END AS known, CASE WHEN registration = 'D-E003' THEN 6 ELSE 4 END AS weight,
        CAST(CASE WHEN registration = 'D-E003' THEN 1.0 ELSE 0.1 END AS DOUBLE) AS opacity FROM legs0 l LEFT JOIN kn p ON l.path_id = p.path_id WHERE year = 2025"""
    q["render_filter"] = _sql(drawn + " OR p.path_id IS NULL", "legs0", "paths", "apt")
    q["render_known"] = _sql(drawn, "legs0", "paths", "apt")
    q["selection"] = _sql(
        """, s AS (SELECT path_id, path_id IN (SELECT path_id FROM edges WHERE airport = 'EAAD') AS selected, year FROM paths), n AS (SELECT path_id, count(*) AS segments FROM seg GROUP BY 1)
        SELECT path_id, selected, CASE WHEN selected AND year = 2025 THEN segments END AS segments, NOT selected AS after, CAST(0 AS BIGINT) AS cleared FROM s LEFT JOIN n USING (path_id)""",
        "seg",
        "edges",
    )
    q["trip_means"] = _sql(
        """, s AS (SELECT coalesce(sum(km), 0) AS km FROM seg JOIN paths USING (path_id) WHERE year = 2025), f AS (SELECT count(*) AS flights FROM paths WHERE year = 2025)
        SELECT flights, round(km, 3) AS km, round(km / CAST(1.852 AS DOUBLE), 3) AS nm, round(km / flights, 3) AS mean_km, round(km / CAST(1.852 AS DOUBLE) / flights, 3) AS mean_nm FROM s, f""",
        "seg",
        "paths",
    )
    q["country_names"] = "SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'N' || s_nationkey END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    q["ranges"] = _sql("SELECT count(*) AS segments, count(DISTINCT path_id) AS paths, coalesce(min(altitude_ft), 0) AS min_ft, coalesce(max(altitude_ft), 10000) AS max_ft, coalesce(min(groundspeed_knots) FILTER (groundspeed_knots > 0), 0) AS min_kt, coalesce(max(groundspeed_knots) FILTER (groundspeed_knots > 0), 200) AS max_kt, count(*) FILTER (groundspeed_knots > 0) AS moving FROM seg", "seg")
    q["distinct_coordinates"] = _sql("SELECT count(*) AS coordinates FROM (SELECT lat1, lon1 FROM seg UNION SELECT lat2, lon2 FROM seg)", "seg")
    q["map_bounds"] = _sql(
        """SELECT round(min(lat), 8) AS min_lat, round(max(lat), 8) AS max_lat, round(min(lon), 8) AS min_lon, round(max(lon), 8) AS max_lon,
        round((min(lat) + max(lat)) / 2, 8) AS mid_lat, round((min(lon) + max(lon)) / 2, 8) AS mid_lon FROM pts""",
        "pts",
    )
    q["density_grid"] = _sql(f'SELECT CAST(floor((lat + {_D(0.0000123)}) / {_D(0.001)}) AS BIGINT) AS "row", CAST(floor((lon + {_D(0.0000123)}) / {_D(0.001)}) AS BIGINT) AS col, count(*) AS points FROM pts GROUP BY 1, 2', "pts")
    q["density_heat"] = _sql(
        f"""{", d AS (" + q["density_grid"][q["density_grid"].index("SELECT CAST(floor((lat"):] + ")"}, k AS (SELECT i, least(1, (25 - abs(i)) / CAST(15 AS DOUBLE)) AS w FROM (SELECT unnest(range(-24, 25)) AS i)),
        a AS (SELECT "row", col + i AS col, sum(points * w) AS heat FROM d, k GROUP BY 1, 2)
        SELECT "row" + i AS "row", col, round(sum(heat * w), 4) AS heat FROM a, k GROUP BY 1, 2""",
        "pts",
    )
    q["combined_years"] = _sql("SELECT year, count(*) AS segments, count(DISTINCT path_id) AS paths, CAST(sum(altitude_ft) AS BIGINT) AS feet FROM seg JOIN paths USING (path_id) GROUP BY 1", "seg", "paths")
    q["replay_asof"] = _sql("SELECT a.path_id, a.t, s.seg_idx FROM asked a ASOF LEFT JOIN seg s ON a.path_id = s.path_id AND a.t >= s.time", "asked")
    q["replay_asof_split"] = q["replay_asof"]
    q["replay_position"] = _sql(
        """, f AS (SELECT path_id, min(time) AS first FROM seg GROUP BY 1),
        j AS (SELECT a.path_id, a.t, s.* EXCLUDE (path_id) FROM (SELECT path_id, t, greatest(t, first) AS tt FROM asked JOIN f USING (path_id)) a ASOF JOIN spans s ON a.path_id = s.path_id AND a.tt >= s.time),
        k AS (SELECT *, greatest(0, least(1, (t - time) / greatest(time3 - time, 0.001))) AS x FROM j)
        SELECT path_id, t, round(CASE WHEN time3 IS NULL THEN lat2 ELSE lat2 + (lat3 - lat2) * x END, 6) AS lat, round(CASE WHEN time3 IS NULL THEN lon2 ELSE lon2 + (lon3 - lon2) * x END, 6) AS lon,
        round(CASE WHEN time3 IS NULL THEN altitude_m ELSE altitude_m + (alt3 - altitude_m) * x END, 6) AS altitude_m,
        round(CASE WHEN time3 IS NULL THEN groundspeed_knots ELSE groundspeed_knots + (kt3 - groundspeed_knots) * x END, 6) AS groundspeed_knots FROM k""",
        "asked",
        "spans",
    )
    at_rest, ahead = _BEARING.format(a="lat1", b="lon1", c="lat2", d="lon2"), _BEARING.format(a="lat2", b="lon2", c="lat3", d="lon3")
    q["live_position"] = _sql(
        f""", f AS (SELECT path_id, min(time) AS first FROM seg GROUP BY 1),
        j AS (SELECT a.path_id, a.t, s.* EXCLUDE (path_id) FROM (SELECT path_id, t, greatest(t, first) AS tt FROM asked JOIN f USING (path_id)) a ASOF JOIN spans s ON a.path_id = s.path_id AND a.tt >= s.time),
        k AS (SELECT *, time3 IS NOT NULL AND time < t AS moving, (t - time) / (time3 - time) AS x FROM j)
        SELECT path_id, t, round(CASE WHEN moving THEN lat2 + (lat3 - lat2) * x ELSE lat2 END, 5) AS lat, round(CASE WHEN moving THEN lon2 + (lon3 - lon2) * x ELSE lon2 END, 5) AS lon,
        round(CASE WHEN moving THEN {ahead} ELSE {at_rest} END, 5) AS bearing FROM k""",
        "asked",
        "spans",
    )
    q["replay_bounds"] = _sql(
        """, b AS (SELECT path_id, least(min(lat1), min(lat2)) AS south, greatest(max(lat1), max(lat2)) AS north, least(min(lon1), min(lon2)) AS west, greatest(max(lon1), max(lon2)) AS east, max(time) AS last FROM seg WHERE time IS NOT NULL GROUP BY 1),
        m AS (SELECT *, (south + north) / 2 AS y, (west + east) / 2 AS x, (north - south) * CAST(0.2 AS DOUBLE) AS h, (east - west) * CAST(0.2 AS DOUBLE) AS w FROM b)
        SELECT path_id, round(south, 8) AS south, round(north, 8) AS north, round(west, 8) AS west, round(east, 8) AS east, y < south + h OR y > north - h OR x < west + w OR x > east - w AS middle_out, true AS corner_out,
        round(CASE WHEN last = 0 THEN 0 ELSE least(100, 50 / last * 100) END, 8) AS progress FROM m""",
        "seg",
    )
    own, far = _BEARING.format(a="lat1", b="lon1", c="lat2", d="lon2"), _BEARING.format(a="lat2", b="lon2", c="fa", d="fo")
    q["replay_bearing"] = _sql(
        f""", f AS (SELECT *, last_value(lat1) OVER w AS fa, last_value(lon1) OVER w AS fo, last_value(seg_idx) OVER w AS fi FROM seg
        WINDOW w AS (PARTITION BY path_id ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
        SELECT path_id, seg_idx, round(CASE WHEN fi = seg_idx THEN {own} ELSE {far} END, 4) AS bearing FROM f""",
        "seg",
    )
    q["bearings"] = _sql(f"SELECT path_id, seg_idx, round({_BEARING.format(a='lat', b='lon', c='lat2', d='lon2')}, 4) AS bearing FROM legs0", "legs0")
    q["replay_range"] = _sql(
        """SELECT path_id, min(time) AS first, max(time) AS last, min(altitude_ft) AS low_ft, max(altitude_ft) AS high_ft, coalesce(min(groundspeed_knots) FILTER (groundspeed_knots > 0), 0) AS low_kt, coalesce(max(groundspeed_knots) FILTER (groundspeed_knots > 0), 200) AS high_kt, count(*) AS segments, count(time) AS timed, count(time) > 0 AS replayable FROM seg GROUP BY 1""",
        "seg",
    )
    q["filename_parse"] = _sql(
        """SELECT path_id, filename, CASE WHEN path_id % 2 = 0 THEN 'D-E' ELSE 'OE-' END || lpad(CAST(path_id % 7 AS VARCHAR), 3, '0') AS registration, CASE WHEN path_id % 2 = 0 THEN 'DA20' END AS type,
        CASE WHEN path_id % 2 = 1 THEN start_airport || '-' || end_airport END AS route, CASE WHEN path_id % 2 = 0 THEN 'numbered' ELSE 'charterware' END AS format FROM paths""",
        "paths",
    )
    q["file_order"] = _sql("SELECT filename AS file, false AS unnumbered, CAST(regexp_extract(filename, '^([0-9]+)', 1) AS BIGINT) AS number FROM paths", "paths")
    q["icao_codes"] = f"SELECT c_custkey, {_code('c_custkey')} AS codes, {_code('c_custkey')} AS label, false AS marker FROM customer"
    q["airport_names"] = _sql(
        """, k AS (SELECT code, arg_max(replace(name, ' Airport', ''), number) AS n FROM apt GROUP BY 1), d AS (SELECT DISTINCT start_airport AS s, end_airport AS e FROM paths),
        x AS (SELECT s || ' - ' || e AS name, s || coalesce(' ' || a.n, '') AS departure, e || coalesce(' ' || b.n, '') AS arrival FROM d LEFT JOIN k a ON a.code = s LEFT JOIN k b ON b.code = e)
        SELECT name, departure || ' - ' || arrival AS standard, departure, arrival FROM x""",
        "paths",
        "apt",
    )
    q["iso_parse"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 OR year(o_orderdate) >= 2000 AND o_orderkey % 3 = 9 THEN NULL ELSE CASE WHEN year(o_orderdate) < 2000 THEN year(o_orderdate) + 30 ELSE year(o_orderdate) END END AS year,
        CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + 30315584838 END AS micros,
        CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d %b %Y') END AS dated FROM orders"""
    q["obfuscated_times"] = _sql(
        """, f AS (SELECT path_id, arg_min(us, seq) // 1000000 AS s FROM (SELECT path_id, seq, us * 1000 AS us FROM pts) GROUP BY 1),
        m AS (SELECT path_id, seq, make_timestamp(us * 1000 // 1000000 * 1000000 - (s // 86400 - CAST(epoch(date_trunc('year', make_timestamp(s * 1000000))) AS BIGINT) // 86400) * 86400 * 1000000) AS moment FROM pts JOIN f USING (path_id))
        SELECT path_id AS file, seq, strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.5848380Z' AS ts_shifted FROM m""",
        "pts",
    )
    q["obfuscation_check"] = _sql(
        """, f AS (SELECT path_id, make_timestamp(arg_min(us, seq) * 1000) AS moment FROM pts GROUP BY 1)
        SELECT path_id AS file, 'first time' AS reason FROM f WHERE month(moment) <> 1 OR day(moment) <> 1 UNION ALL SELECT path_id, 'marker date' FROM f WHERE second(moment) < 30""",
        "pts",
    )
    q["obfuscated_markers"] = _sql("SELECT path_id AS file, 'Landing: ' || strftime(make_timestamp(arg_min(us, seq) * 1000), '%Y') || '-01-01' AS name, CAST(NULL AS VARCHAR) AS reason FROM pts GROUP BY 1", "pts")
    q["kml_metadata"] = _sql(
        """, t AS (SELECT path_id, make_timestamp(min(us) * 1000) AS t0, make_timestamp(max(us) * 1000) AS t1 FROM pts GROUP BY 1)
        SELECT path_id, filename AS file, CASE WHEN path_id % 2 = 0 THEN start_airport || ' - ' || end_airport ELSE registration END AS name,
        CASE WHEN path_id % 2 = 0 THEN strftime(t0, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(t0, '%Y-%m-%dT%H:%M:00+00:00') END AS timestamp, CASE WHEN path_id % 2 = 0 THEN strftime(t1, '%Y-%m-%dT%H:%M:%SZ') END AS end_timestamp,
        CAST(year(t0) AS INTEGER) AS year, CASE WHEN path_id % 2 = 0 THEN 'D-E' ELSE 'OE-' END || lpad(CAST(path_id % 7 AS VARCHAR), 3, '0') AS registration, CASE WHEN path_id % 2 = 0 THEN 'DA20' END AS aircraft_type,
        start_airport || ' - ' || end_airport AS airport_name, CASE WHEN path_id % 2 = 0 THEN 2 ELSE 3 END AS points, 2 AS with_altitude, CAST(CASE WHEN path_id % 2 = 0 THEN 16 ELSE 26.25 END AS DOUBLE) AS lon FROM paths JOIN t USING (path_id)""",
        "pts",
        "paths",
    )
    legend = "CAST(CAST(floor({0} + 0.5) AS BIGINT) AS VARCHAR) || ' {1} (' || CAST(CAST(floor({0} {2} + 0.5) AS BIGINT) AS VARCHAR) || ' {3})'"
    markup = "'<b class=''x''>' || p_name || ' & \"' || p_brand || '\"</b>'"
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        markup = f"replace({markup}, '{sign}', '{name}')"
    q["labels"] = f"""SELECT p_partkey, {legend.format("p_retailprice * 3", "ft", "/ 3.28084", "m")} AS altitude, {legend.format("p_size * 2", "kt", "* CAST(1.852 AS DOUBLE)", "km/h")} AS speed,
        printf('%.1f', round(p_size * 7 + CAST(0.26 AS DOUBLE), 1)) || ' nm (' || printf('%.1f', round((p_size * 7 + CAST(0.26 AS DOUBLE)) * CAST(1.852 AS DOUBLE), 1)) || ' km)' AS trip,
        CAST(CAST(floor((p_retailprice + CAST(0.3 AS DOUBLE)) * 3.28084 + 0.5) AS BIGINT) AS VARCHAR) || ' ft' AS feet, printf('%.1f', round(p_size * 3 + CAST(0.26 AS DOUBLE), 1)) || ' km' AS km,
        CAST(floor(p_retailprice * 3 / 50 + 0.5) * 50 AS BIGINT) AS note_ft, lpad(CAST(p_size * 7 AS VARCHAR), 3, '0') || '°' AS track, 'rgba(1,2,3,0.15)' AS rgba, {markup} AS markup,
        chr(CAST(127462 + ascii(upper(substr(p_brand, 1, 1))) - 65 AS INTEGER)) || chr(CAST(127462 + ascii(upper(substr(p_brand, 2, 1))) - 65 AS INTEGER)) AS flag FROM part"""
    # The longest runs of flags are ten: one too many.
    flags = "substr('1101x01011', 1, CAST(page_id % 11 AS INTEGER))"
    q["url_states"] = f"""WITH s AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN CAST(2020 + page_id % 6 AS VARCHAR) END AS year, 'D-E' || lpad(CAST(page_id % 7 AS VARCHAR), 3, '0') AS aircraft,
        page_id || ',' || page_id * 3 || ',7' AS selected, CASE WHEN page_id % 11 BETWEEN 6 AND 9 THEN rpad(replace({flags}, 'x', '0'), 9, '0') END AS visible,
        CAST(page_id * 7 % 400 AS DOUBLE) / 2 - 100 AS a, CAST(page_id * 13 % 800 AS DOUBLE) / 2 - 200 AS b, greatest(1, least(18, CAST(page_id % 50 AS DOUBLE) / 2)) AS zoom FROM pages),
        p AS (SELECT * EXCLUDE (a, b), CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN a END AS lat, CASE WHEN abs(a) <= 90 AND abs(b) <= 180 THEN b END AS lng FROM s)
        SELECT *, concat_ws('&', 'y=' || year, 'a=' || aircraft, 'p=' || replace(selected, ',', '%2C'), 'v=' || visible, 'lat=' || printf('%.6f', lat), 'lng=' || printf('%.6f', lng), 'z=' || printf('%.2f', zoom)) AS written,
        true AS same, 'PATH_INFO_' || upper(coalesce(year, 'all')) AS data_key FROM p"""
    q["log_namespaces"] = _sql(
        """, n AS (SELECT path_id, count(*) AS n FROM pts GROUP BY 1)
        SELECT path_id, CASE path_id % 3 WHEN 2 THEN 'coordinates' ELSE 'track' END AS kind, CASE path_id % 3 WHEN 0 THEN 1 WHEN 1 THEN n ELSE 3 END AS points, CASE path_id % 3 WHEN 0 THEN 1 ELSE 0 END AS timed FROM n""",
        "pts",
    )
    q["log_faults"] = """SELECT CASE k WHEN 1 THEN 'malformed' WHEN 2 THEN 'no placemarks' WHEN 3 THEN 'no coordinates' WHEN 4 THEN 'no coordinates' WHEN 5 THEN 'not a .txt file' END AS fault, count(*) AS files
        FROM (SELECT DISTINCT user_id, user_id % 6 AS k FROM events) GROUP BY 1"""
    q["log_store"] = _sql(
        """, f AS (SELECT count(*) FILTER (year = 2024) AS parsed_first, count(*) FILTER (year <> 2024) AS parsed_then FROM paths)
        SELECT path_id, count(*) AS points, round(sum(alt_m), 3) AS metres, any_value(parsed_first) AS parsed_first, any_value(parsed_then) AS parsed_then, CAST(0 AS BIGINT) AS parsed_again FROM pts JOIN paths USING (path_id), f WHERE year <> 2024 GROUP BY 1""",
        "pts",
        "paths",
    )
    clock = "CASE WHEN c >= 3600 THEN CAST(c // 3600 AS VARCHAR) || ':' || lpad(CAST(c % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(c // 60 AS VARCHAR) END || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0')"
    q["display_values"] = f"""SELECT p_partkey, {_ramp(_ALTITUDE)} AS altitude_colour, {_ramp(_SPEED)} AS speed_colour, zoom,
        CASE WHEN zoom >= 14 THEN 'xlarge' WHEN zoom >= 12 THEN 'large' ELSE 'medium' END AS zoom_class, CAST(CAST(floor(p_size * 1.5 + 0.5) AS BIGINT) AS VARCHAR) || ' kt' AS speed_label,
        {clock} AS clock, CAST(h // 3600 AS VARCHAR) || 'h ' || CAST(h % 3600 // 60 AS VARCHAR) || 'm' AS panel
        FROM (SELECT *, greatest(0, least(1, (CAST(p_size AS DOUBLE) - 0.63) / 50)) AS x, {_ZOOM} AS zoom, CAST(floor(p_retailprice * 3) AS BIGINT) AS c, CAST(floor(p_retailprice * 7) AS BIGINT) AS h FROM part)"""
    deg = "abs((s_suppkey % 181 - 90) + CAST(0.26 AS DOUBLE))"
    body = f"CAST(CAST(floor({deg}) AS BIGINT) AS VARCHAR) || '°' || CAST(CAST(floor(({deg} - floor({deg})) * 60) AS BIGINT) AS VARCHAR) || '''' || printf('%.1f', (({deg} - floor({deg})) * 60 - floor(({deg} - floor({deg})) * 60)) * 60) || '\"'"
    sign = "CASE WHEN (s_suppkey % 181 - 90) + 0.26 >= 0 THEN '{}' ELSE '{}' END"
    q["dms"] = f"SELECT s_suppkey, {body} || {sign.format('N', 'S')} AS lat, {body} || {sign.format('E', 'W')} AS lon FROM supplier"
    q["xml_points"] = q["kml_files"] = _sql("SELECT path_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt_m, 2) AS alt_m, us * 1000 // 1000000 * 1000000 AS micros FROM pts", "pts")
    return q
