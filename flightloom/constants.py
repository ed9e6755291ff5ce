"""Fixed values of the flight-track semantics, in one place."""

METERS_TO_FEET = 3.28084
KM_PER_NM = 1.852
EARTH_RADIUS_KM = 6371.0
MAX_GROUNDSPEED_KNOTS = 200.0
MIN_SEGMENT_SECONDS = 0.1
SPEED_WINDOW_SECONDS = 120
CRUISE_AGL_FT = 1000.0
ALTITUDE_BIN_FT = 100
MIN_ALTITUDE_M, MAX_ALTITUDE_M = -1000.0, 50000.0
AIRPORT_DISTANCE_KM, AIRPORT_GRID_DEGREES = 1.5, 0.018
SAMPLE_MOST, SAMPLE_LEAST = 50, 5
MID_FLIGHT_ALTITUDE_M, MID_FLIGHT_VARIATION_M = 400.0, 100.0
LANDING_VARIATION_M, LANDING_ALTITUDE_M, LANDING_FALLBACK_M = 50.0, 600.0, 1000.0
QUERY_CRUISE_ALTITUDE_M = 304.8
EARTH_CIRCUMFERENCE_NM = 21639
EVEREST_FT = 29029
#: First letters of ICAO location codes: all but I, J, Q and X.
ICAO_REGIONS = "ABCDEFGHKLMNOPRSTUVWYZ"
MARKER_PATTERN = "Log Start|Log Stop|Takeoff|Landing"
