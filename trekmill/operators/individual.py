"""Measures of single users. Inputs: fixes(uid, datetime, lat, lng, event_id as tie-break) or visits."""

from __future__ import annotations

from ..functions.portable import SqlOperator as Op

_V = "SELECT * FROM {fixes} WHERE VALID(lat, lng)"
_STEP = f"SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(datetime) OVER w AS pt FROM ({_V}) v WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)"
_COUNT = f"SELECT uid, lat, lng, count(*) AS n FROM ({_V}) v GROUP BY uid, lat, lng"

jump_lengths = Op("jump_lengths", "km between consecutive valid fixes of a user, one row a jump.", f"SELECT uid, event_id, round(HAVERSINE(plat, plng, lat, lng), 6) AS jump_length FROM ({_STEP}) s WHERE plat IS NOT NULL")
waiting_times = Op("waiting_times", "Seconds between consecutive fixes of a user.", f"SELECT uid, event_id, round((EPOCH_US(datetime) - EPOCH_US(pt)) / 1000000e0, 6) AS waiting_time FROM ({_STEP}) s WHERE pt IS NOT NULL")
distance_straight_line = Op("distance_straight_line", "Sum of a user's jumps in km; 0 for one fix.", f"SELECT uid, round(coalesce(sum(HAVERSINE(plat, plng, lat, lng)), 0e0), 5) AS distance_straight_line FROM ({_STEP}) s GROUP BY uid")
maximum_distance = Op("maximum_distance", "A user's longest jump in km; 0 for one fix.", f"SELECT uid, round(coalesce(max(HAVERSINE(plat, plng, lat, lng)), 0e0), 6) AS maximum_distance FROM ({_STEP}) s GROUP BY uid")
_POSITION = f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, event_id) AS pos FROM ({_V}) v"
radius_of_gyration = Op(
    "radius_of_gyration",
    "Root mean squared distance to the mean of degrees, km. Fixes are counted by coordinate first, so no task holds all of a user's.",
    f"""SELECT k.uid, round(sqrt(sum(n * pow(HAVERSINE(clat, clng, lat, lng), 2)) / sum(n)), 6) AS radius_of_gyration FROM ({_COUNT}) k
      JOIN (SELECT uid, sum(n * lat) / sum(n) AS clat, sum(n * lng) / sum(n) AS clng FROM ({_COUNT}) k2 GROUP BY uid) c ON k.uid IS NOT DISTINCT FROM c.uid GROUP BY k.uid""",
)
k_radius_of_gyration = Op(
    "k_radius_of_gyration",
    "Radius of gyration over the k most visited coordinates (ties: earliest first visit).",
    f"""SELECT uid, round(sqrt(sum(n * pow(HAVERSINE(clat, clng, lat, lng), 2)) / sum(n)), 6) AS k_radius_of_gyration FROM (
      SELECT *, sum(n * lat) OVER p / sum(n) OVER p AS clat, sum(n * lng) OVER p / sum(n) OVER p AS clng FROM (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first_pos) AS r FROM (
          SELECT uid, lat, lng, count(*) AS n, min(pos) AS first_pos FROM ({_POSITION}) f GROUP BY uid, lat, lng) a) b
      WHERE r <= <k> WINDOW p AS (PARTITION BY uid)) c GROUP BY uid""",
    k=2,
)
number_of_visits = Op("number_of_visits", "Valid fixes of each user.", f"SELECT uid, count(*) AS number_of_visits FROM ({_V}) v GROUP BY uid")
number_of_locations = Op("number_of_locations", "Distinct exact coordinates of each user.", f"SELECT uid, count(*) AS number_of_locations FROM ({_COUNT}) c GROUP BY uid")
_HOME = f"""SELECT uid, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng) AS r FROM (
  SELECT uid, lat, lng, count(*) AS n FROM (SELECT *, max(night) OVER (PARTITION BY uid) AS any_night FROM (
    SELECT *, CASE WHEN hour(datetime) >= <start_night> OR hour(datetime) < <end_night> THEN 1 ELSE 0 END AS night FROM ({_V}) v) a) b
  WHERE night = any_night GROUP BY uid, lat, lng) c) d WHERE r = 1"""
home_location = Op("home_location", "Most frequent night coordinate (all fixes where none is at night); ties: smaller lat, lng.", _HOME, start_night=22, end_night=7)
work_location = Op(
    "work_location",
    "Most frequent coordinate in working hours; days with Monday as 1 below 5, so Monday to Thursday. Users without such fixes are absent.",
    f"""SELECT uid, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng) AS r FROM (
      SELECT uid, lat, lng, count(*) AS n FROM ({_V}) v WHERE WEEKDAY(datetime) + 1 < 5 AND hour(datetime) >= <start_work> AND hour(datetime) < <end_work> GROUP BY uid, lat, lng) a) b WHERE r = 1""",
    start_work=8, end_work=18,
)
max_distance_from_home = Op("max_distance_from_home", "Largest distance to the home location, km.", f"SELECT v.uid, round(max(HAVERSINE(h.lat, h.lng, v.lat, v.lng)), 6) AS max_distance_from_home FROM ({_V}) v JOIN ({_HOME}) h ON v.uid = h.uid GROUP BY v.uid", start_night=22, end_night=7)
location_frequency = Op("location_frequency", "Share of a user's visits at each coordinate, and its rank (count, lat, lng).", f"SELECT uid, lat, lng, round(n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE), 6) AS location_frequency, LONG(row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng)) AS position FROM ({_COUNT}) c")
location_frequency_ranks = Op("location_frequency_ranks", "Mean share at each rank over the users that have it.", f"SELECT position, round(avg(share), 6) AS location_frequency FROM (SELECT n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE) AS share, LONG(row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng)) AS position FROM ({_COUNT}) c) r GROUP BY position")
frequency_rank = Op("frequency_rank", "Rank of each of a user's coordinates by visits.", f"SELECT uid, lat, lng, LONG(row_number() OVER (PARTITION BY uid ORDER BY n DESC, lat, lng)) AS frequency_rank FROM ({_COUNT}) c")
recency_rank = Op("recency_rank", "Rank of each of a user's coordinates by its last visit (time, then event), newest first.", f"SELECT uid, lat, lng, LONG(row_number() OVER (PARTITION BY uid ORDER BY last_pos DESC)) AS recency_rank FROM (SELECT uid, lat, lng, max(pos) AS last_pos FROM ({_POSITION}) f GROUP BY uid, lat, lng) c")
random_entropy = Op("random_entropy", "log2 of a user's distinct coordinates.", f"SELECT uid, round(log2(count(*)), 6) AS random_entropy FROM ({_COUNT}) c GROUP BY uid")
uncorrelated_entropy = Op("uncorrelated_entropy", "Entropy of a user's shares of visits, and that over log2 of the places (0 for one).", f"SELECT uid, round(abs(-sum(p * log2(p))), 6) AS uncorrelated_entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0e0 END, 6) AS normalized_entropy FROM (SELECT uid, n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE) AS p FROM ({_COUNT}) c) s GROUP BY uid")
individual_mobility_network = Op("individual_mobility_network", "Trips between consecutive coordinates of a user, without self loops.", f"SELECT uid, plat AS lat_origin, plng AS lng_origin, lat AS lat_dest, lng AS lng_dest, count(*) AS n_trips FROM ({_STEP}) s WHERE plat IS NOT NULL AND NOT (plat = lat AND plng = lng) GROUP BY uid, plat, plng, lat, lng")
regularity = Op("regularity", "1 - distinct (location, purpose) over visits, per user.", "SELECT uid, round(1 - count(*) / CAST(sum(n) AS DOUBLE), 6) AS regularity FROM (SELECT uid, location_id, purpose, count(*) AS n FROM {visits} GROUP BY uid, location_id, purpose) g GROUP BY uid")
visit_purpose_distribution = Op("visit_purpose_distribution", "Visits and per cent by purpose; null is UNKNOWN.", "SELECT purpose, n AS visits, round(100e0 * n / CAST(sum(n) OVER () AS DOUBLE), 6) AS per_cent FROM (SELECT coalesce(purpose, 'UNKNOWN') AS purpose, count(*) AS n FROM {visits} GROUP BY coalesce(purpose, 'UNKNOWN')) c")
daily_activity_distribution = Op(
    "daily_activity_distribution",
    "Share of each purpose in each bin of the day; a visit covers its bins, both ends in; past midnight it wraps.",
    """SELECT bin, purpose, round(n / CAST(sum(n) OVER (PARTITION BY bin) AS DOUBLE), 6) AS share FROM (SELECT bin, purpose, count(*) AS n FROM (
      SELECT purpose, b AS bin FROM (SELECT purpose, LONG(floor(lo / <bin>)) AS lo_bin, LONG(floor(hi / <bin>)) AS hi_bin FROM (
        SELECT purpose, m0 AS lo, CASE WHEN m1 < m0 THEN 1439 ELSE m1 END AS hi FROM (SELECT coalesce(purpose, 'UNKNOWN') AS purpose, hour(started_at) * 60 + minute(started_at) AS m0, hour(finished_at) * 60 + minute(finished_at) AS m1 FROM {visits}) a
        UNION ALL SELECT purpose, 0 AS lo, m1 AS hi FROM (SELECT coalesce(purpose, 'UNKNOWN') AS purpose, hour(started_at) * 60 + minute(started_at) AS m0, hour(finished_at) * 60 + minute(finished_at) AS m1 FROM {visits}) b WHERE m1 < m0) c) d SERIES(b, lo_bin, hi_bin)) e GROUP BY bin, purpose) f""",
    bin=10,
)
activity_transitions = Op("activity_transitions", "Per cent of consecutive purpose pairs over all users (long form of the matrix).", "SELECT a AS from_purpose, b AS to_purpose, round(100e0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS per_cent FROM (SELECT coalesce(purpose, 'UNKNOWN') AS a, lead(coalesce(purpose, 'UNKNOWN')) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS b FROM {visits}) p WHERE b IS NOT NULL GROUP BY a, b")
identify_locations = Op(
    "identify_locations",
    "Home: most night minutes; work: most weekday work minutes elsewhere; each visited place of a user gets home, work or other.",
    """SELECT uid, location_id, CASE WHEN hr = 1 AND night > 0 THEN 'home' WHEN wr = 1 AND work > 0 THEN 'work' ELSE 'other' END AS purpose FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN hr = 1 AND night > 0 THEN 1 ELSE 0 END, work DESC, location_id) AS wr FROM (
        SELECT *, row_number() OVER (PARTITION BY uid ORDER BY night DESC, location_id) AS hr FROM (
          SELECT uid, location_id, sum(CASE WHEN hour(started_at) >= <night_start> OR hour(started_at) < <night_end> THEN MINUTES(started_at, finished_at) ELSE 0e0 END) AS night,
            sum(CASE WHEN WEEKDAY(started_at) < 5 AND hour(started_at) >= <work_start> AND hour(started_at) < <work_end> THEN MINUTES(started_at, finished_at) ELSE 0e0 END) AS work
          FROM {visits} GROUP BY uid, location_id) a) b) c""",
    night_start=22, night_end=6, work_start=8, work_end=18,
)
activity_flag = Op("activity_flag", "Whether a stay lasts the threshold (minutes) or longer.", "SELECT uid, location_id, started_at, MINUTES(started_at, finished_at) >= <minutes> AS activity FROM {visits}", minutes=15)
next_location_counts = Op("next_location_counts", "Counts of the place after each place of a user (first-order contexts).", "SELECT uid, context, next_id, count(*) AS n FROM (SELECT uid, location_id AS context, lead(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS next_id FROM {visits}) p WHERE next_id IS NOT NULL GROUP BY uid, context, next_id")
next_location = Op(
    "next_location",
    "Most likely next place after a user's last one: first order, backing off to the overall counts; ties: smaller id.",
    """SELECT uid, next_id FROM (SELECT uid, next_id, row_number() OVER (PARTITION BY uid ORDER BY o DESC, n DESC, next_id) AS r FROM (
      SELECT c.uid, c.next_id, count(*) AS n, 1 AS o FROM (SELECT uid, location_id AS context, lead(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS next_id FROM {visits}) c
        JOIN (SELECT uid, location_id FROM (SELECT uid, location_id, row_number() OVER (PARTITION BY uid ORDER BY started_at DESC, location_id DESC) AS r FROM {visits}) l WHERE r = 1) k ON c.uid = k.uid AND c.context = k.location_id
        WHERE c.next_id IS NOT NULL GROUP BY c.uid, c.next_id
      UNION ALL SELECT uid, location_id AS next_id, count(*) AS n, 0 AS o FROM {visits} GROUP BY uid, location_id) a) b WHERE r = 1""",
)
next_location_evaluation = Op(
    "next_location_evaluation",
    "Accuracy at 1 of that prediction for each user's last visit, from the visits before.",
    """SELECT round(avg(CASE WHEN p.next_id = t.location_id THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS users FROM (
      SELECT uid, location_id, prev FROM (SELECT uid, location_id, lag(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS prev, row_number() OVER (PARTITION BY uid ORDER BY started_at DESC, location_id DESC) AS r FROM {visits}) z WHERE r = 1 AND prev IS NOT NULL) t
      LEFT JOIN (SELECT uid, context, next_id FROM (SELECT uid, context, next_id, row_number() OVER (PARTITION BY uid, context ORDER BY n DESC, next_id) AS q FROM (
        SELECT uid, context, next_id, count(*) AS n FROM (SELECT uid, location_id AS context, lead(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS next_id, lead(location_id, 2) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS after_id FROM {visits}) y WHERE next_id IS NOT NULL AND after_id IS NOT NULL GROUP BY uid, context, next_id) x) w WHERE q = 1) p
      ON t.uid = p.uid AND t.prev = p.context""",
)
