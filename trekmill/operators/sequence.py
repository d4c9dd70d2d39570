"""Cleaning, segmentation, joins and contacts, as windows and joins."""

from __future__ import annotations

from ..functions.portable import SqlOperator as Op
from .individual import _V

_STEP = f"SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(datetime) OVER w AS pt, lag(place) OVER w AS pplace FROM ({_V}) v WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)"
_SPEED = f"SELECT *, MINUTES(pt, datetime) AS dt, HAVERSINE(plat, plng, lat, lng) AS km FROM ({_STEP}) s"
_OK = f"SELECT *, CASE WHEN pt IS NULL OR (dt > 0 AND km / dt * 60 <= <max_speed_kmh>) THEN 1 ELSE 0 END AS ok FROM ({_SPEED}) d"
_RUN = "sum(new) OVER (PARTITION BY uid ORDER BY datetime, event_id) AS segment_id"

filter_greedy = Op("filter_greedy", "Keeps a fix whose step from the row before is consistent (time passes, speed within bounds).", f"SELECT uid, event_id FROM ({_OK}) o WHERE ok = 1", max_speed_kmh="100e0")
filter_zheng = Op("filter_zheng", "Keeps runs of consistent steps longer than min_seg_size.", f"SELECT uid, event_id FROM (SELECT *, count(*) OVER (PARTITION BY uid, run) AS size FROM (SELECT *, sum(1 - ok) OVER (PARTITION BY uid ORDER BY datetime, event_id) AS run FROM ({_OK}) o) r) z WHERE size > <min_seg_size>", max_speed_kmh="100e0", min_seg_size=1)
segment_observation_gap = Op("segment_observation_gap", "New segment where more than gap_s seconds pass.", f"SELECT uid, event_id, LONG({_RUN.split(' AS ')[0]}) AS segment_id FROM (SELECT *, CASE WHEN pt IS NOT NULL AND MINUTES(pt, datetime) * 60 > <gap_s> THEN 1 ELSE 0 END AS new FROM ({_STEP}) s) n", gap_s=3600)
segment_value_change = Op("segment_value_change", "New segment where the place changes.", f"SELECT uid, event_id, LONG({_RUN.split(' AS ')[0]}) AS segment_id FROM (SELECT *, CASE WHEN pplace IS NOT NULL AND pplace <> place THEN 1 ELSE 0 END AS new FROM ({_STEP}) s) n")
segment_temporal = Op("segment_temporal", "New segment with each new day (or other unit).", f"SELECT uid, event_id, LONG({_RUN.split(' AS ')[0]}) AS segment_id FROM (SELECT *, CASE WHEN pt IS NOT NULL AND TRUNC('<unit>', pt) <> TRUNC('<unit>', datetime) THEN 1 ELSE 0 END AS new FROM ({_STEP}) s) n", unit="day")
interpolate_linear = Op(
    "interpolate_linear",
    "Where more than rate_s seconds pass, one point at the rate after the earlier fix, on the straight line.",
    f"SELECT uid, event_id, round(plat + (lat - plat) * (<rate_s> / (MINUTES(pt, datetime) * 60)), 6) AS lat, round(plng + (lng - plng) * (<rate_s> / (MINUTES(pt, datetime) * 60)), 6) AS lng FROM ({_STEP}) s WHERE pt IS NOT NULL AND MINUTES(pt, datetime) * 60 > <rate_s>",
    rate_s="3600e0",
)
trajectory_to_od = Op("trajectory_to_od", "Consecutive cells of a user as counted pairs, without self loops.", f"SELECT pplace AS origin, place AS destination, count(*) AS flow FROM ({_STEP}) s WHERE pplace IS NOT NULL AND pplace <> place GROUP BY pplace, place")
trajectory_to_trips = Op("trajectory_to_trips", "One trip for each pair of consecutive fixes in different cells.", f"SELECT uid, event_id AS trip_id, pplace AS origin, place AS destination, MINUTES(pt, datetime) AS minutes FROM ({_STEP}) s WHERE pplace IS NOT NULL AND pplace <> place")
_STAYS = f"""SELECT *, LONG(row_number() OVER w) AS visit_number, lead(started_at) OVER w AS next_start, lead(lat) OVER w AS next_lat, lead(lng) OVER w AS next_lng, lead(place) OVER w AS next_place FROM (
        SELECT uid, run, min(place) AS place, min(datetime) AS started_at, max(datetime) AS last_at, median(lat) AS lat, median(lng) AS lng, count(*) AS records FROM (
          SELECT *, sum(CASE WHEN pplace IS NULL OR pplace <> place THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY datetime, event_id) AS run FROM ({_STEP}) s) r GROUP BY uid, run) g WINDOW w AS (PARTITION BY uid ORDER BY started_at)"""
_TRAVEL = "least(MINUTES(last_at, next_start), HAVERSINE(lat, lng, next_lat, next_lng) * <circuity> / <avg_speed_kmh> * 60)"
_END = "PLUS_US(next_start, 0 - LONG(round(60000000e0 * " + _TRAVEL + ")))"
cdr_visits = Op(
    "cdr_visits",
    "Runs of records at one venue as stays; a stay ends when the trip to the next must start (travel at avg_speed_kmh over circuity, at most the gap), the last one stays open. ",
    f"""SELECT uid, visit_number, place, started_at, last_at, {_END} AS finished_at, round(MINUTES(started_at, {_END}), 4) AS stay_minutes, round(lat, 6) AS lat, round(lng, 6) AS lng, records, round({_TRAVEL}, 4) AS travel_minutes, next_start IS NULL AS is_open FROM ({_STAYS}) z""",
    avg_speed_kmh="50e0", circuity="1.2e0",
)
cdr_trips = Op(
    "cdr_trips",
    "A trip from each stay to the next one, numbered by user: places and their coordinates, straight and road distance, departure, arrival, minutes and speed.",
    f"""SELECT uid, visit_number AS trip_number, place AS origin, next_place AS destination, round(lat, 6) AS origin_lat, round(lng, 6) AS origin_lng, round(next_lat, 6) AS destination_lat, round(next_lng, 6) AS destination_lng,
      round(HAVERSINE(lat, lng, next_lat, next_lng), 6) AS straight_km, round(HAVERSINE(lat, lng, next_lat, next_lng) * <circuity>, 6) AS km, {_END} AS departs_at, next_start AS arrives_at, round({_TRAVEL}, 4) AS minutes, round(MINUTES(last_at, next_start), 4) AS gap_minutes,
      round(CASE WHEN {_TRAVEL} > 0 THEN HAVERSINE(lat, lng, next_lat, next_lng) * <circuity> / ({_TRAVEL} / 60) END, 4) AS speed_kmh FROM ({_STAYS}) z WHERE next_start IS NOT NULL""",
    avg_speed_kmh="50e0", circuity="1.2e0",
)
join_with_events = Op(
    "join_with_events",
    "Nearest other fix in space within window_s seconds (both ends in), by buckets of that length; ties: earliest.",
    f"""SELECT event_id, other_id, round(d, 6) AS dist_event FROM (SELECT a.event_id, b.event_id AS other_id, HAVERSINE(a.lat, a.lng, b.lat, b.lng) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY round(HAVERSINE(a.lat, a.lng, b.lat, b.lng), 9), b.datetime, b.event_id) AS r
      FROM (SELECT *, k FROM (SELECT *, LONG(floor(EPOCH_US(datetime) / (<window_s> * 1000000e0))) AS b0 FROM ({_V}) v1) x SERIES(k, b0 - 1, b0 + 1)) a
      JOIN (SELECT *, LONG(floor(EPOCH_US(datetime) / (<window_s> * 1000000e0))) AS k2 FROM ({_V}) v2) b ON a.k = b.k2 AND abs(EPOCH_US(a.datetime) - EPOCH_US(b.datetime)) <= <window_s> * 1000000 AND a.uid <> b.uid) n WHERE r = 1""",
    window_s=900,
)
validate_locations = Op("validate_locations", "Visits whose place is not in the catalogue; visits without a place are left alone.", "SELECT v.uid, v.location_id FROM {visits} v WHERE v.location_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {catalogue} p WHERE p.location_id = v.location_id)")
validate_user_locations = Op("validate_user_locations", "The same for a catalogue of each user's own places.", "SELECT v.uid, v.location_id FROM {visits} v WHERE v.location_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {own_places} p WHERE p.uid = v.uid AND p.location_id = v.location_id)")
_DAY = "SELECT uid, location_id, d, greatest(LONG(EPOCH_US(started_at)), d * 86400000000) AS s, least(LONG(EPOCH_US(finished_at)), (d + 1) * 86400000000) AS e FROM (SELECT *, LONG(floor(EPOCH_US(started_at) / 86400000000e0)) AS d0, LONG(floor(EPOCH_US(finished_at) / 86400000000e0)) AS d1 FROM {visits}) v SERIES(d, d0, d1)"
#: Stays by the quarters of an hour they touch: two that overlap meet in the quarter where the later one begins, and are counted there alone.
_QUARTER = f"SELECT uid, location_id, d, s, e, q FROM (SELECT *, LONG(floor(s / 900000000e0)) AS q0, LONG(floor(e / 900000000e0)) AS q1 FROM ({_DAY}) day_part) quarters SERIES(q, q0, q1)"
_EDGE = f"SELECT DISTINCT a.d AS day, a.uid AS u, b.uid AS v FROM ({_QUARTER}) a JOIN ({_QUARTER}) b ON a.d = b.d AND a.location_id = b.location_id AND a.q = b.q AND a.uid < b.uid AND a.q = LONG(floor(greatest(a.s, b.s) / 900000000e0)) AND least(a.e, b.e) - greatest(a.s, b.s) >= <minutes> * 60000000"
temporal_contacts = Op("temporal_contacts", "Daily contacts: users at one place for minutes together.", _EDGE, minutes=5)
contact_network = Op("contact_network", "All contacts, with the share of spanned days that have them.", f"SELECT u, v, round(n / CAST(days AS DOUBLE), 6) AS persistence FROM (SELECT u, v, count(*) AS n FROM ({_EDGE}) e GROUP BY u, v) f CROSS JOIN (SELECT max(day) - min(day) + 1 AS days FROM ({_EDGE}) e2) g", minutes=5)
_UNDIRECTED = f"SELECT DISTINCT u, v FROM ({_EDGE}) q0"
topological_overlap = Op(
    "topological_overlap",
    "Common neighbours over all neighbours of either end of a contact.",
    f"""SELECT e.u, e.v, round(CASE WHEN du.n + dv.n - coalesce(c.n, 0) > 0 THEN coalesce(c.n, 0) / CAST(du.n + dv.n - coalesce(c.n, 0) AS DOUBLE) ELSE 0e0 END, 6) AS overlap FROM ({_UNDIRECTED}) e
      JOIN (SELECT a, count(*) AS n FROM (SELECT u AS a, v AS b FROM ({_UNDIRECTED}) q1 UNION ALL SELECT v AS a, u AS b FROM ({_UNDIRECTED}) q2) s1 GROUP BY a) du ON e.u = du.a JOIN (SELECT a, count(*) AS n FROM (SELECT u AS a, v AS b FROM ({_UNDIRECTED}) q3 UNION ALL SELECT v AS a, u AS b FROM ({_UNDIRECTED}) q4) s2 GROUP BY a) dv ON e.v = dv.a
      LEFT JOIN (SELECT x.u, x.v, count(*) AS n FROM ({_UNDIRECTED}) x JOIN (SELECT u AS a, v AS b FROM ({_UNDIRECTED}) q5 UNION ALL SELECT v AS a, u AS b FROM ({_UNDIRECTED}) q6) p ON p.a = x.u JOIN (SELECT u AS a, v AS b FROM ({_UNDIRECTED}) q7 UNION ALL SELECT v AS a, u AS b FROM ({_UNDIRECTED}) q8) r ON r.a = x.v AND r.b = p.b GROUP BY x.u, x.v) c ON e.u = c.u AND e.v = c.v""",
    minutes=5,
)
