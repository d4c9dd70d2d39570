"""DuckDB SQL of the queries, written apart from the operators: other joins, list functions, arg_min, recursion.

Texts here share nothing with the operators but the views of the driver's tables. What
this module does not name is held against the operator's own text in DuckDB's dialect.
"""

from __future__ import annotations

import re

from ..functions.portable import dialect
from .views import VIEWS


def km(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance by the arc tangent of the half chord."""
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * 6371.0088 * atan2(sqrt({h}), sqrt(greatest(0, 1 - {h}))))"


#: Each fix with its number among its user's, and each with the one before it.
_N = "n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, event_id) AS k FROM fixes)"
_J = f"{_N}, j AS (SELECT b.*, a.lat AS alat, a.lng AS alng, a.datetime AS before, a.place AS aplace, {km('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km, epoch_us(b.datetime) - epoch_us(a.datetime) AS us FROM n a JOIN n b ON a.uid = b.uid AND b.k = a.k + 1)"
_C = "c AS (SELECT uid, lat, lng, count(*) AS n FROM fixes GROUP BY ALL)"
_W = "w AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY started_at, location_id) AS k FROM visits)"
_P = "p AS (SELECT a.uid, a.location_id AS o, b.location_id AS d, a.purpose AS po, b.purpose AS pd FROM w a JOIN w b ON a.uid = b.uid AND b.k = a.k + 1)"
_NIGHT = "f AS (SELECT *, (date_part('hour', datetime) >= 22 OR date_part('hour', datetime) < 7) AS night FROM fixes), u AS (SELECT uid, bool_or(night) AS any_night FROM f GROUP BY uid), h0 AS (SELECT f.uid, lat, lng, count(*) AS n FROM f JOIN u USING (uid) WHERE f.night = u.any_night GROUP BY ALL), h AS (SELECT uid, arg_min(struct_pack(lat := lat, lng := lng), struct_pack(a := -n, b := lat, c := lng)) AS x FROM h0 GROUP BY uid)"
_FLOW = "f AS (SELECT origin, destination, any_value(x) AS x, any_value(y) AS y FROM (SELECT origin, destination, sum(x) AS x, sum(y) AS y FROM (SELECT origin, destination, flow AS x, 0.0 AS y FROM observed UNION ALL SELECT origin, destination, 0.0, flow FROM predicted) z WHERE origin <> destination GROUP BY ALL) q GROUP BY ALL)"


def _segments(new: str) -> str:
    """Running number of the rows of j where new holds."""
    return f"WITH {_J}, s AS (SELECT uid, event_id, k, ({new})::INT AS new FROM j UNION ALL SELECT uid, event_id, k, 0 FROM n WHERE k = 1) SELECT uid, event_id, (list_sum(list(new) OVER (PARTITION BY uid ORDER BY k ROWS UNBOUNDED PRECEDING)))::BIGINT AS segment_id FROM s"


def _near(distance: str, by: str = "") -> str:
    keys = f"c.lat, c.lng{', p.' + by if by else ''}"
    return f"m AS (SELECT {keys}, arg_min(struct_pack(id := p.id, d := {distance}), struct_pack(a := round({distance}, 9), b := p.id)) AS x FROM (SELECT DISTINCT lat, lng FROM fixes) c CROSS JOIN pois p GROUP BY {keys})"


_KM = km("c.lat", "c.lng", "p.lat", "p.lng")
_STAY = "EXTRACT(epoch FROM (finished_at - started_at)) / 60"
TEXTS = {
    "jump_lengths": f"WITH {_J} SELECT uid, event_id, round(km, 6) AS jump_length FROM j",
    "waiting_times": f"WITH {_J} SELECT uid, event_id, round(us / 1e6, 6) AS waiting_time FROM j",
    "distance_straight_line": f"WITH {_J} SELECT n.uid, round(coalesce(sum(km), 0), 5) AS distance_straight_line FROM n LEFT JOIN j USING (uid, event_id) GROUP BY n.uid",
    "maximum_distance": f"WITH {_J} SELECT n.uid, round(coalesce(max(km), 0), 6) AS maximum_distance FROM n LEFT JOIN j USING (uid, event_id) GROUP BY n.uid",
    "radius_of_gyration": f"WITH m AS (SELECT uid, avg(lat) AS a, avg(lng) AS b FROM fixes GROUP BY uid) SELECT uid, round(sqrt(avg(pow({km('a', 'b', 'lat', 'lng')}, 2))), 6) AS radius_of_gyration FROM fixes JOIN m USING (uid) GROUP BY uid",
    "k_radius_of_gyration": f"WITH {_N}, g AS (SELECT uid, lat, lng, count(*) AS c, min(k) AS first FROM n GROUP BY ALL), t AS (SELECT uid, unnest(list(struct_pack(lat := lat, lng := lng, c := c) ORDER BY c DESC, first)[1:2]) AS e FROM g GROUP BY uid), m AS (SELECT uid, sum(e.c * e.lat) / sum(e.c) AS a, sum(e.c * e.lng) / sum(e.c) AS b FROM t GROUP BY uid) SELECT uid, round(sqrt(sum(e.c * pow({km('a', 'b', 'e.lat', 'e.lng')}, 2)) / sum(e.c)), 6) AS k_radius_of_gyration FROM t JOIN m USING (uid) GROUP BY uid",
    "number_of_visits": "SELECT uid, len(list(event_id)) AS number_of_visits FROM fixes GROUP BY uid",
    "number_of_locations": "SELECT uid, count(DISTINCT (lat, lng)) AS number_of_locations FROM fixes GROUP BY uid",
    "home_location": f"WITH {_NIGHT} SELECT uid, x.lat AS lat, x.lng AS lng FROM h",
    "homes_per_location": f"WITH {_NIGHT} SELECT x.lat AS lat, x.lng AS lng, count(*) AS n_homes FROM h GROUP BY ALL",
    "work_location": "WITH g AS (SELECT uid, lat, lng, count(*) AS n FROM fixes WHERE isodow(datetime) BETWEEN 1 AND 4 AND date_part('hour', datetime) BETWEEN 8 AND 17 GROUP BY ALL) SELECT uid, arg_min(lat, (-n, lat, lng)) AS lat, arg_min(lng, (-n, lat, lng)) AS lng FROM g GROUP BY uid",
    "max_distance_from_home": f"WITH {_NIGHT} SELECT uid, round(max({km('x.lat', 'x.lng', 'lat', 'lng')}), 6) AS max_distance_from_home FROM fixes JOIN h USING (uid) GROUP BY uid",
    "location_frequency": f"WITH {_C}, t AS (SELECT uid, count(*) AS m FROM fixes GROUP BY uid) SELECT a.uid, a.lat, a.lng, round(a.n::DOUBLE / t.m, 6) AS location_frequency, (SELECT count(*) FROM c b WHERE b.uid = a.uid AND (-b.n, b.lat, b.lng) <= (-a.n, a.lat, a.lng)) AS position FROM c a JOIN t USING (uid)",
    "frequency_rank": f"WITH {_C} SELECT a.uid, a.lat, a.lng, (SELECT count(*) FROM c b WHERE b.uid = a.uid AND (-b.n, b.lat, b.lng) <= (-a.n, a.lat, a.lng)) AS frequency_rank FROM c a",
    "location_frequency_ranks": f"WITH {_C}, l AS (SELECT uid, list(n ORDER BY n DESC, lat, lng) AS s, sum(n) AS m FROM c GROUP BY uid), r AS (SELECT unnest(range(1, len(s) + 1)) AS position, unnest(s) / m AS share FROM l) SELECT position, round(avg(share), 6) AS location_frequency FROM r GROUP BY position",
    "recency_rank": "WITH l AS (SELECT uid, lat, lng, max((datetime, event_id)) AS last FROM fixes GROUP BY ALL) SELECT a.uid, a.lat, a.lng, (SELECT count(*) FROM l b WHERE b.uid = a.uid AND b.last >= a.last) AS recency_rank FROM l a",
    "random_entropy": "SELECT uid, round(log2(count(DISTINCT (lat, lng))), 6) AS random_entropy FROM fixes GROUP BY uid",
    "uncorrelated_entropy": "WITH e AS (SELECT uid, list_entropy(list((lat, lng)::VARCHAR)) AS h, count(DISTINCT (lat, lng)) AS n FROM fixes GROUP BY uid) SELECT uid, round(abs(h), 6) AS uncorrelated_entropy, round(CASE WHEN n > 1 THEN h / log2(n) ELSE 0 END, 6) AS normalized_entropy FROM e",
    "individual_mobility_network": f"WITH {_J} SELECT uid, alat AS lat_origin, alng AS lng_origin, lat AS lat_dest, lng AS lng_dest, count(*) AS n_trips FROM j WHERE (alat, alng) <> (lat, lng) GROUP BY ALL",
    "regularity": "SELECT uid, round(1 - count(DISTINCT (location_id, purpose)) / count(*), 6) AS regularity FROM visits GROUP BY uid",
    "visit_purpose_distribution": "SELECT ifnull(purpose, 'UNKNOWN') AS purpose, count(*) AS visits, round(100.0 * count(*) / (SELECT count(*) FROM visits), 6) AS per_cent FROM visits GROUP BY 1",
    "activity_transitions": f"WITH {_W}, {_P} SELECT ifnull(po, 'UNKNOWN') AS from_purpose, ifnull(pd, 'UNKNOWN') AS to_purpose, round(100.0 * count(*) / (SELECT count(*) FROM p), 6) AS per_cent FROM p GROUP BY ALL",
    "activity_flag": f"SELECT uid, location_id, started_at, {_STAY} >= 60 AS activity FROM visits",
    "next_location_counts": f"WITH {_W}, {_P} SELECT uid, o AS context, d AS next_id, count(*) AS n FROM p GROUP BY ALL",
    "visits_per_location": "SELECT location_id, len(list(uid)) AS n_visits FROM visits WHERE location_id IS NOT NULL GROUP BY location_id",
    "visits_per_time_unit": "SELECT time_bucket(INTERVAL 1 HOUR, datetime) AS time_unit, count(*) AS n_visits FROM fixes GROUP BY 1",
    "random_location_entropy": "SELECT lat, lng, round(log2(len(list_distinct(list(uid)))), 6) AS random_location_entropy FROM fixes GROUP BY lat, lng",
    "uncorrelated_location_entropy": "SELECT lat, lng, round(abs(entropy(uid)), 6) AS uncorrelated_location_entropy FROM fixes GROUP BY lat, lng",
    "mean_square_displacement": f"WITH a AS (SELECT uid, min(datetime) AS t, arg_min(lat, (datetime, event_id)) AS y, arg_min(lng, (datetime, event_id)) AS x FROM fixes GROUP BY uid), b AS (SELECT uid, y, x, arg_max(lat, (datetime, event_id)) AS v, arg_max(lng, (datetime, event_id)) AS w FROM fixes JOIN a USING (uid) WHERE datetime <= t + INTERVAL 14400 MINUTE GROUP BY uid, y, x) SELECT round(avg(pow({km('y', 'x', 'v', 'w')}, 2)), 6) AS mean_square_displacement FROM b",
    "od_matrix": f"WITH {_W}, {_P} SELECT o AS origin, d AS destination, count(*) AS flow FROM p WHERE o IS NOT NULL AND d IS NOT NULL GROUP BY ALL",
    "trips_to_flows": f"WITH {_W}, {_P} SELECT o AS origin, d AS destination, count(*) AS flow FROM p WHERE o <> d GROUP BY ALL",
    "od_metrics_per_area": "WITH a AS (SELECT origin AS area FROM flows UNION SELECT destination FROM flows) SELECT area, coalesce((SELECT sum(flow) FROM flows WHERE origin = area AND destination = area), 0) AS move_inside, coalesce((SELECT sum(flow) FROM flows WHERE origin <> area AND destination = area), 0) AS in_coming, coalesce((SELECT sum(flow) FROM flows WHERE origin = area AND destination <> area), 0) AS out_going, (SELECT sum(flow) FROM flows WHERE origin = area OR destination = area) AS total FROM a",
    "get_flow": "SELECT coalesce((SELECT sum(flow) FROM flows WHERE (origin, destination) = (1, 2)), 0.0) AS flow",
    "interest_network": "WITH l AS (SELECT location_id AS id, list_distinct(list(uid)) AS s FROM visits GROUP BY 1), r AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS shared FROM l a JOIN l b ON a.id < b.id) SELECT * FROM r WHERE shared > 0",
    "daily_location_lognormal": "WITH d AS (SELECT ln(len(list_distinct(list(location_id)))) AS x FROM visits GROUP BY uid, started_at::DATE) SELECT round(avg(x), 6) AS mu, round(sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS sigma, count(*) AS user_days FROM d",
    "gravity_singly": "WITH q AS (SELECT a.location_id AS o, b.location_id AS d, a.tot_outflow AS t, b.relevance / pow(2 * 6371.01 * asin(sqrt(pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lng - b.lng) / 2), 2))), 2) AS w FROM places a, places b WHERE a.location_id <> b.location_id), z AS (SELECT o, sum(w) AS s FROM q GROUP BY o) SELECT o AS origin, d AS destination, round(t * (w / s), 6) AS flow FROM q JOIN z USING (o)",
    "gravity_global": "WITH q AS (SELECT a.location_id AS o, b.location_id AS d, a.relevance * b.relevance / pow(2 * 6371.01 * asin(sqrt(pow(sin(radians(a.lat - b.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lng - b.lng) / 2), 2))), 2) AS w FROM places a, places b WHERE a.location_id <> b.location_id) SELECT o AS origin, d AS destination, round((SELECT sum(tot_outflow) FROM places) * (w / (SELECT sum(w) FROM q)), 6) AS flow FROM q",
    "radiation": f"WITH q AS (SELECT a.location_id AS o, b.location_id AS d, a.tot_outflow AS t, a.relevance AS m, b.relevance AS n, {km('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS r FROM places a, places b WHERE a.location_id <> b.location_id), s AS (SELECT x.*, coalesce((SELECT sum(y.n) FROM q y WHERE y.o = x.o AND (round(y.r, 9), y.d) < (round(x.r, 9), x.d)), 0) AS s FROM q x) SELECT o AS origin, d AS destination, round(t / (1 - m / (SELECT sum(relevance) FROM places)) * (m * n) / ((m + s) * (m + n + s)), 6) AS flow FROM s",
    "common_part_of_commuters": f"WITH {_FLOW} SELECT round(2 * sum(CASE WHEN x < y THEN x ELSE y END) / sum(x + y), 6) AS cpc FROM f",
    "common_part_of_links": f"WITH {_FLOW} SELECT round(2.0 * count(*) FILTER (x > 0 AND y > 0) / (count(*) FILTER (x > 0) + count(*) FILTER (y > 0)), 6) AS cpl FROM f",
    "compare_flow_models": f"WITH {_FLOW}, r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM f) SELECT round(2 * sum(least(x, y)) / sum(x + y), 6) AS cpc, round(1 - sum((x - y) ** 2) / (var_pop(x) * count(*)), 6) AS r_squared, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS spearman, round(sqrt(sum((x - y) ** 2) / count(*)), 5) AS rmse FROM r",
    "regression_metrics": f"WITH {_FLOW}, p AS (SELECT x, y FROM f WHERE x > 0 AND y > 0), t AS (SELECT list_sum(list(x)) AS sx, list_sum(list(y)) AS sy FROM p) SELECT round(1 - sum((x - y) ** 2) / (var_pop(x) * count(*)), 6) AS r_squared, round(sum((x - y) ** 2) / count(*), 4) AS mse, round(sqrt(sum((x - y) ** 2) / count(*)), 5) AS rmse, round(sqrt(sum((x - y) ** 2) / count(*)) / any_value(sx), 9) AS nrmse, round(max(x - y), 6) AS max_error, round(sum(x * (ln(x) - ln(y))) / any_value(sx), 6) AS information_gain, round(sum(x * (ln(x) - ln(y))) / any_value(sx) + ln(any_value(sy) / any_value(sx)), 6) AS kl_divergence FROM p, t",
    "jensen_shannon": f"WITH {_FLOW}, d AS (SELECT x / (SELECT sum(x) FROM f) AS p, y / (SELECT sum(y) FROM f) AS q FROM f), e AS (SELECT p, q, (p + q) / 2 AS m FROM d) SELECT round(sum(CASE WHEN m > 0 THEN -m * ln(m) ELSE 0 END) - sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / 2 - sum(CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) / 2, 6) AS jsd FROM e",
    "wasserstein": "WITH v AS (SELECT DISTINCT flow AS x FROM (SELECT flow FROM observed UNION ALL SELECT flow FROM predicted) u), s AS (SELECT x, lead(x) OVER (ORDER BY x) AS nxt FROM v) SELECT round(sum((nxt - x) * abs((SELECT count(*) FROM observed WHERE flow <= x) / (SELECT count(*) FROM observed) - (SELECT count(*) FROM predicted WHERE flow <= x) / (SELECT count(*) FROM predicted))), 6) AS wasserstein FROM s WHERE nxt IS NOT NULL",
    "common_part_of_distance": f"WITH {_J}, n2 AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, event_id) AS k FROM other_fixes), j2 AS (SELECT {km('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS km FROM n2 a JOIN n2 b ON a.uid = b.uid AND b.k = a.k + 1), x AS (SELECT histogram(floor(km / 2)::BIGINT) AS h FROM j), y AS (SELECT histogram(floor(km / 2)::BIGINT) AS h FROM j2) SELECT round(list_sum(list_transform(map_keys(x.h), lambda b: least(x.h[b], coalesce(y.h[b], 0))))::DOUBLE / list_sum(map_values(x.h)), 6) AS cpc_distance FROM x, y",
    "distribution_summary": "SELECT count(*) AS n, round(sum(flow) / count(*), 6) AS mean, round(quantile_cont(flow, 0.5), 6) AS median, round(sqrt(var_pop(flow)), 6) AS std FROM flows",
    "bounding_box": "SELECT list_min(list(lat)) AS min_lat, list_min(list(lng)) AS min_lng, list_max(list(lat)) AS max_lat, list_max(list(lng)) AS max_lng FROM fixes",
    "filter_greedy": f"WITH {_J} SELECT uid, event_id FROM n WHERE k = 1 UNION ALL SELECT uid, event_id FROM j WHERE us > 0 AND km / (us / 3.6e9) <= 0.05",
    "segment_observation_gap": _segments("us > 36000000000"),
    "segment_value_change": _segments("aplace <> place"),
    "segment_temporal": _segments("before::DATE <> datetime::DATE"),
    "trajectory_to_od": f"WITH {_J} SELECT aplace AS origin, place AS destination, count(*) AS flow FROM j WHERE aplace <> place GROUP BY ALL",
    "trajectory_to_trips": f"WITH {_J} SELECT uid, event_id AS trip_id, aplace AS origin, place AS destination, us / 6e7 AS minutes FROM j WHERE aplace <> place",
    "interpolate_linear": f"WITH {_J} SELECT uid, event_id, round(alat + (lat - alat) * 3.6e9 / us, 6) AS lat, round(alng + (lng - alng) * 3.6e9 / us, 6) AS lng FROM j WHERE us > 3600000000",
    "join_with_pois": f"WITH {_near(_KM)} SELECT lat, lng, x.id AS poi_id, round(x.d, 6) AS dist_poi FROM m",
    "join_with_pois_by_category": f"WITH {_near(_KM, 'category')} SELECT lat, lng, category, x.id AS poi_id, round(x.d, 6) AS dist_poi FROM m",
    "mapping_points": f"WITH {_near('((c.lat - p.lat) ** 2 + (c.lng - p.lng) ** 2)')} SELECT lat, lng, x.id AS tile_id FROM m",
    "snap_locations": f"WITH {_near(_KM)} SELECT lat, lng, CASE WHEN x.d <= 0.75 THEN x.id ELSE -1 END AS node FROM m",
    "join_with_events": f"WITH q AS (SELECT a.event_id, arg_min((b.event_id, {km('a.lat', 'a.lng', 'b.lat', 'b.lng')}), (round({km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 9), b.datetime, b.event_id)) AS x FROM fixes a JOIN fixes b ON b.datetime BETWEEN a.datetime - INTERVAL 900 SECOND AND a.datetime + INTERVAL 900 SECOND AND a.uid <> b.uid GROUP BY a.event_id) SELECT event_id, x[1] AS other_id, round(x[2], 6) AS dist_event FROM q",
    "validate_locations": "SELECT uid, location_id FROM visits WHERE location_id NOT IN (SELECT location_id FROM catalogue)",
    "validate_user_locations": "SELECT uid, location_id FROM visits WHERE (uid, location_id) NOT IN (SELECT (uid, location_id) FROM own_places)",
    "temporal_contacts": "WITH x AS (SELECT a.uid AS u, b.uid AS v, greatest(a.started_at, b.started_at) AS s, least(a.finished_at, b.finished_at) AS e FROM visits a JOIN visits b ON a.location_id = b.location_id AND a.uid < b.uid AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at), d AS (SELECT u, v, s, e, unnest(range(s::DATE, e::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE s <= e) SELECT DISTINCT datediff('day', DATE '1970-01-01', day) AS day, u, v FROM d WHERE epoch_us(least(e, day + INTERVAL 1 DAY)) - epoch_us(greatest(s, day::TIMESTAMP)) >= 300000000",
    "graph_from_edges": "SELECT DISTINCT CASE WHEN origin < destination THEN origin ELSE destination END AS u, CASE WHEN origin < destination THEN destination ELSE origin END AS v FROM flows WHERE origin <> destination AND origin BETWEEN 0 AND 19 AND destination BETWEEN 0 AND 19",
    "sort_by_uid_and_datetime": "SELECT a.uid, a.event_id, (SELECT count(*) FROM fixes b WHERE b.uid = a.uid AND (b.datetime, b.event_id) <= (a.datetime, a.event_id)) AS position FROM fixes a",
    "flow_matrix": "SELECT o.origin, d.destination, coalesce(sum(f.flow), 0.0) AS flow FROM (SELECT DISTINCT origin FROM flows) o CROSS JOIN (SELECT DISTINCT destination FROM flows) d LEFT JOIN flows f ON f.origin = o.origin AND f.destination = d.destination GROUP BY ALL",
    "unique_location_risk": "WITH s AS (SELECT uid, list_sort(list_distinct(list(location_id::VARCHAR))) AS l FROM visits GROUP BY uid), k AS (SELECT uid, CASE WHEN len(l) = 1 THEN [[l[1], l[1]]] ELSE flatten(list_transform(range(1, len(l)), lambda i: list_transform(range(i + 1, len(l) + 1), lambda j: [l[i], l[j]]))) END AS c FROM s), c AS (SELECT uid, unnest(c) AS p FROM k), d AS (SELECT DISTINCT p FROM c), n AS (SELECT p, (SELECT count(*) FROM s WHERE list_has_all(s.l, d.p)) AS users FROM d) SELECT uid, round(1.0 / min(users), 6) AS risk FROM c JOIN n USING (p) GROUP BY uid",
    "modal_split_per_user": "WITH m AS (SELECT uid, CASE WHEN v <= 15 THEN 'slow_mobility' WHEN v <= 100 THEN 'motorized_mobility' ELSE 'fast_mobility' END AS mode FROM (SELECT uid, CASE WHEN finished_at > started_at THEN length_km * 3.6e9 / (epoch_us(finished_at) - epoch_us(started_at)) ELSE 0 END AS v FROM triplegs) q), t AS (SELECT uid, count(*) AS s FROM m GROUP BY uid) SELECT uid, mode, count(*) AS n, round(count(*) / any_value(s), 6) AS share FROM m JOIN t USING (uid) GROUP BY uid, mode",
    "global_locations": "SELECT floor(lat / 0.013)::BIGINT AS cell_lat, floor(lng / 0.013)::BIGINT AS cell_lng, round((floor(lat / 0.013) + 0.5) * 0.013, 6) AS lat, round((floor(lng / 0.013) + 0.5) * 0.013, 6) AS lng, count(*) AS n, len(list_distinct(list(uid))) AS users FROM fixes GROUP BY floor(lat / 0.013), floor(lng / 0.013)",
    "voronoi_tessellation": "SELECT id, (SELECT count(*) FROM pois b WHERE b.id < a.id) AS tile_id, lat, lng FROM pois a",
    "cdr_trips": f"WITH RECURSIVE {_N}, r AS (SELECT *, 1 AS visit FROM n WHERE k = 1 UNION ALL SELECT n.*, r.visit + (n.place <> r.place)::INT FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1), s AS (SELECT uid, visit, any_value(place) AS place, min(datetime) AS a, max(datetime) AS b, quantile_cont(lat, 0.5) AS lat, quantile_cont(lng, 0.5) AS lng FROM r GROUP BY uid, visit), t AS (SELECT x.*, y.place AS q, y.a AS nxt, y.lat AS qlat, y.lng AS qlng, {km('x.lat', 'x.lng', 'y.lat', 'y.lng')} AS km, (epoch_us(y.a) - epoch_us(x.b)) / 6e7 AS gap FROM s x JOIN s y ON y.uid = x.uid AND y.visit = x.visit + 1), m AS (SELECT *, least(gap, km * 1.2 / 50 * 60) AS minutes FROM t) SELECT uid, visit AS trip_number, place AS origin, q AS destination, round(lat, 6) AS origin_lat, round(lng, 6) AS origin_lng, round(qlat, 6) AS destination_lat, round(qlng, 6) AS destination_lng, round(km, 6) AS straight_km, round(km * 1.2, 6) AS km, nxt - to_microseconds(round(minutes * 6e7)::BIGINT) AS departs_at, nxt AS arrives_at, round(minutes, 4) AS minutes, round(gap, 4) AS gap_minutes, round(CASE WHEN minutes > 0 THEN km * 1.2 / (minutes / 60) END, 4) AS speed_kmh FROM m",
    "next_place_counts": f"WITH {_W}, x AS (SELECT uid, k, list(location_id) OVER (PARTITION BY uid ORDER BY k) AS l FROM w), y AS (SELECT uid, l[-1] AS next_id, l[:-2] AS past, unnest(range(0, least(len(l) - 1, 2) + 1)) AS m FROM x) SELECT uid, array_to_string(CASE WHEN m = 0 THEN [] ELSE past[-m:] END, ',') AS context, next_id, count(*) AS n FROM y GROUP BY ALL",
    "next_place_proba": f"WITH {_W}, x AS (SELECT uid, list(location_id) OVER (PARTITION BY uid ORDER BY k) AS l FROM w), y AS (SELECT uid, l[-1] AS z, l[:-2] AS past, unnest(range(0, least(len(l) - 1, 2) + 1)) AS m FROM x), c AS (SELECT uid, m, CASE WHEN m = 0 THEN '' ELSE array_to_string(past[-m:], ',') END AS ctx, z, count(*) AS n FROM y GROUP BY ALL), e AS (SELECT uid, list(location_id ORDER BY k) AS l FROM w GROUP BY uid), a AS (SELECT uid, unnest(range(0, least(len(l), 2) + 1)) AS m, l FROM e), t AS (SELECT a.uid, a.m, c.z, c.n FROM a JOIN c ON a.uid = c.uid AND a.m = c.m AND c.ctx = CASE WHEN a.m = 0 THEN '' ELSE array_to_string(a.l[-a.m:], ',') END), b AS (SELECT * FROM t WHERE m = (SELECT max(m) FROM t q WHERE q.uid = t.uid)) SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY n DESC, z) AS rank, z AS next_id, m AS context_length, round(n / sum(n) OVER (PARTITION BY uid), 6) AS probability FROM b QUALIFY rank <= 3",
    "next_place_evaluation": f"WITH {_W}, g AS (SELECT uid, max(k) AS top FROM w GROUP BY uid HAVING max(k) > 2), x AS (SELECT uid, k, location_id AS z, list(location_id) OVER (PARTITION BY uid ORDER BY k) AS l FROM w), y AS (SELECT uid, k, z, m, CASE WHEN m = 0 THEN '' ELSE array_to_string((l[:-2])[-m:], ',') END AS ctx FROM (SELECT *, unnest(range(0, least(len(l) - 1, 2) + 1)) AS m FROM x) u), a AS (SELECT y.* FROM y JOIN g ON y.uid = g.uid AND y.k > g.top - 2), t AS (SELECT a.uid, a.k, a.z AS truth, a.m, y.z, count(*) AS n FROM a JOIN y ON a.uid = y.uid AND a.m = y.m AND a.ctx = y.ctx AND y.k < a.k GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY uid, k ORDER BY n DESC, z) AS r FROM t WHERE m = (SELECT max(q.m) FROM t q WHERE q.uid = t.uid AND q.k = t.k)) SELECT round((SELECT count(*) FROM b WHERE r <= 3 AND z = truth) / count(*), 6) AS accuracy, count(*) AS steps, count(DISTINCT uid) AS users FROM (SELECT DISTINCT uid, k FROM a) d",
    "locations_from_tessellation": "SELECT id AS location_id, lat, lng FROM pois",
    "locations_faults": "SELECT count(*) FILTER (location_id IS NULL) AS null_ids, count(*) - count(DISTINCT location_id) AS repeated_ids, count(*) FILTER (lat IS NULL OR abs(lat) > 90) AS bad_centres FROM catalogue",
    "associate_locations": f"WITH d AS (SELECT f.event_id, arg_min((c.location_id, {km('f.lat', 'f.lng', 'c.lat', 'c.lng')}), (round({km('f.lat', 'f.lng', 'c.lat', 'c.lng')}, 9), c.location_id)) AS x FROM other_fixes f CROSS JOIN catalogue c GROUP BY f.event_id) SELECT event_id, CASE WHEN x[2] <= 0.6 THEN x[1] END AS location_id FROM d",
    "interpolate_at_nearest": "WITH s AS (SELECT uid, min(datetime) AS a, max(datetime) AS b FROM fixes GROUP BY uid), g AS (SELECT s.uid, i.\"at\" AS t, i.\"at\" BETWEEN a AND b AS ok FROM s CROSS JOIN instants i), m AS (SELECT g.uid, g.t, g.ok, arg_min((f.lat, f.lng), (abs(epoch_us(f.datetime) - epoch_us(g.t)), f.datetime, -f.event_id)) AS x FROM g JOIN fixes f USING (uid) GROUP BY ALL) SELECT uid, t AS \"at\", ok AS valid, CASE WHEN ok THEN x[1] END AS lat, CASE WHEN ok THEN x[2] END AS lng FROM m",
    "mapping_polygons": "SELECT lat, lng, min(tile_id) AS tile_id FROM (SELECT DISTINCT f.lat, f.lng, c.location_id AS tile_id FROM other_fixes f JOIN catalogue c ON f.lat >= c.lat - 0.005 AND f.lat < c.lat + 0.005 AND f.lng >= c.lng - 0.005 AND f.lng < c.lng + 0.005) q GROUP BY lat, lng",
    "filter_hampel": f"WITH {_J}, v AS (SELECT n.uid, n.datetime, n.event_id, n.lat, n.lng, n.k, coalesce(CASE WHEN us > 0 THEN km / (us / 3.6e9) END, 0) AS v FROM n LEFT JOIN j USING (uid, event_id)), w AS (SELECT a.uid, a.datetime, a.event_id, a.lat, a.lng, a.v, list(b.v) AS l FROM v a JOIN v b ON a.uid = b.uid AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY ALL), m AS (SELECT *, list_median(l) AS m, list_median(list_transform(l, lambda x: abs(x - list_median(l)))) AS s FROM w) SELECT uid, datetime, event_id, lat, lng FROM m WHERE len(l) < 5 OR abs(v - m) <= 3 * 1.4826 * s",
    "segment_speed": f"WITH RECURSIVE {_J}, v AS (SELECT n.uid, n.event_id, n.datetime, n.k, n.k > 1 AND coalesce(CASE WHEN us > 0 THEN km / (us / 3.6e9) END, 0) < 0.05 AS still FROM n LEFT JOIN j USING (uid, event_id)), r AS (SELECT *, 0 AS run FROM v WHERE k = 1 UNION ALL SELECT v.*, r.run + (v.still <> r.still)::INT FROM r JOIN v ON v.uid = r.uid AND v.k = r.k + 1), g AS (SELECT uid, run, any_value(still) AND max(epoch_us(datetime)) - min(epoch_us(datetime)) >= 300000000 AS long FROM r GROUP BY uid, run) SELECT r.uid, r.event_id, (SELECT count(*) FROM g a WHERE a.uid = r.uid AND a.run <= r.run AND a.run > 0 AND (a.long OR EXISTS (SELECT 1 FROM g b WHERE b.uid = a.uid AND b.run = a.run - 1 AND b.long))) AS segment_id FROM r",
    "diversity": f"WITH {_W}, l AS (SELECT uid, list(location_id ORDER BY k) AS s FROM w GROUP BY uid), p AS (SELECT uid, len(s) AS n, s, unnest(range(1, len(s) + 1)) AS i FROM l), q AS (SELECT uid, n, i, s, unnest(range(i, n + 1)) AS j FROM p) SELECT uid, round(CASE WHEN any_value(n) > 1 THEN count(DISTINCT array_to_string(s[i:j], ',')) / (any_value(n) * (any_value(n) + 1) / 2) ELSE 0 END, 9) AS diversity FROM q GROUP BY uid",
    "trajectory_distance_hausdorff": f"WITH p AS (SELECT DISTINCT a.uid AS a, b.uid AS b FROM fixes a JOIN fixes b ON b.uid = a.uid + 1), d AS (SELECT p.a, p.b, x.event_id AS i, y.event_id AS j, {km('x.lat', 'x.lng', 'y.lat', 'y.lng')} AS d FROM p JOIN fixes x ON x.uid = p.a JOIN fixes y ON y.uid = p.b), u AS (SELECT a, b, i, min(d) AS m FROM d GROUP BY ALL), v AS (SELECT a, b, j, min(d) AS m FROM d GROUP BY ALL) SELECT a, b, greatest((SELECT max(m) FROM u WHERE u.a = p.a AND u.b = p.b), (SELECT max(m) FROM v WHERE v.a = p.a AND v.b = p.b)) AS distance FROM p",
    "compress": f"WITH RECURSIVE {_N}, r AS (SELECT uid, event_id, k, lat AS y, lng AS x, 0 AS g FROM n WHERE k = 1 UNION ALL SELECT n.uid, n.event_id, n.k, CASE WHEN far THEN n.lat ELSE r.y END, CASE WHEN far THEN n.lng ELSE r.x END, r.g + far::INT FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1, LATERAL (SELECT {km('r.y', 'r.x', 'n.lat', 'n.lng')} > 1.0 AS far) q) SELECT r.uid, min(f.datetime) AS datetime, quantile_cont(f.lat, 0.5) AS lat, quantile_cont(f.lng, 0.5) AS lng FROM r JOIN fixes f USING (uid, event_id) GROUP BY r.uid, r.g",
    "segment_angle_change": f"WITH RECURSIVE {_J}, b AS (SELECT *, degrees(atan2(sin(radians(lng - alng)) * cos(radians(lat)), cos(radians(alat)) * sin(radians(lat)) - sin(radians(alat)) * cos(radians(lat)) * cos(radians(lng - alng)))) AS turn FROM j), r AS (SELECT n.uid, n.event_id, n.k, b.turn AS first, 0 AS s FROM n LEFT JOIN b ON b.uid = n.uid AND b.k = 2 WHERE n.k = 1 UNION ALL SELECT b.uid, b.event_id, b.k, CASE WHEN off >= 45 THEN b.turn ELSE r.first END, r.s + (off >= 45)::INT FROM r JOIN b ON b.uid = r.uid AND b.k = r.k + 1, LATERAL (SELECT least(abs(b.turn - r.first), 360 - abs(b.turn - r.first)) AS off) q) SELECT uid, event_id, s::BIGINT AS segment_id FROM r",
    "mean_clustering": "WITH x AS (SELECT a.uid AS u, b.uid AS v, greatest(a.started_at, b.started_at) AS s, least(a.finished_at, b.finished_at) AS e FROM visits a JOIN visits b ON a.location_id = b.location_id AND a.uid <> b.uid AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at), d AS (SELECT u, v, s, e, unnest(range(s::DATE, e::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE s <= e), g AS (SELECT DISTINCT u, v FROM d WHERE epoch_us(least(e, day + INTERVAL 1 DAY)) - epoch_us(greatest(s, day::TIMESTAMP)) >= 300000000), l AS (SELECT u, list(v) AS n FROM g GROUP BY u), t AS (SELECT l.u, len(l.n) AS k, sum(len(list_intersect(l.n, m.n))) AS c FROM l JOIN g ON g.u = l.u JOIN l m ON m.u = g.v GROUP BY l.u, l.n) SELECT round(avg(CASE WHEN k > 1 THEN c / (k * (k - 1)) ELSE 0 END), 6) AS clustering FROM t",
    "origin_indicators": "SELECT origin, destination, (SELECT count(DISTINCT f.origin) FROM flows f WHERE f.origin < flows.origin)::INT AS \"at\" FROM flows",
    "daily_activity_distribution": "WITH v AS (SELECT ifnull(purpose, 'UNKNOWN') AS purpose, (date_part('hour', started_at) * 60 + date_part('minute', started_at)) // 10 AS a, (date_part('hour', finished_at) * 60 + date_part('minute', finished_at)) // 10 AS b, finished_at::TIME < started_at::TIME AND date_trunc('minute', finished_at)::TIME < date_trunc('minute', started_at)::TIME AS wraps FROM visits), c AS (SELECT x.bin, purpose, count(*) AS n FROM v JOIN (SELECT unnest(range(0, 144)) AS bin) x ON CASE WHEN wraps THEN x.bin >= a OR x.bin <= b ELSE x.bin BETWEEN a AND b END GROUP BY ALL) SELECT bin, purpose, round(n / (SELECT sum(n) FROM c d WHERE d.bin = c.bin), 6) AS share FROM c",
    "identify_locations": "WITH d AS (SELECT uid, location_id, sum(CASE WHEN date_part('hour', started_at) NOT BETWEEN 6 AND 21 THEN epoch_us(finished_at) - epoch_us(started_at) ELSE 0 END) AS night, sum(CASE WHEN isodow(started_at) < 6 AND date_part('hour', started_at) BETWEEN 8 AND 17 THEN epoch_us(finished_at) - epoch_us(started_at) ELSE 0 END) AS work FROM visits GROUP BY ALL), h AS (SELECT uid, arg_min(location_id, (-night, location_id)) AS home FROM d WHERE night > 0 GROUP BY uid), w AS (SELECT d.uid, arg_min(location_id, (-work, location_id)) AS job FROM d LEFT JOIN h USING (uid) WHERE work > 0 AND location_id IS DISTINCT FROM home GROUP BY d.uid) SELECT d.uid, d.location_id, CASE WHEN d.location_id = home THEN 'home' WHEN d.location_id = job THEN 'work' ELSE 'other' END AS purpose FROM d LEFT JOIN h USING (uid) LEFT JOIN w USING (uid)",
    "locations_identify": "WITH d AS (SELECT uid, location_id, sum(CASE WHEN date_part('hour', started_at) NOT BETWEEN 6 AND 21 THEN epoch_us(finished_at) - epoch_us(started_at) ELSE 0 END) AS night, sum(CASE WHEN isodow(started_at) < 6 AND date_part('hour', started_at) BETWEEN 8 AND 17 THEN epoch_us(finished_at) - epoch_us(started_at) ELSE 0 END) AS work FROM visits GROUP BY ALL), h AS (SELECT uid, arg_min(location_id, (-night, location_id)) AS home FROM d WHERE night > 0 GROUP BY uid), w AS (SELECT d.uid, arg_min(location_id, (-work, location_id)) AS job FROM d LEFT JOIN h USING (uid) WHERE work > 0 AND location_id IS DISTINCT FROM home GROUP BY d.uid) SELECT d.uid, d.location_id, CASE WHEN d.location_id = home THEN 'home' WHEN d.location_id = job THEN 'work' ELSE 'other' END AS purpose FROM d LEFT JOIN h USING (uid) LEFT JOIN w USING (uid) WHERE d.location_id IN (SELECT location_id FROM catalogue)",
    "next_location": f"WITH {_W}, {_P}, l AS (SELECT uid, arg_max(location_id, (started_at, location_id)) AS last FROM visits GROUP BY uid), a AS (SELECT p.uid, d, count(*) AS n FROM p JOIN l ON l.uid = p.uid AND l.last = p.o GROUP BY ALL), b AS (SELECT uid, location_id AS d, count(*) AS n FROM visits GROUP BY ALL) SELECT uid, coalesce((SELECT arg_min(a.d, (-a.n, a.d)) FROM a WHERE a.uid = l.uid), (SELECT arg_min(b.d, (-b.n, b.d)) FROM b WHERE b.uid = l.uid)) AS next_id FROM l",
    "next_location_evaluation": f"WITH {_W}, m AS (SELECT uid, max(k) AS m FROM w GROUP BY uid HAVING max(k) > 1), t AS (SELECT w.uid, w.location_id AS truth, q.location_id AS prev FROM m JOIN w ON w.uid = m.uid AND w.k = m.m JOIN w q ON q.uid = m.uid AND q.k = m.m - 1), c AS (SELECT a.uid, a.location_id AS o, b.location_id AS d, count(*) AS n FROM w a JOIN w b ON a.uid = b.uid AND b.k = a.k + 1 JOIN m ON m.uid = a.uid WHERE b.k < m.m GROUP BY ALL) SELECT round(avg(coalesce((SELECT arg_min(c.d, (-c.n, c.d)) FROM c WHERE c.uid = t.uid AND c.o = t.prev) = truth, false)::INT), 6) AS accuracy, count(*) AS users FROM t",
    "mean_area_volume": "WITH e AS (SELECT uid, location_id AS area, unnest(range(epoch_us(started_at) // 600000000, epoch_us(finished_at) // 600000000 + 1)) AS s FROM visits), g AS (SELECT area, s // 144 AS day, s % 144 AS slot, count(DISTINCT uid) AS n FROM e GROUP BY ALL), w AS (SELECT area, slot, dayofweek(DATE '1970-01-01' + day::INT) AS wd, avg(n) AS m FROM g GROUP BY ALL) SELECT area, slot, round(sum(m) / 7, 6) AS mean_volume FROM w GROUP BY ALL",
    "stvd": "WITH e AS (SELECT uid, location_id AS area, unnest(range(epoch_us(started_at) // 600000000, epoch_us(finished_at) // 600000000 + 1)) AS s FROM visits), g AS (SELECT area, s // 144 AS day, s % 144 AS slot, count(DISTINCT uid) AS n FROM e GROUP BY ALL), w AS (SELECT area, slot, dayofweek(DATE '1970-01-01' + day::INT) AS wd, avg(n) AS m FROM g GROUP BY ALL), v AS (SELECT area, slot, sum(m) AS m FROM w GROUP BY ALL) SELECT area, slot, any_value(p.lat) AS lat, any_value(p.lng) AS lng, round(any_value(m) / 7, 6) AS mean_volume FROM v JOIN places p ON p.location_id = v.area GROUP BY area, slot",
    "visitation_law": f"WITH {_NIGHT}, a AS (SELECT f.uid, lat, lng, floor({km('x.lat', 'x.lng', 'lat', 'lng')}) + 0.5 AS r, count(DISTINCT datetime::DATE) AS n FROM fixes f JOIN h USING (uid) GROUP BY ALL), g AS (SELECT r * n AS rf, count(*) / (2 * pi() * r) AS rho FROM a GROUP BY lat, lng, r, n), b AS (SELECT min(ln(rf)) AS lo, (max(ln(rf)) - min(ln(rf))) / 30 AS w FROM g), c AS (SELECT least(floor((ln(rf) - lo) / w), 29) AS bin, rho, lo, w FROM g, b), d AS (SELECT any_value(lo) + (bin + 0.5) * any_value(w) AS x, ln(avg(rho)) AS y FROM c GROUP BY bin) SELECT round(-covar_pop(x, y) / var_pop(x), 5) AS eta, round(exp(avg(y) - covar_pop(x, y) / var_pop(x) * avg(x)), 5) AS mu, round(corr(x, y) ** 2, 5) AS r2, count(*) AS n_bins FROM d",
    "filter_zheng": f"WITH RECURSIVE {_J}, o AS (SELECT n.uid, n.event_id, n.k, n.k = 1 OR (j.us > 0 AND j.km / (j.us / 3.6e9) <= 0.05) AS ok FROM n LEFT JOIN j USING (uid, event_id)), r AS (SELECT *, 0 AS run FROM o WHERE k = 1 UNION ALL SELECT o.*, r.run + (NOT o.ok)::INT FROM r JOIN o ON o.uid = r.uid AND o.k = r.k + 1) SELECT uid, event_id FROM r WHERE (uid, run) IN (SELECT (uid, run) FROM r GROUP BY uid, run HAVING count(*) > 1)",
    "predict_transport_mode": "SELECT uid, tripleg_id, CASE WHEN finished_at <= started_at OR length_km * 3.6e9 <= 15 * (epoch_us(finished_at) - epoch_us(started_at)) THEN 'slow_mobility' WHEN length_km * 3.6e9 <= 100 * (epoch_us(finished_at) - epoch_us(started_at)) THEN 'motorized_mobility' ELSE 'fast_mobility' END AS mode FROM triplegs",
    "staypoints_validate": "SELECT count(*) AS n, count(*) FILTER (started_at IS NULL OR finished_at IS NULL) AS without_interval, count(*) FILTER (finished_at < started_at) AS reversed FROM staypoints",
    "to_flowdataframe": f"WITH {_N} SELECT floor((a.lat + 90) / 0.013)::BIGINT AS origin_row, floor((a.lng + 180) / 0.013)::BIGINT AS origin_column, floor((b.lat + 90) / 0.013)::BIGINT AS destination_row, floor((b.lng + 180) / 0.013)::BIGINT AS destination_column, count(*) AS flow FROM n a JOIN n b ON a.uid = b.uid AND b.k = a.k + 1 GROUP BY ALL",
    "interpolate_at": "WITH s AS (SELECT uid, min(datetime) AS a, max(datetime) AS b FROM fixes GROUP BY uid), g AS (SELECT s.uid, i.\"at\" AS t, i.\"at\" BETWEEN a AND b AS ok FROM s CROSS JOIN instants i), p AS (SELECT g.uid, g.t, any_value(ok) AS ok, arg_max((datetime, lat, lng), (datetime, event_id)) FILTER (datetime <= t) AS x, arg_min((datetime, lat, lng), (datetime, event_id)) FILTER (datetime >= t) AS y FROM g JOIN fixes USING (uid) GROUP BY g.uid, g.t), q AS (SELECT *, CASE WHEN y[1] > x[1] THEN (epoch_us(t) - epoch_us(x[1])) / (epoch_us(y[1]) - epoch_us(x[1])) ELSE 0 END AS f FROM p) SELECT uid, t AS \"at\", ok AS valid, CASE WHEN ok THEN round(x[2] + (y[2] - x[2]) * f, 6) END AS lat, CASE WHEN ok THEN round(x[3] + (y[3] - x[3]) * f, 6) END AS lng FROM q",
    "distribution_quantiles": "WITH l AS (SELECT list_sort(list(flow)) AS l FROM flows), q AS (SELECT l, unnest([0.1, 0.9]) AS p FROM l), r AS (SELECT p, p * (len(l) - 1) AS x, l FROM q), v AS (SELECT p, l[floor(x)::INT + 1] + (x - floor(x)) * (l[ceil(x)::INT + 1] - l[floor(x)::INT + 1]) AS v FROM r) SELECT round(max(v) FILTER (p = 0.1), 6) AS p10, round(max(v) FILTER (p = 0.9), 6) AS p90 FROM v",
    "home_work_risk": "WITH c AS (SELECT uid, location_id, count(*) AS n FROM visits GROUP BY ALL), l AS (SELECT uid, list_sort(list(location_id ORDER BY n, location_id)[1:2]) AS k FROM c GROUP BY uid) SELECT uid, round(1.0 / (SELECT count(*) FROM l m WHERE (m.k[1], m.k[-1]) = (l.k[1], l.k[-1])), 6) AS risk FROM l",
    "assess_risk_instances": "WITH d AS (SELECT DISTINCT uid, location_id FROM visits) SELECT uid, location_id::VARCHAR AS known, (SELECT count(*) FROM d e WHERE e.location_id = d.location_id) AS users, round(1 / (SELECT count(*) FROM d e WHERE e.location_id = d.location_id), 6) AS risk FROM d",
    "assess_risk_three": "WITH s AS (SELECT uid, list_sort(list_distinct(list(location_id::VARCHAR))) AS l FROM visits GROUP BY uid), k AS (SELECT a.uid, [a.x, b.x, c.x] AS p FROM (SELECT uid, unnest(l) AS x FROM s WHERE len(l) > 2) a JOIN (SELECT uid, unnest(l) AS x FROM s) b ON a.uid = b.uid AND a.x < b.x JOIN (SELECT uid, unnest(l) AS x FROM s) c ON a.uid = c.uid AND b.x < c.x UNION ALL SELECT uid, l FROM s WHERE len(l) < 3), d AS (SELECT DISTINCT p FROM k), n AS (SELECT p, (SELECT count(*) FROM s WHERE list_has_all(s.l, d.p)) AS users FROM d) SELECT uid, round(1.0 / min(users), 6) AS risk FROM k JOIN n USING (p) GROUP BY uid",
    "clustering_coefficients": "WITH x AS (SELECT a.uid AS u, b.uid AS v, greatest(a.started_at, b.started_at) AS s, least(a.finished_at, b.finished_at) AS e FROM visits a JOIN visits b ON a.location_id = b.location_id AND a.uid <> b.uid AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at), d AS (SELECT u, v, s, e, unnest(range(s::DATE, e::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE s <= e), g AS (SELECT DISTINCT u, v FROM d WHERE epoch_us(least(e, day + INTERVAL 1 DAY)) - epoch_us(greatest(s, day::TIMESTAMP)) >= 300000000), l AS (SELECT u, list(v) AS n FROM g GROUP BY u), t AS (SELECT l.u, len(l.n) AS k, sum(len(list_intersect(l.n, m.n))) AS c FROM l JOIN g ON g.u = l.u JOIN l m ON m.u = g.v GROUP BY l.u, l.n) SELECT u AS uid, round(CASE WHEN k > 1 THEN c / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM t",
    "topological_overlap": "WITH x AS (SELECT a.uid AS u, b.uid AS v, greatest(a.started_at, b.started_at) AS s, least(a.finished_at, b.finished_at) AS e FROM visits a JOIN visits b ON a.location_id = b.location_id AND a.uid <> b.uid AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at), d AS (SELECT u, v, s, e, unnest(range(s::DATE, e::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE s <= e), g AS (SELECT DISTINCT u, v FROM d WHERE epoch_us(least(e, day + INTERVAL 1 DAY)) - epoch_us(greatest(s, day::TIMESTAMP)) >= 300000000), l AS (SELECT u, list(v) AS n FROM g GROUP BY u) SELECT g.u, g.v, round(CASE WHEN len(a.n) + len(b.n) > len(list_intersect(a.n, b.n)) THEN len(list_intersect(a.n, b.n)) / (len(a.n) + len(b.n) - len(list_intersect(a.n, b.n))) ELSE 0 END, 6) AS overlap FROM g JOIN l a ON a.u = g.u JOIN l b ON b.u = g.v WHERE g.u < g.v",
    "contact_network": "WITH x AS (SELECT a.uid AS u, b.uid AS v, greatest(a.started_at, b.started_at) AS s, least(a.finished_at, b.finished_at) AS e FROM visits a JOIN visits b ON a.location_id = b.location_id AND a.uid < b.uid AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at), d AS (SELECT u, v, s, e, unnest(range(s::DATE, e::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM x WHERE s <= e), g AS (SELECT DISTINCT u, v, day FROM d WHERE epoch_us(least(e, day + INTERVAL 1 DAY)) - epoch_us(greatest(s, day::TIMESTAMP)) >= 300000000) SELECT u, v, round(count(*) / (SELECT datediff('day', min(day), max(day)) + 1 FROM g), 6) AS persistence FROM g GROUP BY u, v",
    "stay_locations": f"WITH RECURSIVE d AS (SELECT *, lag(datetime) OVER w AS pt, lag(lat) OVER w AS py, lag(lng) OVER w AS px FROM fixes WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)), n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, event_id) AS k FROM d WHERE pt IS NULL OR (datetime, lat, lng) <> (pt, py, px)), m AS (SELECT uid, max(k) AS m FROM n GROUP BY uid), r AS (SELECT uid, k, k AS a, lat AS y, lng AS x, false AS closed, k AS was FROM n WHERE k = 1 UNION ALL SELECT n.uid, n.k, CASE WHEN c THEN n.k ELSE r.a END, CASE WHEN c THEN n.lat ELSE r.y END, CASE WHEN c THEN n.lng ELSE r.x END, c, r.a FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1 JOIN m ON m.uid = n.uid, LATERAL (SELECT {km('r.y', 'r.x', 'n.lat', 'n.lng')} >= 0.2 OR n.k = m.m AS c) q), e AS (SELECT r.uid, r.was AS a, r.k AS b FROM r WHERE closed) SELECT e.uid, p.datetime AS started_at, q.datetime AS finished_at, quantile_cont(i.lat, 0.5) AS lat, quantile_cont(i.lng, 0.5) AS lng FROM e JOIN n p ON p.uid = e.uid AND p.k = e.a JOIN n q ON q.uid = e.uid AND q.k = e.b JOIN n i ON i.uid = e.uid AND i.k >= e.a AND i.k < e.b WHERE epoch_us(q.datetime) - epoch_us(p.datetime) >= 1200000000 GROUP BY e.uid, e.a, p.datetime, q.datetime",
    # Walks over one user's rows: recursion from fix to fix.
    "filter_speed": f"WITH RECURSIVE {_N}, r AS (SELECT uid, event_id, k, lat, lng, datetime AS t, true AS keep FROM n WHERE k = 1 UNION ALL SELECT n.uid, n.event_id, n.k, CASE WHEN ok THEN n.lat ELSE r.lat END, CASE WHEN ok THEN n.lng ELSE r.lng END, CASE WHEN ok THEN n.datetime ELSE r.t END, ok FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1, LATERAL (SELECT epoch_us(n.datetime) > epoch_us(r.t) AND {km('r.lat', 'r.lng', 'n.lat', 'n.lng')} / ((epoch_us(n.datetime) - epoch_us(r.t)) / 3.6e9) <= 0.05 AS ok) q) SELECT f.uid, f.datetime, f.event_id, f.lat, f.lng FROM r JOIN fixes f USING (uid, event_id) WHERE keep",
    "simplify_min_distance": f"WITH RECURSIVE {_N}, e AS (SELECT uid, max(k) AS m FROM n GROUP BY uid), r AS (SELECT uid, event_id, k, lat, lng, true AS keep FROM n WHERE k = 1 UNION ALL SELECT n.uid, n.event_id, n.k, CASE WHEN ok THEN n.lat ELSE r.lat END, CASE WHEN ok THEN n.lng ELSE r.lng END, ok OR n.k = e.m FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1 JOIN e ON e.uid = n.uid, LATERAL (SELECT {km('r.lat', 'r.lng', 'n.lat', 'n.lng')} >= 1.0 AS ok) q) SELECT f.uid, f.datetime, f.event_id, f.lat, f.lng FROM r JOIN fixes f USING (uid, event_id) WHERE keep",
    "simplify_min_time": f"WITH RECURSIVE {_N}, e AS (SELECT uid, max(k) AS m FROM n GROUP BY uid), r AS (SELECT uid, event_id, k, datetime AS t, true AS keep FROM n WHERE k = 1 UNION ALL SELECT n.uid, n.event_id, n.k, CASE WHEN ok THEN n.datetime ELSE r.t END, ok OR n.k = e.m FROM r JOIN n ON n.uid = r.uid AND n.k = r.k + 1 JOIN e ON e.uid = n.uid, LATERAL (SELECT epoch_us(n.datetime) - epoch_us(r.t) >= 36000000000 AS ok) q) SELECT f.uid, f.datetime, f.event_id, f.lat, f.lng FROM r JOIN fixes f USING (uid, event_id) WHERE keep",
}


def oracle(name: str) -> str:
    """The text with the views it reads before it."""
    text, need = TEXTS[name], []

    def add(view: str) -> None:
        if view in need:
            return
        for other in VIEWS:
            if other != view and re.search(rf"\b{other}\b", VIEWS[view]):
                add(other)
        need.append(view)

    for view in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN|,) {view}\b", text):
            add(view)
    views = ", ".join(f"{v} AS ({dialect(VIEWS[v], 1)})" for v in need)
    return f"WITH {views} SELECT * FROM ({text}) answer"
