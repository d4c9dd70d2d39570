"""Measures over all users, origin-destination tables, flow models and their evaluation."""

from __future__ import annotations

from ..functions.portable import SqlOperator as Op
from .individual import _HOME, _V

visits_per_location = Op("visits_per_location", "Visits of each place.", "SELECT location_id, count(*) AS n_visits FROM {visits} WHERE location_id IS NOT NULL GROUP BY location_id")
visits_per_time_unit = Op("visits_per_time_unit", "Fixes per time unit; empty units are absent.", "SELECT TRUNC('<unit>', datetime) AS time_unit, count(*) AS n_visits FROM {fixes} WHERE datetime IS NOT NULL GROUP BY TRUNC('<unit>', datetime)", unit="hour")
homes_per_location = Op("homes_per_location", "Users whose home is at each coordinate.", f"SELECT lat, lng, count(*) AS n_homes FROM ({_HOME}) h GROUP BY lat, lng", start_night=22, end_night=7)
random_location_entropy = Op("random_location_entropy", "log2 of the distinct users of each coordinate.", f"SELECT lat, lng, round(log2(count(DISTINCT uid)), 6) AS random_location_entropy FROM ({_V}) v GROUP BY lat, lng")
uncorrelated_location_entropy = Op("uncorrelated_location_entropy", "Entropy of user shares at each coordinate.", f"SELECT lat, lng, round(abs(-sum(p * log2(p))), 6) AS uncorrelated_location_entropy FROM (SELECT lat, lng, n / CAST(sum(n) OVER (PARTITION BY lat, lng) AS DOUBLE) AS p FROM (SELECT lat, lng, uid, count(*) AS n FROM ({_V}) v GROUP BY lat, lng, uid) c) s GROUP BY lat, lng")
mean_square_displacement = Op(
    "mean_square_displacement",
    "Mean squared km between each user's first fix and the last one within the given time of it.",
    f"""SELECT round(avg(pow(HAVERSINE(flat, flng, lat, lng), 2)), 6) AS mean_square_displacement FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime DESC, event_id DESC) AS r FROM (
        SELECT *, first_value(lat) OVER w AS flat, first_value(lng) OVER w AS flng, first_value(datetime) OVER w AS ft FROM ({_V}) v WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)) a
      WHERE MINUTES(ft, datetime) <= <minutes>) b WHERE r = 1""",
    minutes=60,
)
od_matrix = Op("od_matrix", "Trips between places: consecutive visits of a user.", "SELECT origin, destination, count(*) AS flow FROM (SELECT location_id AS origin, lead(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS destination FROM {visits}) p WHERE origin IS NOT NULL AND destination IS NOT NULL GROUP BY origin, destination")
trips_to_flows = Op("trips_to_flows", "The same without self loops.", "SELECT origin, destination, count(*) AS flow FROM (SELECT location_id AS origin, lead(location_id) OVER (PARTITION BY uid ORDER BY started_at, location_id) AS destination FROM {visits}) p WHERE origin IS NOT NULL AND destination IS NOT NULL AND origin <> destination GROUP BY origin, destination")
od_metrics_per_area = Op(
    "od_metrics_per_area",
    "Flow inside, into and out of each area, and their total.",
    """SELECT area, sum(inside) AS move_inside, sum(coming) AS in_coming, sum(going) AS out_going, sum(inside) + sum(coming) + sum(going) AS total FROM (
      SELECT origin AS area, CASE WHEN origin = destination THEN flow ELSE 0e0 END AS inside, 0e0 AS coming, CASE WHEN origin <> destination THEN flow ELSE 0e0 END AS going FROM {flows}
      UNION ALL SELECT destination AS area, 0e0 AS inside, flow AS coming, 0e0 AS going FROM {flows} WHERE origin <> destination) a GROUP BY area""",
)
get_flow = Op("get_flow", "Flow of one pair, 0 if absent.", "SELECT coalesce(sum(flow), 0e0) AS flow FROM {flows} WHERE origin = <origin> AND destination = <destination>")
mean_area_volume = Op(
    "mean_area_volume",
    "Distinct users per place, date and ten minutes (both ends in); mean over the dates seen of a weekday; summed over weekdays, over 7.",
    """SELECT area, slot, round(sum(m) / 7, 6) AS mean_volume FROM (SELECT area, slot, wd, avg(users) AS m FROM (
      SELECT area, day, wd, slot, count(DISTINCT uid) AS users FROM (
        SELECT uid, location_id AS area, LONG(floor(s / 144e0)) AS day, LONG(floor(s / 144e0) + 3) % 7 AS wd, s % 144 AS slot FROM (SELECT uid, location_id, LONG(floor(EPOCH_US(started_at) / 600000000e0)) AS s0, LONG(floor(EPOCH_US(finished_at) / 600000000e0)) AS s1 FROM {visits}) v SERIES(s, s0, s1)) e
      GROUP BY area, day, wd, slot) g GROUP BY area, slot, wd) h GROUP BY area, slot""",
)
interest_network = Op("interest_network", "Pairs of places that share visitors, with their number.", "SELECT a.location_id AS a, b.location_id AS b, count(*) AS shared FROM (SELECT DISTINCT uid, location_id FROM {visits}) a JOIN (SELECT DISTINCT uid, location_id FROM {visits}) b ON a.uid = b.uid AND a.location_id < b.location_id GROUP BY a.location_id, b.location_id")
daily_location_lognormal = Op("daily_location_lognormal", "Mean and population deviation of ln of distinct places per user-day.", "SELECT round(avg(ln(n)), 6) AS mu, round(stddev_pop(ln(n)), 6) AS sigma, count(*) AS user_days FROM (SELECT uid, DAY(started_at) AS d, count(DISTINCT location_id) AS n FROM {visits} GROUP BY uid, DAY(started_at)) a")
visitation_law = Op(
    "visitation_law",
    "Slope, level and R2 of ln density on ln (distance times frequency) of the visitors of a place: r is taken to the middle of a ring of width km, density is visitors over the ring's area, and its mean over a log bin of r f stands at the bin's geometric middle.",
    f"""SELECT round(-regr_slope(y, x), 5) AS eta, round(exp(regr_intercept(y, x)), 5) AS mu, round(regr_r2(y, x), 5) AS r2, count(*) AS n_bins FROM (
      SELECT ln(avg(rho)) AS y, max(lo) + (bin + 0.5e0) * max(step) AS x FROM (
        SELECT rho, lo, step, CASE WHEN step > 0 THEN least(LONG(floor((ln(rf) - lo) / step)), <n_bins> - 1) ELSE 0 END AS bin FROM (
          SELECT m.rf, m.rho, b.lo, b.step FROM (
            SELECT r * f AS rf, n / (2 * 3.141592653589793e0 * r * <width>) AS rho FROM (
              SELECT lat, lng, ring * <width> + <width> / 2 AS r, f, count(*) AS n FROM (
                SELECT v.uid, v.lat, v.lng, floor(HAVERSINE(h.lat, h.lng, v.lat, v.lng) / <width>) AS ring, count(DISTINCT DAY(v.datetime)) AS f FROM ({_V}) v JOIN ({_HOME}) h ON v.uid = h.uid GROUP BY v.uid, v.lat, v.lng, floor(HAVERSINE(h.lat, h.lng, v.lat, v.lng) / <width>)) a
              GROUP BY lat, lng, ring, f) g WHERE r * f >= <min_rf> AND r * f <= <max_rf>) m
          CROSS JOIN (SELECT ln(min(rf)) AS lo, (ln(max(rf)) - ln(min(rf))) / <n_bins> AS step FROM (
            SELECT (ring * <width> + <width> / 2) * f AS rf FROM (
              SELECT v.uid, v.lat, v.lng, floor(HAVERSINE(h.lat, h.lng, v.lat, v.lng) / <width>) AS ring, count(DISTINCT DAY(v.datetime)) AS f FROM ({_V}) v JOIN ({_HOME}) h ON v.uid = h.uid GROUP BY v.uid, v.lat, v.lng, floor(HAVERSINE(h.lat, h.lng, v.lat, v.lng) / <width>)) a2) g2 WHERE rf >= <min_rf> AND rf <= <max_rf>) b) c) d GROUP BY bin) e""",
    start_night=22, end_night=7, width="1e0", n_bins=30, min_rf="0e0", max_rf="1e300",
)
gravity_singly = Op(
    "gravity_singly",
    "Singly constrained gravity flows: outflow of the origin shared by relevance times distance to a power.",
    """SELECT origin, destination, round(out * w / sum(w) OVER (PARTITION BY origin), 6) AS flow FROM (
      SELECT a.location_id AS origin, b.location_id AS destination, a.tot_outflow AS out, pow(b.relevance, <alpha>) * pow(2 * 6371.01e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))), <beta>) AS w
      FROM {places} a JOIN {places} b ON a.location_id <> b.location_id) p""",
    alpha="1e0", beta="-2e0",
)
gravity_global = Op(
    "gravity_global",
    "Globally constrained gravity flows: the total outflow shared by both relevances and distance.",
    """WITH pair AS (
      SELECT a.location_id AS origin, b.location_id AS destination, (SELECT sum(tot_outflow) FROM {places}) AS total, pow(a.relevance, <alpha>) * pow(b.relevance, <alpha>) * pow(2 * 6371.01e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))), <beta>) AS w
      FROM {places} a JOIN {places} b ON a.location_id <> b.location_id)
      SELECT origin, destination, round(total * w / whole, 6) AS flow FROM pair CROSS JOIN (SELECT sum(w) AS whole FROM pair) s""",
    alpha="1e0", beta="-2e0",
)
radiation = Op(
    "radiation",
    "Radiation flows: s is the relevance nearer to the origin than the destination.",
    """SELECT origin, destination, round(out / (1 - m / total) * m * n / ((m + s) * (m + s + n)), 6) AS flow FROM (
      SELECT *, coalesce(sum(n) OVER (PARTITION BY origin ORDER BY d, destination ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
        SELECT a.location_id AS origin, b.location_id AS destination, a.tot_outflow AS out, a.relevance AS m, b.relevance AS n, HAVERSINE(a.lat, a.lng, b.lat, b.lng) AS d, (SELECT sum(relevance) FROM {places}) AS total FROM {places} a JOIN {places} b ON a.location_id <> b.location_id) p) q""",
)
_PAIRS = "SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.destination, b.destination) AS destination, coalesce(a.flow, 0e0) AS x, coalesce(b.flow, 0e0) AS y FROM (SELECT * FROM {observed} WHERE origin <> destination) a FULL OUTER JOIN (SELECT * FROM {predicted} WHERE origin <> destination) b ON a.origin = b.origin AND a.destination = b.destination"
common_part_of_commuters = Op("common_part_of_commuters", "2 sum min / (A + B) over pairs that are no self loops; 0 if empty.", f"SELECT round(CASE WHEN sum(x) + sum(y) > 0 THEN 2 * sum(least(x, y)) / (sum(x) + sum(y)) ELSE 0e0 END, 6) AS cpc FROM ({_PAIRS}) p")
common_part_of_links = Op("common_part_of_links", "Shared links twice, over both numbers of links.", f"SELECT round(2e0 * sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) + sum(CASE WHEN y > 0 THEN 1 ELSE 0 END)), 6) AS cpl FROM ({_PAIRS}) p")
_RANK = "(SELECT {0} AS v, coalesce(sum(n) OVER (ORDER BY {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2e0 AS r FROM (SELECT {0}, count(*) AS n FROM pair GROUP BY {0}) g{0})"
compare_flow_models = Op(
    "compare_flow_models",
    "CPC, R2, rank correlation and root mean squared error over the union of pairs. Ranks are laid out over the different values of flow.",
    f"""WITH pair AS ({_PAIRS}), m AS (SELECT avg(x) AS mx FROM pair)
      SELECT round(2 * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS cpc, round(1 - sum(pow(x - y, 2)) / sum(pow(x - mx, 2)), 6) AS r_squared, round(corr(rx, ry), 6) AS spearman, round(sqrt(avg(pow(x - y, 2))), 5) AS rmse FROM (
      SELECT p.x, p.y, m.mx, a.r AS rx, b.r AS ry FROM pair p CROSS JOIN m JOIN {_RANK.format("x")} a ON p.x = a.v JOIN {_RANK.format("y")} b ON p.y = b.v) q""",
)
regression_metrics = Op(
    "regression_metrics",
    "R2, mse, rmse, nrmse, signed maximum error, information gain and KL divergence of predicted against true values.",
    f"""WITH pair AS (SELECT * FROM ({_PAIRS}) p0 WHERE x > 0 AND y > 0), m AS (SELECT avg(x) AS mx, sum(x) AS sx, sum(y) AS sy FROM pair)
      SELECT round(1 - sum(pow(x - y, 2)) / sum(pow(x - mx, 2)), 6) AS r_squared, round(avg(pow(x - y, 2)), 4) AS mse, round(sqrt(avg(pow(x - y, 2))), 5) AS rmse, round(sqrt(avg(pow(x - y, 2))) / sum(x), 9) AS nrmse, round(max(x - y), 6) AS max_error,
      round(sum(x / sx * ln(x / y)), 6) AS information_gain, round(sum(x / sx * ln((x / sx) / (y / sy))), 6) AS kl_divergence FROM pair CROSS JOIN m""",
)
jensen_shannon = Op("jensen_shannon", "Jensen-Shannon divergence (nats) of two flow tables as distributions.", f"WITH pair AS ({_PAIRS}), m AS (SELECT sum(x) AS sx, sum(y) AS sy FROM pair) SELECT round(sum(0.5e0 * CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0e0 END + 0.5e0 * CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0e0 END), 6) AS jsd FROM (SELECT x / sx AS p, y / sy AS q FROM pair CROSS JOIN m) d")
wasserstein = Op(
    "wasserstein",
    "One-dimensional Wasserstein distance of two samples of flows. Only the different values of flow are put in order.",
    """WITH a AS (SELECT flow AS v, count(*) AS n FROM {observed} GROUP BY flow), b AS (SELECT flow AS v, count(*) AS n FROM {predicted} GROUP BY flow),
      m AS (SELECT (SELECT sum(n) FROM a) AS sa, (SELECT sum(n) FROM b) AS sb)
      SELECT round(sum(abs(f) * gap), 6) AS wasserstein FROM (SELECT sum(w) OVER (ORDER BY v) AS f, coalesce(lead(v) OVER (ORDER BY v) - v, 0e0) AS gap FROM (
      SELECT v, sum(w) AS w FROM (SELECT v, n / CAST(sa AS DOUBLE) AS w FROM a CROSS JOIN m UNION ALL SELECT v, -n / CAST(sb AS DOUBLE) AS w FROM b CROSS JOIN m) u GROUP BY v) g) c""",
)
_JUMP = "SELECT LONG(floor(HAVERSINE(plat, plng, lat, lng) / <width>)) AS bin, count(*) AS n FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM (SELECT * FROM {{{0}}} WHERE VALID(lat, lng)) v WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)) s WHERE plat IS NOT NULL GROUP BY LONG(floor(HAVERSINE(plat, plng, lat, lng) / <width>))"
common_part_of_distance = Op(
    "common_part_of_distance",
    "Common part of the histograms of two trajectory tables' jumps (bins of width km) over the number of the first one's jumps; 0 where it has none.",
    f"""SELECT round(CASE WHEN sum(a) > 0 THEN sum(least(a, b)) / CAST(sum(a) AS DOUBLE) ELSE 0e0 END, 6) AS cpc_distance FROM (
      SELECT coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM ({_JUMP.format("fixes")}) x FULL OUTER JOIN ({_JUMP.format("other_fixes")}) y ON x.bin = y.bin) h""",
    width="2e0",
)
distribution_summary = Op("distribution_summary", "Count, mean, median, population deviation of finite values.", "SELECT count(*) AS n, round(avg(flow), 6) AS mean, round(median(flow), 6) AS median, round(stddev_pop(flow), 6) AS std FROM {flows}")
bounding_box = Op("bounding_box", "Least and largest coordinates.", f"SELECT min(lat) AS min_lat, min(lng) AS min_lng, max(lat) AS max_lat, max(lng) AS max_lng FROM ({_V}) v")
