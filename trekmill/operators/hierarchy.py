"""From staypoints and triplegs to trips, transport modes and catalogues; positions at given times."""

from __future__ import annotations

from ..functions.portable import SqlOperator as Op
from .individual import _V

#: Upper speeds (km/h) and names of the coarse transport modes.
MODES = "CASE WHEN speed <= 15e0 THEN 'slow_mobility' WHEN speed <= 100e0 THEN 'motorized_mobility' ELSE 'fast_mobility' END"
_HOURS = "(MINUTES(started_at, finished_at) / 60)"
_MODE = f"SELECT *, {MODES} AS mode FROM (SELECT *, CASE WHEN {_HOURS} > 0 THEN length_km / {_HOURS} ELSE 0e0 END AS speed FROM {{triplegs}}) s"

predict_transport_mode = Op("predict_transport_mode", "Mode of each tripleg: the first threshold its mean speed is within; speed 0 where no time passes.", f"SELECT uid, tripleg_id, mode FROM ({_MODE}) m")
modal_split = Op("modal_split", "Triplegs, km and hours by unit of time and mode, and the mode's share of the unit's triplegs.", f"SELECT unit, mode, n, length_km, hours, round(n / CAST(sum(n) OVER (PARTITION BY unit) AS DOUBLE), 6) AS share FROM (SELECT TRUNC('<unit>', started_at) AS unit, mode, count(*) AS n, round(sum(length_km), 4) AS length_km, round(sum({_HOURS}), 4) AS hours FROM ({_MODE}) m GROUP BY TRUNC('<unit>', started_at), mode) g", unit="week")
modal_split_per_user = Op("modal_split_per_user", "The same by user over all time.", f"SELECT uid, mode, n, round(n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE), 6) AS share FROM (SELECT uid, mode, count(*) AS n FROM ({_MODE}) m GROUP BY uid, mode) g")
trips = Op(
    "trips",
    "Triplegs between two activities as one trip: the last activity at or before is its origin, the next one its destination.",
    """SELECT uid, idx AS trip, min(started_at) AS started_at, max(finished_at) AS finished_at, count(*) AS n_triplegs, SORTED(id) AS tripleg_ids, min(origin) AS origin, min(destination) AS destination FROM (
      SELECT *, LAST_KNOWN(act) OVER (PARTITION BY uid ORDER BY started_at, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS origin,
        NEXT_KNOWN(act) OVER (PARTITION BY uid ORDER BY started_at, kind, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS destination,
        LONG(sum(CASE WHEN act IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY started_at, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS idx FROM (
        SELECT uid, 0 AS kind, staypoint_id AS id, started_at, finished_at, CASE WHEN activity THEN staypoint_id END AS act FROM {staypoints}
        UNION ALL SELECT uid, 1 AS kind, tripleg_id AS id, started_at, finished_at, CAST(NULL AS BIGINT) AS act FROM {triplegs}) t) w
      WHERE kind = 1 GROUP BY uid, idx""",
)
staypoints_validate = Op("staypoints_validate", "Rows without an interval, and rows that end before they start.", "SELECT count(*) AS n, LONG(sum(CASE WHEN started_at IS NULL OR finished_at IS NULL THEN 1 ELSE 0 END)) AS without_interval, LONG(sum(CASE WHEN finished_at < started_at THEN 1 ELSE 0 END)) AS reversed FROM {staypoints}")
locations_validate = Op("locations_validate", "Faults of a catalogue: null ids, repeated ids, centres that are no coordinates.", "SELECT LONG(sum(CASE WHEN location_id IS NULL THEN n ELSE 0 END)) AS null_ids, LONG(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)) AS repeated_ids, LONG(sum(bad)) AS bad_centres FROM (SELECT location_id, count(*) AS n, sum(CASE WHEN VALID(lat, lng) THEN 0 ELSE 1 END) AS bad FROM {places} GROUP BY location_id) g")
global_locations = Op("global_locations", "Cells of a square grid that hold fixes, with their centres and sizes.", f"SELECT cell_lat, cell_lng, round((cell_lat + 0.5e0) * <degrees>, 6) AS lat, round((cell_lng + 0.5e0) * <degrees>, 6) AS lng, count(*) AS n, count(DISTINCT uid) AS users FROM (SELECT uid, LONG(floor(lat / <degrees>)) AS cell_lat, LONG(floor(lng / <degrees>)) AS cell_lng FROM ({_V}) v) c GROUP BY cell_lat, cell_lng", degrees="0.013e0")
timezone_conversion = Op("timezone_conversion", "Local times of one zone as those of another.", "SELECT event_id, ZONE('<source>', '<target>', datetime) AS datetime FROM {fixes}", source="Asia/Shanghai", target="Europe/Rome")
sort_by_uid_and_datetime = Op("sort_by_uid_and_datetime", "Each fix with its place in its user's order of time.", "SELECT uid, event_id, LONG(row_number() OVER (PARTITION BY uid ORDER BY datetime, event_id)) AS position FROM {fixes}")
flow_matrix = Op("flow_matrix", "The whole origin by destination matrix in long form, 0 where no flow is.", "SELECT o.a AS origin, d.b AS destination, coalesce(f.flow, 0e0) AS flow FROM (SELECT DISTINCT origin AS a FROM {flows}) o CROSS JOIN (SELECT DISTINCT destination AS b FROM {flows}) d LEFT JOIN (SELECT origin, destination, sum(flow) AS flow FROM {flows} GROUP BY origin, destination) f ON f.origin = o.a AND f.destination = d.b")
to_flowdataframe = Op("to_flowdataframe", "Moves between the grid cells of consecutive fixes, self loops included.", f"SELECT origin_row, origin_column, destination_row, destination_column, count(*) AS flow FROM (SELECT y AS origin_row, x AS origin_column, lead(y) OVER w AS destination_row, lead(x) OVER w AS destination_column FROM (SELECT *, LONG(floor((lat + 90) / <degrees>)) AS y, LONG(floor((lng + 180) / <degrees>)) AS x FROM ({_V}) v) c WINDOW w AS (PARTITION BY uid ORDER BY datetime, event_id)) m WHERE destination_row IS NOT NULL GROUP BY origin_row, origin_column, destination_row, destination_column", degrees="0.013e0")
interpolate_at = Op(
    "interpolate_at",
    "Every user's position at every given time, on the straight line between the fixes around it; not valid, and null, outside the user's span.",
    f"""SELECT uid, datetime AS at, t0 IS NOT NULL AND t1 IS NOT NULL AS valid,
      round(CASE WHEN t1 > t0 THEN lat0 + (lat1 - lat0) * (MINUTES(t0, datetime) / MINUTES(t0, t1)) WHEN t1 IS NOT NULL AND t0 IS NOT NULL THEN lat0 END, 6) AS lat,
      round(CASE WHEN t1 > t0 THEN lng0 + (lng1 - lng0) * (MINUTES(t0, datetime) / MINUTES(t0, t1)) WHEN t1 IS NOT NULL AND t0 IS NOT NULL THEN lng0 END, 6) AS lng FROM (
      SELECT *, LAST_KNOWN(ft) OVER b AS t0, LAST_KNOWN(lat) OVER b AS lat0, LAST_KNOWN(lng) OVER b AS lng0, NEXT_KNOWN(ft) OVER a AS t1, NEXT_KNOWN(lat) OVER a AS lat1, NEXT_KNOWN(lng) OVER a AS lng1 FROM (
        SELECT uid, datetime, datetime AS ft, lat, lng, event_id, 0 AS kind FROM ({_V}) v
        UNION ALL SELECT u.uid, i.at AS datetime, CAST(NULL AS TIMESTAMP_NTZ) AS ft, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng, CAST(NULL AS BIGINT) AS event_id, 1 AS kind FROM (SELECT DISTINCT uid FROM ({_V}) v2) u CROSS JOIN {{instants}} i) t
      WINDOW b AS (PARTITION BY uid ORDER BY datetime, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY uid ORDER BY datetime, kind, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) w WHERE kind = 1""",
)
interpolate_at_nearest = Op(
    "interpolate_at_nearest",
    "Every user's nearest fix in time at every given time (ties: the earlier one); not valid, and null, outside the user's span.",
    f"""SELECT uid, datetime AS at, t0 IS NOT NULL AND t1 IS NOT NULL AS valid,
      CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN MINUTES(t0, datetime) <= MINUTES(datetime, t1) THEN lat0 ELSE lat1 END END AS lat,
      CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN MINUTES(t0, datetime) <= MINUTES(datetime, t1) THEN lng0 ELSE lng1 END END AS lng FROM (
      SELECT *, LAST_KNOWN(ft) OVER b AS t0, LAST_KNOWN(lat) OVER b AS lat0, LAST_KNOWN(lng) OVER b AS lng0, NEXT_KNOWN(ft) OVER a AS t1, NEXT_KNOWN(lat) OVER a AS lat1, NEXT_KNOWN(lng) OVER a AS lng1 FROM (
        SELECT uid, datetime, datetime AS ft, lat, lng, event_id, 0 AS kind FROM ({_V}) v
        UNION ALL SELECT u.uid, i.at AS datetime, CAST(NULL AS TIMESTAMP_NTZ) AS ft, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng, CAST(NULL AS BIGINT) AS event_id, 1 AS kind FROM (SELECT DISTINCT uid FROM ({_V}) v2) u CROSS JOIN {{instants}} i) t
      WINDOW b AS (PARTITION BY uid ORDER BY datetime, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY uid ORDER BY datetime, kind, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) w WHERE kind = 1""",
)
squared_tessellation = Op(
    "squared_tessellation",
    "Squares of side metres (Web Mercator) over the bounding box of the fixes, with their centres.",
    f"""SELECT i * (nx + 1) + j AS tile_id, i AS tile_row, j AS tile_column, round(degrees(2 * atan(exp((y0 + (i + 0.5e0) * <metres>) / 6378137e0)) - 1.5707963267948966e0), 6) AS lat, round(degrees((x0 + (j + 0.5e0) * <metres>) / 6378137e0), 6) AS lng FROM (
      SELECT * FROM (SELECT x0, y0, LONG(0) AS z, LONG(floor((x1 - x0) / <metres>)) AS nx, LONG(floor((y1 - y0) / <metres>)) AS ny FROM (
        SELECT 6378137e0 * radians(min(lng)) AS x0, 6378137e0 * radians(max(lng)) AS x1, 6378137e0 * ln(tan(0.7853981633974483e0 + radians(min(lat)) / 2)) AS y0, 6378137e0 * ln(tan(0.7853981633974483e0 + radians(max(lat)) / 2)) AS y1 FROM ({_V}) v) b) n SERIES(i, z, ny)) r SERIES(j, z, nx)""",
    metres="1500e0",
)
voronoi_tessellation = Op("voronoi_tessellation", "Points numbered from 0 as tiles, in the order of a two-level count: points of a block of ids, then blocks.", "WITH b AS (SELECT LONG(floor(id / <block>)) AS k, count(*) AS n FROM {pois} GROUP BY LONG(floor(id / <block>))), o AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT p.id, LONG(o.before + row_number() OVER (PARTITION BY o.k ORDER BY p.id) - 1) AS tile_id, p.lat, p.lng FROM {pois} p JOIN o ON LONG(floor(p.id / <block>)) = o.k", block="4096e0")
stvd = Op(
    "stvd",
    "Mean volume of each place and ten minutes of the day, as mean_area_volume, with the place's centre.",
    """SELECT v.area, v.slot, p.lat, p.lng, round(v.m / 7, 6) AS mean_volume FROM (SELECT area, slot, sum(m) AS m FROM (SELECT area, slot, wd, avg(users) AS m FROM (
      SELECT area, day, wd, slot, count(DISTINCT uid) AS users FROM (
        SELECT uid, location_id AS area, LONG(floor(s / 144e0)) AS day, LONG(floor(s / 144e0) + 3) % 7 AS wd, s % 144 AS slot FROM (SELECT uid, location_id, LONG(floor(EPOCH_US(started_at) / 600000000e0)) AS s0, LONG(floor(EPOCH_US(finished_at) / 600000000e0)) AS s1 FROM {visits}) v SERIES(s, s0, s1)) e
      GROUP BY area, day, wd, slot) g GROUP BY area, slot, wd) h GROUP BY area, slot) v LEFT JOIN {places} p ON v.area = p.location_id""",
)
compare_to = Op(
    "compare_to",
    "Wasserstein distance of the values of two tables in each group both have, and the mean over the groups.",
    """SELECT grp, round(w, 6) AS wasserstein, round(avg(w) OVER (), 6) AS mean_wasserstein FROM (
      SELECT grp, sum(abs(f) * gap) AS w, max(l) AS l, max(r) AS r FROM (SELECT grp, l, r, sum(m) OVER (PARTITION BY grp ORDER BY v) AS f, coalesce(lead(v) OVER (PARTITION BY grp ORDER BY v) - v, 0e0) AS gap FROM (
        SELECT grp, v, sum(m) AS m, max(l) AS l, max(r) AS r FROM (SELECT origin AS grp, flow AS v, 1e0 / count(*) OVER (PARTITION BY origin) AS m, 1 AS l, 0 AS r FROM {observed} UNION ALL SELECT origin AS grp, flow AS v, -1e0 / count(*) OVER (PARTITION BY origin) AS m, 0 AS l, 1 AS r FROM {predicted}) a GROUP BY grp, v) b) c GROUP BY grp) d WHERE l = 1 AND r = 1""",
)
distribution_quantiles = Op("distribution_quantiles", "Tenth and ninetieth percentile of the flows, between neighbours on a straight line.", "SELECT round(PERCENTILE(flow, 0.1), 6) AS p10, round(PERCENTILE(flow, 0.9), 6) AS p90 FROM {flows}")


class TessellationTilers:
    """Tessellations by name: callables that take a table of fixes or points first."""

    def __init__(self):
        self._known = {"squared": squared_tessellation, "voronoi": voronoi_tessellation, "grid": global_locations}

    def register_tiler(self, key: str, tiler) -> None:
        self._known[key] = tiler

    def create(self, key: str, *frames, **parameters):
        if key not in self._known:
            raise ValueError(f"no tiler {key!r}; there are {sorted(self._known)}")
        return self._known[key](*frames, **parameters)

    get = create


tilers = TessellationTilers()
