"""The driver's tables as mobility tables: SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.portable import dialect

_PLACE = "((user_id * 7 + (event_id * event_id) % 11) % 20)"
VIEWS = {
    "fixes": f"SELECT user_id AS uid, ts AS datetime, event_id, event_type, {_PLACE} AS place, CAST(39.90 AS DOUBLE) + {_PLACE} / CAST(200 AS DOUBLE) AS lat, CAST(116.30 AS DOUBLE) + ((3 * {_PLACE}) % 20) / CAST(200 AS DOUBLE) AS lng FROM events",
    "visits": f"SELECT user_id AS uid, {_PLACE} AS location_id, event_type AS purpose, ts AS started_at, PLUS_MINUTES(ts, CAST(((event_id % 8) + 1) * 15 AS INT)) AS finished_at FROM events",
    "staypoints": f"SELECT user_id AS uid, event_id AS staypoint_id, {_PLACE} AS location_id, ts AS started_at, PLUS_MINUTES(ts, CAST(((event_id % 8) + 1) * 15 AS INT)) AS finished_at, event_id % 3 = 0 AS activity FROM events",
    "triplegs": "SELECT uid, staypoint_id AS tripleg_id, started_at, finished_at, CAST((staypoint_id * 31) % 97 AS DOUBLE) AS length_km FROM (SELECT uid, staypoint_id, finished_at AS started_at, lead(started_at) OVER (PARTITION BY uid ORDER BY started_at, staypoint_id) AS finished_at FROM staypoints) s WHERE finished_at > started_at",
    "instants": "SELECT DISTINCT TRUNC('day', ts) AS at FROM events",
    "flows": "SELECT c_nationkey AS origin, s_nationkey AS destination, CAST(sum(l_quantity) AS DOUBLE) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey",
    "observed": "SELECT * FROM flows",
    "predicted": "SELECT origin, destination, flow * (1 + ((origin * 3 + destination) % 5) / 10e0) AS flow FROM flows WHERE (origin + destination) % 7 <> 0",
    "places": "SELECT location_id, CAST(39.90 AS DOUBLE) + location_id / CAST(200 AS DOUBLE) AS lat, CAST(116.30 AS DOUBLE) + ((3 * location_id) % 20) / CAST(200 AS DOUBLE) AS lng, CAST(count(*) AS DOUBLE) AS relevance, CAST(count(DISTINCT uid) AS DOUBLE) AS tot_outflow FROM visits GROUP BY location_id",
    "catalogue": "SELECT * FROM places WHERE relevance >= (SELECT avg(relevance) FROM places)",
    "own_places": "SELECT uid, location_id FROM (SELECT uid, location_id, count(*) AS n FROM visits GROUP BY uid, location_id) g WHERE n > 1",
    "other_fixes": "SELECT uid, datetime, event_id, place, lat + 0.003e0 * (event_id % 4) AS lat, lng FROM fixes",
    "pois": "SELECT s_suppkey AS id, CAST(39.88 AS DOUBLE) + ((s_suppkey * 37) % 101) / CAST(700 AS DOUBLE) AS lat, CAST(116.28 AS DOUBLE) + ((s_suppkey * 53) % 97) / CAST(700 AS DOUBLE) AS lng, s_nationkey % 4 AS category FROM supplier",
}
_TABLES = ("events", "lineitem", "orders", "customer", "supplier", "nation", "region", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    import re

    text = dialect(VIEWS[name], 0)
    need = [t for t in (*_TABLES, *VIEWS) if t != name and re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    frames = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in need}
    for t in need:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} {t}", text)
    return spark.sql(text, **frames)
