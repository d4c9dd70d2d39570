"""Re-identification risk of users known by two items of their data (one, where they have no more).

The risk of a pair of items is 1 over the users it fits, the user's own data included; a user's
risk is the largest over their pairs. Pairs are counted by value before users are compared.
"""

from __future__ import annotations

from ..functions.portable import SqlOperator as Op

_PLACES = "SELECT uid, CAST(location_id AS STRING) AS item, count(*) AS n FROM {visits} WHERE location_id IS NOT NULL GROUP BY uid, CAST(location_id AS STRING)"
_TIMES = "SELECT uid, item, count(*) AS n FROM (SELECT uid, concat(CAST(location_id AS STRING), ' ', CAST(LONG(floor(EPOCH_US(TRUNC('<precision>', started_at)) / 1000000e0)) AS STRING)) AS item FROM {visits} WHERE location_id IS NOT NULL AND started_at IS NOT NULL) x GROUP BY uid, item"


def _contained(items: str, repeats: bool) -> str:
    """Pairs of items (with an item twice, where repeats) that users contain."""
    twice = " UNION ALL SELECT uid, item AS i, item AS j FROM t WHERE n >= 2" if repeats else ""
    few = "sum(n)" if repeats else "count(*)"
    return f"""WITH t AS ({items}), p AS (SELECT a.uid, a.item AS i, b.item AS j FROM t a JOIN t b ON a.uid = b.uid AND a.item < b.item{twice}),
      one AS (SELECT uid FROM t GROUP BY uid HAVING {few} = 1)
      SELECT uid, round(max(risk), 6) AS risk FROM (SELECT uid, 1e0 / count(*) OVER (PARTITION BY i, j) AS risk FROM p
        UNION ALL SELECT o.uid, 1e0 / c.users AS risk FROM one o JOIN t ON o.uid = t.uid JOIN (SELECT item, count(*) AS users FROM t GROUP BY item) c ON t.item = c.item) r GROUP BY uid"""


def _valued(x: str, y: str, value: str) -> str:
    """Pairs of places whose two values, made from a.v and b.v, lie within tolerance of a candidate's own."""
    near = " AND ".join(f"s.{c} >= c.{c} * (1 - <tolerance>) AND s.{c} <= c.{c} * (1 + <tolerance>)" for c in "xy")
    return f"""WITH t AS (SELECT uid, item, {value} AS v FROM ({_PLACES}) z), p AS (SELECT a.uid, a.item AS i, b.item AS j, {x} AS x, {y} AS y FROM t a JOIN t b ON a.uid = b.uid AND a.item < b.item
        UNION ALL SELECT t.uid, t.item AS i, '' AS j, {x.replace('a.v', 't.v').replace('b.v', 't.v')} AS x, 1e0 AS y FROM t JOIN (SELECT uid FROM t GROUP BY uid HAVING count(*) = 1) o ON t.uid = o.uid),
      d AS (SELECT i, j, x, y, count(*) AS users FROM p GROUP BY i, j, x, y),
      f AS (SELECT i, j, x, y, users FROM d WHERE j <> '' UNION ALL SELECT item AS i, '' AS j, {x.replace('a.v', 'v').replace('b.v', 'v')} AS x, 1e0 AS y, count(*) AS users FROM t GROUP BY item, {x.replace('a.v', 'v').replace('b.v', 'v')}),
      m AS (SELECT s.i, s.j, s.x, s.y, sum(c.users) AS users FROM d s JOIN f c ON s.i = c.i AND s.j = c.j AND {near} GROUP BY s.i, s.j, s.x, s.y)
      SELECT p.uid, round(max(1e0 / m.users), 6) AS risk FROM p JOIN m ON p.i = m.i AND p.j = m.j AND p.x = m.x AND p.y = m.y GROUP BY p.uid"""


unique_location_risk = Op("unique_location_risk", "Known: the set of two places.", _contained(_PLACES, False))
location_risk = Op("location_risk", "Known: two visits' places, the same one twice included.", _contained(_PLACES, True))
location_time_risk = Op("location_time_risk", "Known: two visits' places with their times to the precision.", _contained(_TIMES, True), precision="hour")
location_sequence_risk = Op(
    "location_sequence_risk",
    "Known: two visits' places in the order of time; a before b holds where the first a comes before the last b.",
    """WITH t AS (SELECT uid, item, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT uid, location_id AS item, row_number() OVER (PARTITION BY uid ORDER BY started_at, location_id) AS pos FROM {visits} WHERE location_id IS NOT NULL) v GROUP BY uid, item),
      p AS (SELECT a.uid, a.item AS i, b.item AS j FROM t a JOIN t b ON a.uid = b.uid AND a.first_pos < b.last_pos), one AS (SELECT uid FROM t GROUP BY uid HAVING sum(n) = 1)
      SELECT uid, round(max(risk), 6) AS risk FROM (SELECT uid, 1e0 / count(*) OVER (PARTITION BY i, j) AS risk FROM p
        UNION ALL SELECT o.uid, 1e0 / c.users AS risk FROM one o JOIN t ON o.uid = t.uid JOIN (SELECT item, count(*) AS users FROM t GROUP BY item) c ON t.item = c.item) r GROUP BY uid""",
)
location_frequency_risk = Op("location_frequency_risk", "Known: two places and their numbers of visits.", _valued("a.v", "b.v", "CAST(n AS DOUBLE)"), tolerance="0.1e0")
location_probability_risk = Op("location_probability_risk", "Known: two places and their shares of the user's visits.", _valued("a.v", "b.v", "n / CAST(sum(n) OVER (PARTITION BY uid) AS DOUBLE)"), tolerance="0.1e0")
location_proportion_risk = Op("location_proportion_risk", "Known: two places and their visits relative to the larger of the two.", _valued("a.v / greatest(a.v, b.v)", "b.v / greatest(a.v, b.v)", "CAST(n AS DOUBLE)"), tolerance="0.1e0")
home_work_risk = Op(
    "home_work_risk",
    "Known: a user's two least visited places (ascending counts, as the method has it).",
    """WITH k AS (SELECT uid, min(location_id) AS p, max(location_id) AS q FROM (SELECT uid, location_id, row_number() OVER (PARTITION BY uid ORDER BY count(*), location_id) AS r FROM {visits} GROUP BY uid, location_id) z WHERE r <= 2 GROUP BY uid)
      SELECT uid, round(1e0 / count(*) OVER (PARTITION BY p, q), 6) AS risk FROM k""",
)
