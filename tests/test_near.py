"""Nearest points and points in polygons against all pairs."""

import datetime as dt
import math
import random

import pytest

from trekmill.operators import match, near, sequence
from trekmill.plans import registry


def distance(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("spread", [0.05, 3.0, 80.0])
def test_nearest(spark, spread):
    rnd = random.Random(int(spread))
    point = lambda: (max(-90.0, min(90.0, rnd.gauss(10, spread))), (rnd.gauss(179.9, spread) + 180) % 360 - 180)  # noqa: E731  about the date line
    points, others = [point() for _ in range(60)], [(i, *point()) for i in range(40)]
    others += [(100, others[0][1], others[0][2])]  # a tie
    f = spark.createDataFrame([*points, (None, 1.0), (91.0, 0.0)], "lat double, lng double")
    o = spark.createDataFrame([(*x, x[0] % 3) for x in others], "id long, lat double, lng double, category long")
    got = {(r["lat"], r["lng"]): (r["id"], r["d"]) for r in near.nearest(f, o).collect()}
    want = {p: min((round(distance(*p, y, x), 9), i) for i, y, x in others) for p in points}
    assert {p: i for p, (i, _) in got.items()} == {p: i for p, (_, i) in want.items()}
    by = {(r["lat"], r["lng"], r["category"]): r["id"] for r in near.nearest(f, o, by="category").collect()}
    assert by == {(*p, c): min((round(distance(*p, y, x), 9), i) for i, y, x in others if i % 3 == c)[1] for p in points for c in range(3)}


def test_no_points(spark):
    f = spark.createDataFrame([(1.0, 2.0)], "lat double, lng double")
    o = spark.createDataFrame([], "id long, lat double, lng double")
    assert near.nearest(f, o).count() == 0 and near.nearest(f.where("false"), o).count() == 0


def test_polygons(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    tiles = [(1, [square(0.0, 0.0, 1.0), square(0.4, 0.4, 0.2)]), (2, [square(0.4, 0.4, 0.2)]), (3, [square(0.9, 0.9, 2.0)])]
    df = spark.createDataFrame([(i, [[{"lng": a, "lat": b} for a, b in ring] for ring in rings]) for i, rings in tiles], "tile_id long, rings array<array<struct<lng double, lat double>>>")
    f = spark.createDataFrame([(0.1, 0.1), (0.5, 0.5), (0.95, 0.95), (2.5, 1.5), (9.0, 9.0)], "lat double, lng double")
    assert {r["lat"]: r["tile_id"] for r in near.mapping_polygons(f, df).collect()} == {0.1: 1, 0.5: 2, 0.95: 1, 2.5: 3}


def test_coordinates_are_asked_once(spark):
    """Repeated fixes add no candidates to look for, and no rows to join with one another."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001)], "node long, lat double, lng double")
    edges = spark.createDataFrame([(1, 2, 111.0, 1.0), (2, 1, 111.0, 1.0)], "source long, target long, length_m double, weight double")
    fixes = spark.range(100).selectExpr("id % 5 AS uid", "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id)) AS datetime", "0.0D AS lat", "0.0005D AS lng")
    assert match._candidates(fixes, nodes, edges).count() == 2 and match.candidates(fixes, nodes, edges).count() == 200
    assert match.match_trajectory(fixes, nodes, edges).select("event_id").distinct().count() == 100


def test_nearest_events(spark):
    """Equal to the join of all pairs in a window, with ties of distance and time, one coordinate for many and none in reach."""
    r = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{r.randrange(6)}", t0 + dt.timedelta(seconds=450 * r.randrange(60)), e, 39.9 + r.randrange(5) / 100, 116.3 + r.randrange(3) / 100) for e in range(150)]
    rows += [("u1", t0 + dt.timedelta(days=9), 900, 39.9, 116.3), (None, t0, 901, 39.9, 116.3), ("u1", t0, 902, None, 116.3)]
    fixes = spark.createDataFrame(rows, "uid string, datetime timestamp_ntz, event_id long, lat double, lng double")
    for window in (900, 100):
        want = sorted(tuple(x) for x in sequence.join_with_events(fixes, window_s=window).collect())
        assert want and sorted(tuple(x) for x in near.nearest_events(fixes, window).collect()) == want
    # Fixes are no longer joined with fixes.
    assert "Join" not in registry.QUERIES["join_with_events"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
