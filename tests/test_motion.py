"""Loops, splines, optimal simplification, triplegs, clusters, distances and motifs, by hand."""

import datetime as dt

import numpy as np
import pytest
from test_mobility import fixes, stays
from test_walks import ids, line

from trekmill.operators import motion, visits, walks


def test_loops_and_simplification(spark):
    df = line(spark, [(0.0, 0.0), (0.0, 0.1), (0.0, 0.01), (0.0, 0.3), (0.0, 0.4)])
    assert ids(motion.filter_loops(df)) == [0, 2, 3, 4]
    bend = line(spark, [(0.0, 0.0), (0.0, 1.0), (0.5, 2.0), (0.0, 3.0), (0.0, 4.0)])
    for op in (motion.simplify_chan_chin, motion.simplify_imai_iri):
        assert ids(op(bend, 40.0)) == [0, 2, 4]
        assert ids(op(bend, 0.001)) == [0, 1, 2, 3, 4]
        assert ids(op(bend.limit(1), 1.0)) == [0]


def test_fewest_points_match_brute_force(spark):
    rng = np.random.default_rng(5)
    points = np.cumsum(rng.normal(0, 0.01, (12, 2)), axis=0)
    z = walks._planar(points[:, 0], points[:, 1])
    most = {0: 1}
    for j in range(1, 12):
        most[j] = min(most[i] + 1 for i in range(j) if j == i + 1 or (walks._from_segment(z[i + 1 : j], z[i], z[j]) <= 1.5).all())
    assert motion.simplify_chan_chin(line(spark, points.tolist()), 1.5).count() == most[11]


def test_interpolation(spark):
    t = np.array([0.0, 1.0, 3.0, 4.0])
    y = np.column_stack([2 * t + 1, -t])
    assert motion._spline(t, y, np.array([0.5, 2.0, 3.9])) == pytest.approx(np.column_stack([[2.0, 5.0, 8.8], [-0.5, -2.0, -3.9]]))
    df = fixes(spark, [("a", h, 0, float(h), 0.0) for h in (0, 1, 2, 3, 7)])
    for method in ("linear", "cubic", "kinematic"):
        got = motion.interpolate(df, method, max_speed_kmh=1000.0).where("event_id is null").collect()
        assert [(str(r["datetime"])[11:16], round(r["lat"], 6)) for r in got] == [("04:00", 4.0)]
    one, two = (motion.interpolate(df, "random_walk").where("event_id is null").first()["lat"] for _ in range(2))
    assert one == two != 4.0


def test_triplegs_and_trimming(spark):
    df = fixes(spark, [("a", h, 0, 0.0, x) for h, x in ((0, 0.0), (1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0))])
    got = motion.triplegs(df, minutes_for_a_stop=90).collect()
    assert [(str(r["started_at"])[11:16], str(r["finished_at"])[11:16], round(r["length_km"], 3)) for r in got] == [("02:00", "04:00", pytest.approx(222.39))]
    slow = walks.stay_locations(line(spark, [(0.0, 0.0), (0.0, 0.0001), (0.0, 0.0002), (0.0, 2.0)]), minutes_for_a_stop=60, min_speed_kmh=1.0).first()
    assert str(slow["finished_at"])[11:16] == "02:00"


def test_clusters(spark):
    df = line(spark, [(0.0, 0.0), (5.0, 5.0), (0.0, 0.0021), (9.0, 9.0), (5.0, 5.0), (0.0, 0.0)])
    assert ids(motion.cluster(df, 0.002), "cluster") == [0, 1, 0, 2, 1, 0]
    assert ids(motion.cluster(df, 0.002, min_samples=2), "cluster") == [0, 1, -1, -1, 1, 0]
    assert motion.user_locations(df, 0.002).count() == 3


def test_distances(spark):
    df = fixes(spark, [("a", h, 0, 0.0, float(h)) for h in range(3)] + [("b", h, 0, 0.0, float(h) + 1) for h in range(3)])
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    degree = 111.19508
    want = {"dtw": 2 * degree, "frechet": degree, "hausdorff": degree, "lcss": 2 / 3}
    for method, x in want.items():
        assert motion.trajectory_distance(df, pairs, method).first()["distance"] == pytest.approx(x, rel=1e-4)


def test_sequences_of_visits(spark):
    for s in ([1], [1, 1, 1], [1, 2, 1, 2, 3], list("abracadabra")):
        assert visits.distinct_runs(s) == len({tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)})
    assert visits.motif_id([0]) == (1 << 36) and visits.motif_id(list("abcdefg")) == -1
    assert visits.motif_id(list("aba")) == (2 << 36) | 0b0110
    assert visits.motif_id(list("abca")) == visits.motif_id(list("acba"))
    df = stays(spark, [("a", 0, 1), ("a", 9, 2), ("a", 20, 1), ("b", 9, 3)]).replace("x", "HOME", ["purpose"])
    got = visits.daily_motifs(df).orderBy("uid").collect()
    assert [(r["uid"], r["day"], r["motif_id"]) for r in got] == [("a", dt.date(2024, 1, 1), (2 << 36) | 6), ("b", dt.date(2024, 1, 1), 1 << 36)]
    assert [r["per_cent"] for r in visits.motif_distribution(visits.daily_motifs(df)).collect()] == [50.0, 50.0]
    r = {x["uid"]: x for x in visits.intermittency(df, level=2.0).collect()}
    # a: 13 slots each; of the first two visits one slot each is new
    assert (r["a"]["exploring"], r["a"]["returning"]) == (1.0, pytest.approx(37 / 2))
    assert visits.diversity(df).count() == 2 and visits.diversity(df.where("false")).count() == 0
