"""Stays, segments, simplification and sequences, by hand; live windows from files."""

import numpy as np
import pytest
from test_mobility import fixes

from trekmill.operators import walks
from trekmill.plans.registry import QUERIES
from trekmill.streaming import visits


def ids(df, column=None):
    return [r["event_id"] if column is None else r[column] for r in df.orderBy("event_id").collect()]


def line(spark, points):
    return fixes(spark, [("a", i, 0, lat, lng) for i, (lat, lng) in enumerate(points)])


def test_stays_and_stop_segments(spark):
    df = line(spark, [(0.0, 0.0), (0.0, 0.0001), (0.0, 1.0), (0.0, 2.0)])
    got = walks.stay_locations(df, minutes_for_a_stop=90).collect()
    assert [(str(r["started_at"])[11:16], str(r["finished_at"])[11:16], r["lng"]) for r in got] == [("00:00", "02:00", pytest.approx(0.00005))]
    assert ids(walks.segment_stop(df, minutes_for_a_stop=90), "segment_id") == [0, 0, 0, 1]
    assert walks.stay_locations(df.where("false")).count() == 0


def test_simplify(spark):
    df = line(spark, [(0.0, 0.0), (0.0, 1.0), (0.5, 2.0), (0.0, 3.0), (0.0, 4.0)])
    assert ids(walks.simplify_douglas_peucker(df, 40.0)) == [0, 2, 4]
    assert ids(walks.simplify_top_down_time_ratio(df, 40.0)) == [0, 2, 4]
    assert ids(walks.simplify_max_distance(df, 100.0)) == [0, 4]


def test_filters_and_segments(spark):
    df = line(spark, [(0.0, 0.0), (50.0, 0.0), (0.0, 0.01), (0.0, 0.02)])
    assert ids(walks.filter_smart_greedy(df)) == [0, 2, 3]
    steps = np.cumsum([0, 1.0, 1.2, 0.8, 1.1, 5.0, 0.9, 1.2, 0.8, 1.0]) / 100
    kept = ids(walks.filter_hampel(line(spark, [(0.0, float(x)) for x in steps])))
    assert 5 not in kept and {0, 1, 8, 9} <= set(kept)
    bend = line(spark, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)])
    assert ids(walks.segment_angle_change(bend), "segment_id") == [0, 0, 1, 1]
    rest = line(spark, [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 2.0)])
    assert ids(walks.segment_speed(rest, speed_kmh=1.0), "segment_id") == [0, 0, 1, 1, 2]


def test_sequences(spark):
    r = walks.trajectory_predictability(fixes(spark, [("a", i, 0, float(i % 2), 0.0) for i in range(6)] + [("one", 0, 0, 0.0, 0.0)])).orderBy("uid").collect()
    # ababab has longest matches of 1, 1, 1, 2, 3, 4 by the recurrence
    assert (r[0]["n_unique"], r[0]["n_steps"], r[0]["real_entropy"]) == (2, 6, pytest.approx(6 * np.log2(6) / 12))
    assert (r[1]["real_entropy"], r[1]["predictability"]) == (0.0, 1.0)
    assert walks._fano(1.0, 2) == 0.5 and 0.5 < walks._fano(0.5, 2) < 1
    trips = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 1), ("a", 3, None, 1), ("a", 4, 5, 6)], "uid string, trip_id long, origin int, destination int")
    assert [tuple(x) for x in walks.tours(trips).collect()] == [("a", 1, 2, 2, [1, 2])]


def test_smoothing_keeps_a_straight_walk(spark):
    got = walks.smooth_kalman(line(spark, [(0.0, 0.01 * i) for i in range(10)])).orderBy("event_id").collect()
    assert [x["lng"] for x in got] == pytest.approx([0.01 * i for i in range(10)], abs=1e-4)


def test_live_windows(spark, tmp_path):
    df = line(spark, [(0.0, 0.0)] * 3)
    df.write.parquet(f"{tmp_path}/in")
    for op, want in ((visits.visits_per_window, 3), (visits.sessions, 1)):
        live = op(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
        q = live.writeStream.format("memory").queryName(op.__name__).outputMode("complete" if op is visits.visits_per_window else "append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{op.__name__}").start()
        q.awaitTermination(90)
        assert op(df).count() == want
    assert spark.table("visits_per_window").count() == 3


@pytest.mark.parametrize("name", ["segment_stop", "filter_hampel", "tours", "smooth_kalman", "filter_smart_greedy"])
def test_runs_on_the_smallest_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
