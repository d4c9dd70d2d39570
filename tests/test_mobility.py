"""Operators with answers known by hand, and every query against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from trekmill.functions.columns import MissingColumn, canonical, resolve
from trekmill.functions.portable import dialect
from trekmill.operators import collective, hierarchy, individual, privacy, sequence, social
from trekmill.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fixes(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(u, t0 + dt.timedelta(hours=h), i, None if p is None else int(p), a, b) for i, (u, h, p, a, b) in enumerate(rows)], "uid string, datetime timestamp_ntz, event_id long, place int, lat double, lng double")


def test_radius_and_jumps(spark):
    df = fixes(spark, [("eq", i, i, 0.0, float(i)) for i in range(5)] + [("bad", 0, 0, None, 1.0), ("bad", 1, 0, math.nan, 1.0), ("one", 0, 0, 1.0, 1.0)])
    assert {r["uid"]: r["radius_of_gyration"] for r in individual.radius_of_gyration(df).collect()} == {"eq": pytest.approx(157.2533733, rel=1e-5), "one": 0.0}
    assert [r["jump_length"] for r in individual.jump_lengths(df).collect()] == [pytest.approx(111.1950802335329, abs=1e-5)] * 4
    assert {r["uid"]: r["distance_straight_line"] for r in individual.distance_straight_line(df).collect()}["one"] == 0.0


def test_segments_and_home(spark):
    df = fixes(spark, [("a", 0, 1, 1.0, 1.0), ("a", 1, 1, 1.0, 1.0), ("a", 12, 2, 2.0, 2.0), ("a", 23, 3, 3.0, 3.0)])
    assert [r["segment_id"] for r in sequence.segment_value_change(df).orderBy("event_id").collect()] == [0, 0, 1, 2]
    assert [r["segment_id"] for r in sequence.segment_observation_gap(df, gap_s=36000).orderBy("event_id").collect()] == [0, 0, 1, 2]
    assert individual.home_location(df).first()["lat"] == 1.0


def test_empty_input(spark):
    df = fixes(spark, [])
    for op in (individual.radius_of_gyration, individual.home_location, sequence.filter_greedy, collective.random_location_entropy):
        assert op(df).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "t")], "user int, latitude double, lon double, time string")
    assert canonical(df).columns == ["uid", "lat", "lng", "datetime"]
    with pytest.raises(MissingColumn):
        resolve(["a", "b"])
    assert dialect("LONG(a + b)", 0) == "CAST(a + b AS BIGINT)"


@pytest.mark.parametrize("name", ["radius_of_gyration", "k_radius_of_gyration", "mean_area_volume", "topological_overlap", "cdr_visits", "radiation", "wasserstein", "join_with_events", "interpolate_at", "compare_to", "squared_tessellation", "modal_split", "clustering_coefficients", "location_sequence_risk", "location_proportion_risk", "cdr_trips"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def stays(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(u, p, "x", t0 + dt.timedelta(hours=h), t0 + dt.timedelta(hours=h + 1)) for u, h, p in rows], "uid string, location_id int, purpose string, started_at timestamp_ntz, finished_at timestamp_ntz")


def test_privacy_by_hand(spark):
    df = stays(spark, [("a", 0, 1), ("a", 1, 2), ("b", 0, 2), ("b", 1, 1), ("c", 0, 1), ("d", 0, 1), ("d", 1, 1), ("e", 0, None)])

    def risk(op, **p):
        return {r["uid"]: round(r["risk"], 4) for r in op(df, **p).collect()}

    assert risk(privacy.unique_location_risk) == {"a": 0.5, "b": 0.5, "c": 0.25, "d": 0.25}
    assert risk(privacy.location_risk) == {"a": 0.5, "b": 0.5, "c": 0.25, "d": 1.0}
    assert risk(privacy.location_sequence_risk) == {"a": 1.0, "b": 1.0, "c": 0.25, "d": 1.0}
    assert risk(privacy.location_time_risk) == {"a": 1.0, "b": 1.0, "c": 0.3333, "d": 1.0}
    assert risk(privacy.location_frequency_risk) == {"a": 0.5, "b": 0.5, "c": 0.3333, "d": 1.0}


def test_trips_by_hand(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    sp = spark.createDataFrame([("a", 1, t[0], t[1], True), ("a", 2, t[2], t[2], False), ("a", 3, t[4], t[5], True)], "uid string, staypoint_id long, started_at timestamp_ntz, finished_at timestamp_ntz, activity boolean")
    legs = spark.createDataFrame([("a", 10, t[1], t[2], 1.0), ("a", 11, t[3], t[4], 2.0)], "uid string, tripleg_id long, started_at timestamp_ntz, finished_at timestamp_ntz, length_km double")
    got = [tuple(r) for r in hierarchy.trips(sp, legs).select("trip", "n_triplegs", "origin", "destination").collect()]
    assert got == [(1, 2, 1, 3)]
    assert hierarchy.trips(sp.where("false"), legs.where("false")).count() == 0


def test_random_graphs_keep_days(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (2, 1, 3)], "day long, u long, v long")
    got = social.random_daily_graphs(df, replicates=3).collect()
    assert {(r["day"]) for r in got} <= {1, 2} and all(r["u"] < r["v"] for r in got)
    near = {(r["u"], r["v"]): (r["persistence"], r["overlap"]) for r in social.persistence_and_overlap(df).collect()}
    assert near[1, 2] == (0.5, 0.0)
