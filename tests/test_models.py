"""Gravity fits, agents, diaries, laws of distances, routes and typed frames, against what made the data or brute force."""

import datetime as dt
import itertools

import numpy as np
import pytest
from test_mobility import fixes

from trekmill.frames import FlowDataFrame, TrajDataFrame
from trekmill.operators import fitting, models, network
from trekmill.operators.kernels import _km
from trekmill.sources import datasets

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, float(a), float(b), float(m)) for i, (a, b, m) in enumerate(zip(rng.uniform(0, 1, 8), rng.uniform(0, 1, 8), rng.integers(1, 50, 8), strict=True))], "location_id long, lat double, lng double, relevance double")


def test_gravity_fit_finds_its_exponents(spark, places):
    p, rows = places.toPandas(), []
    for i in range(8):
        w = {j: p["relevance"][j] ** 0.8 * _km(p["lat"][i], p["lng"][i], p["lat"][j], p["lng"][j]) ** -1.5 for j in range(8) if j != i}
        rows += [(i, j, float(1000 * x / sum(w.values()))) for j, x in w.items()]
    got = models.gravity_fit(spark.createDataFrame(rows, "origin long, destination long, flow double"), places)
    assert (got["alpha"], got["beta"], got["pairs"]) == (pytest.approx(0.8, abs=1e-6), pytest.approx(-1.5, abs=1e-6), 56)


def test_agents_and_diaries(spark, places):
    end = START + dt.timedelta(days=5)
    one, two = (sorted(map(tuple, models.epr(places, START, end, n_agents=3).collect())) for _ in range(2))
    assert one == two and {r[0] for r in one} == {0, 1, 2} and all(START <= r[1] < end for r in one)
    rows = [("a", h, 1 if 9 <= h % 24 < 17 else 0, 0.0, 0.0) for h in range(24 * 10)]
    diary = models.MarkovDiary.fit(fixes(spark, rows))
    assert diary.counts[2 * 9 + 1, 2 * 17] == 10 - 0 and diary.counts[2 * 8, 2 * 9 + 1] == 10
    assert [(t.hour, n) for t, n in diary.generate(48, START)] == [(0, 0), (9, 1), (17, 0), (9, 1), (17, 0)]
    got = models.ditras(places, diary, START, end, n_agents=2)
    assert got.where("hour(datetime) in (0, 17)").select("uid", "location_id").distinct().count() == 2


def test_laws(spark):
    rng = np.random.default_rng(1)
    values = spark.createDataFrame([(float(x),) for x in rng.exponential(5.0, 20000) + 0.01], "x double")
    got = fitting.fit_distance_distribution(values, "x", "exponential")
    assert got["kappa"] == pytest.approx(5.0, rel=0.03) and got["ks"] < 0.02
    assert fitting.compare_distance_distributions(values, "x", ("exponential", "lognormal", "powerlaw")).first()["family"] == "exponential"
    edges, counts = fitting.log_counts(values, "x")
    assert counts.sum() == 20000 and fitting.vuong_test(edges, counts, "exponential", "powerlaw") > 5
    with pytest.raises(ValueError, match="20"):
        fitting.fit_distance_distribution(values.limit(5), "x")


def test_routes_match_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b), float(rng.integers(1, 9)) * 100, float(rng.integers(1, 20))) for a, b in rng.integers(0, 7, (18, 2))]
    roads = network.RoadNetwork(spark.createDataFrame([*edges, (0, 0, 1.0, 1.0)], "source long, target long, length_m double, weight double"))
    best = {(a, b): (np.inf, np.inf) for a in range(8) for b in range(8)} | {(a, a): (0.0, 0.0) for a in range(8)}
    for a, b, m, w in edges:
        if a != b:
            best[a, b] = min(best[a, b], (w, m))
    for k, a, b in itertools.product(range(8), repeat=3):
        best[a, b] = min(best[a, b], (best[a, k][0] + best[k, b][0], best[a, k][1] + best[k, b][1]))
    pairs = spark.createDataFrame([(a, b, 1.0) for a in range(7) for b in range(7) if a != b] + [(0, 99, 1.0), (99, 0, 1.0)], "source long, target long, flow double")
    seen = {e[0] for e in edges if e[0] != e[1]} | {e[1] for e in edges if e[0] != e[1]}
    for r in roads.distances(pairs).collect():
        a, b = r["source"], r["target"]
        w = best.get((a, b), (np.inf, 0)) if {a, b} <= seen else (np.inf, 0)
        assert (r["reachable"], r["metres"]) == ((True, w[1]) if np.isfinite(w[0]) else (False, 0.0))
    for r in roads.routes(pairs).where("size(nodes) > 0").collect():
        assert (r["nodes"][0], r["nodes"][-1]) == (r["source"], r["target"]) and r["weights"][-1] == best[r["source"], r["target"]][0]
    lines = roads.desire_lines(pairs.where("source = 0")).agg({"flow": "sum"}).first()[0]
    assert lines == sum(len(r["nodes"]) - 1 for r in roads.routes(pairs.where("source = 0")).where("size(nodes) > 0").collect())
    hops = fixes(spark, [("a", h, 0, 0.0, 0.0) for h in range(3)]).selectExpr("uid", "event_id", "datetime", "CASE event_id WHEN 2 THEN -1 ELSE event_id END AS node", "9.0D AS straight_km")
    nodes = spark.createDataFrame([(n,) for n in seen], "node long")
    got = {r["event_id"]: r["jump_length"] for r in roads.jump_lengths(hops, nodes).collect()}
    assert got[2] == 9.0 and got[1] == (best[0, 1][1] / 1000 if np.isfinite(best[0, 1][0]) else 9.0)


def test_frames_and_catalogue(spark):
    df = fixes(spark, [("a", 0, 0, 0.0, 0.0), ("a", 1, 0, 0.0, 1.0)]).withColumnRenamed("lat", "latitude")
    traj = TrajDataFrame(df)
    assert traj.jump_lengths().count() == 1 and traj.filter_speed(max_speed_kmh=50.0).radius_of_gyration().first()["radius_of_gyration"] == 0.0
    assert "radius_of_gyration" in dir(traj) and traj.triplegs(minutes_for_a_stop=500.0).predict_transport_mode().first()["mode"] == "fast_mobility"
    flows = FlowDataFrame(spark.createDataFrame([(1, 2, 3.0)], "origin int, destination int, flow double"))
    assert flows.get_flow(origin=1, destination=2).first()["flow"] == 3.0 and flows.common_part_of_commuters(flows).first()["cpc"] == 1.0
    with pytest.raises(AttributeError):
        flows.nothing
    assert "geolife" in datasets.list_datasets(["trajectory"]) and datasets.get_dataset_info("geolife")["kind"] == "trajectory"
    with pytest.raises(KeyError):
        datasets.load_dataset(spark, "none", "/nowhere")
