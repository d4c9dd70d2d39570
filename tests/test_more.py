"""Next places, catalogues, attacks of any size, map matching, transport, shapes, fits and social agents, by answers known by hand."""

import datetime as dt
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from trekmill import frames
from trekmill.functions.components import components
from trekmill.operators import attacks, catalogue, collective, fitting, hierarchy, individual, match, models, motion, network, next_place, sequence, social, social_models, transport, visits, walks

T0 = dt.datetime(2024, 1, 1)


def stays(spark, rows):
    return spark.createDataFrame([(u, p, T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + 1)) for u, p, h in rows], "uid string, location_id long, started_at timestamp_ntz, finished_at timestamp_ntz")


def line(spark, rows):
    return spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m), i, a, b) for i, (u, m, a, b) in enumerate(rows)], "uid string, datetime timestamp_ntz, event_id long, lat double, lng double")


def test_next_places_of_a_cycle(spark):
    df = stays(spark, [("a", i % 3, i) for i in range(12)] + [("b", 5, 0)])
    got = {r["uid"]: r for r in next_place.predict_proba(df, order=1).collect()}
    assert (got["a"]["next_id"], got["a"]["probability"], got["a"]["context_length"]) == (0, 1.0, 1)
    assert (got["b"]["next_id"], got["b"]["context_length"]) == (5, 0)
    assert {r["uid"] for r in next_place.predict_proba(df, order=2, backoff=False).collect()} == {"a"}
    assert tuple(next_place.evaluate(df, order=1, n_holdout=3).first()) == (1.0, 3, 1)
    assert next_place.evaluate(df, n_holdout=99).first()["accuracy"] is None
    assert len(next_place.predict(df, order=0, top_k=3).where("uid = 'a'").collect()) == 3


def test_catalogues(spark):
    tiles = spark.createDataFrame([(1, 10.0, 20.0), (2, 11.0, 21.0)], "tile_id long, latitude double, longitude double")
    places = catalogue.Locations.from_tessellation(tiles)
    assert places.model_input().columns == ["location_id", "lat", "lng"] and places.require_global() is places
    with pytest.raises(catalogue.CatalogueError):
        catalogue.Locations.of(places.df.union(places.df))
    with pytest.raises(catalogue.CatalogueError):
        catalogue.Locations.of(places.df.withColumn("uid", places.df["location_id"])).require_global()
    seen = stays(spark, [("a", 1, 0), ("a", 99, 1), ("a", None, 2)])
    assert [r["location_id"] for r in places.validate_staypoint_assignments(seen).collect()] == [99]
    square = [[{"lng": x, "lat": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0))]]
    ring = spark.createDataFrame([(7, square)], "id long, rings array<array<struct<lng double, lat double>>>")
    r = catalogue.Locations.from_tessellation(ring).df.first()
    assert (r["location_id"], r["lat"], r["lng"]) == (7, 2.0, 1.0)


def test_attacks(spark):
    df = stays(spark, [(u, p, i) for u, ps in (("1", (1, 2, 1)), ("2", (1, 2, 3)), ("3", (1,))) for i, p in enumerate(ps)])
    risk = lambda *a, **k: {r["uid"]: r["risk"] for r in attacks.assess_risk(df, *a, **k).collect()}
    assert risk(2, "location") == {"1": 1.0, "2": 1.0, "3": pytest.approx(1 / 3, abs=1e-6)}
    assert risk(2, "unique_location") == {"1": 0.5, "2": 1.0, "3": pytest.approx(1 / 3, abs=1e-6)}
    assert risk(3, "location_sequence")["1"] == 1.0
    assert risk(1, "location", targets=df.where("uid = '2'").select("uid")) == {"2": 1.0}
    listed = attacks.assess_risk(df, 2, "unique_location", force_instances=True).where("uid = '2'").collect()
    assert {tuple(r["known"]): r["users"] for r in listed} == {("1", "2"): 2, ("1", "3"): 1, ("2", "3"): 1}
    with pytest.raises(ValueError, match="attack"):
        attacks.assess_risk(df, 2, "none")


def chain(spark):
    nodes = spark.createDataFrame([(i, 0.0, i * 0.001) for i in range(6)], "node long, lat double, lng double")
    edges = spark.createDataFrame([(a, b, 111.195, 10.0) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "source long, target long, length_m double, weight double")
    return nodes, edges


def test_map_matching(spark):
    nodes, edges = chain(spark)
    df = line(spark, [("a", i, 0.0001, 0.0005 + i * 0.001) for i in range(5)] + [("a", 200, 0.0, 0.0005), ("far", 0, 5.0, 5.0)])
    got = sorted(match.match_trajectory(df, nodes, edges).collect(), key=lambda r: r["event_id"])
    assert [(r["source"], r["target"]) for r in got[:5]] == [(i, i + 1) for i in range(5)] and [r["part"] for r in got] == [0] * 5 + [1]
    assert all(10 < r["distance_m"] < 12 and 0 < r["confidence"] <= 1 for r in got[:5]) and {r["uid"] for r in got} == {"a"}


def test_gyration_on_roads(spark):
    nodes, edges = chain(spark)
    df = line(spark, [("a", 0, 0.0, 0.0), ("a", 1, 0.0, 0.004)])
    got = network.RoadNetwork(edges).radius_of_gyration(df, nodes).first()
    assert got["radius_of_gyration"] == pytest.approx(2 * 0.111195, abs=1e-4)


def test_transport(spark):
    a = spark.createDataFrame([(0.0, 0.0, 3, 2.0)], "lat double, lng double, slot long, mean_volume double")
    b = spark.createDataFrame([(0.0, 0.01, 3, 5.0)], a.schema)
    later = spark.createDataFrame([(0.0, 0.0, 147, 1.0)], a.schema)  # a whole day later
    assert transport.stvd_emd(a, a) == pytest.approx(0, abs=1e-6)
    assert transport.stvd_emd(a, b) == pytest.approx(1111.95, abs=0.1)
    assert transport.stvd_emd(a, later) == pytest.approx(0, abs=1e-6)
    two = spark.createDataFrame([(0.0, 0.0, 3, 1.0), (0.0, 0.02, 3, 1.0)], a.schema)
    assert transport.stvd_emd(two, b) == pytest.approx(1111.95, abs=1.0)


def test_shapes_and_components(spark):
    straight = [(0.0, i * 0.01) for i in range(8)]
    bent = [(0.0, i * 0.01) for i in range(4)] + [(i * 0.01, 0.03) for i in range(1, 5)]
    rows = [(u, i, a + s, b) for u, s, path in (("a", 0, straight), ("b", 1.0, straight), ("c", 0, bent), ("d", 0.5, bent), ("e", 0, [(0.0, 0.0), (0.0, 0.05), (0.0, 0.0), (0.0, 0.05), (0.0, 0.0), (0.0, 0.05), (0.0, 0.0), (0.0, 0.05)])) for i, (a, b) in enumerate(path)]
    got = {r["uid"]: r["cluster"] for r in motion.cluster_trajectory_shapes(line(spark, rows)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1, "e": -1}
    nodes = spark.range(12).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(10, 11)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(nodes, edges).collect()} == {**dict.fromkeys(range(9), 0), 9: 9, 10: 10, 11: 10}


def test_distribution_fit(spark):
    x = np.random.default_rng(1).exponential(5.0, 5000)
    df = spark.createDataFrame([(float(v),) for v in x], "d double")
    fit = fitting.DistributionFit.fit(df, "d", "exponential")
    assert fit.parameters["kappa"] == pytest.approx(5, rel=0.1)
    grid = np.linspace(fit.edges[0], fit.edges[-1], 20_000)
    assert np.trapezoid(fit.pdf(grid), grid) == pytest.approx(1, abs=0.02) and (np.diff(fit.cdf(grid)) >= 0).all()
    low, high = fit.profile("kappa")
    assert low < fit.parameters["kappa"] < high and high - low < 1
    assert fitting.chi_square_bound(0.95) == pytest.approx(3.8415, abs=1e-3)
    test = fitting.likelihood_ratio_test(df, "d", "exponential", "powerlaw")
    assert test["z"] > 0 and test["p"] < 0.01
    assert fitting.select_xmin(df, "d", "exponential", n_candidates=5)["n"] >= 100
    with pytest.raises(ValueError, match="beyond"):
        fitting.select_xmin(df, "d", "exponential", min_values=10**6)


def test_social_agents(spark):
    places = spark.createDataFrame([(i, i * 0.1, 0.0, 1.0 + i) for i in range(6)], "location_id long, lat double, lng double, relevance double")
    end = T0 + dt.timedelta(days=4)
    runs = [social_models.geosim(places, T0, end, n_agents=8, seed=s).collect() for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2] and all(T0 <= r["datetime"] < end for r in runs[0]) and {r["uid"] for r in runs[0]} == set(range(8))
    diary = models.MarkovDiary(np.ones((48, 48)))
    assert {r["uid"] for r in social_models.sts_epr(places, diary, T0, end, social_graph=[(0, 1)], n_agents=3, rsl=True).collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="agents"):
        social_models.geosim(places, T0, end, n_agents=10**9)


def test_profiles_entropy_and_motifs(spark):
    rows = [(u, p, i) for u, ps in (("r", [1, 1, 1, 2, 1, 1, 1, 2]), ("s", [1, 2, 3, 4, 5, 6, 7, 8]), ("m", [1, 2, 1, 3, 1, 2, 1, 4])) for i, p in enumerate(ps)]
    got = visits.compute_profiles(stays(spark, rows).selectExpr("*", "'x' AS purpose"))
    assert {r["profile"] for r in got.collect()} == set(visits.PROFILES) and got.where("uid = 's'").first()["stationarity"] == 0.125
    one = line(spark, [("a", 0, 1.0, 1.0), ("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0), ("b", 2, 1.0, 1.0)])
    assert {r["uid"]: r["real_entropy"] for r in walks.real_entropy(one).collect()}["a"] == 0.0
    homes = spark.createDataFrame([("a", 1, "home"), ("a", 2, "work")], "uid string, location_id long, purpose string")
    day = stays(spark, [("a", 1, 0), ("a", 2, 9), ("a", 1, 20)])
    assert visits.daily_motifs_from_staypoints(day, homes).count() == 1


def test_defaults_and_ties(spark):
    df = line(spark, [("a", 0, 0.0, 0.0), ("a", 10, 0.0, 0.1), ("a", 20, 0.0, 0.0)])
    assert sequence.filter_greedy(df.selectExpr("*", "1 AS place")).count() == 3  # 67 km/h is below 100
    assert [r["segment_id"] for r in sequence.segment_observation_gap(df.selectExpr("*", "1 AS place")).orderBy("event_id").collect()] == [0, 0, 0]
    seen = stays(spark, [("a", 1, 0)])
    assert individual.activity_flag(seen).first()["activity"]
    # Two places seen last at one time: the later event decides, not the larger id of an older visit.
    rows = [("a", 0, 9, 1.0, 1.0), ("a", 5, 1, 1.0, 1.0), ("a", 5, 2, 2.0, 2.0)]
    tied = spark.createDataFrame([(u, T0 + dt.timedelta(minutes=m), e, a, b) for u, m, e, a, b in rows], "uid string, datetime timestamp_ntz, event_id long, lat double, lng double")
    assert {r["lat"]: r["recency_rank"] for r in individual.recency_rank(tied).collect()} == {2.0: 1, 1.0: 2}
    flows = spark.createDataFrame([(1, 50, 2.0)], "origin long, destination long, flow double")
    assert social.graph_from_edges(flows).count() == 1 and social.graph_from_edges(flows, node_count=20).count() == 0
    with pytest.raises(TypeError, match="needs"):
        collective.get_flow(flows)
    assert collective.common_part_of_distance(df, df).first()["cpc_distance"] == 1.0 and collective.common_part_of_distance(df, df.where("false")).first()["cpc_distance"] == 0.0
    known = spark.createDataFrame([(99, 0.0, 0.0)], "location_id long, lat double, lng double")
    assert sequence.validate_locations(stays(spark, [("a", 99, 0)]), known).count() == 0


def test_clustering_by_day(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "c", "a"), (2, "c", "d"), (3, "a", "b")], "day long, u string, v string")
    got = {r["day"]: (r["nodes"], r["clustering"]) for r in social.clustering_by_day(edges).collect()}
    # Up to day 2: a and b are closed, c has one of three pairs, d has one neighbour.
    assert got == {1: (3, 0.0), 2: (4, pytest.approx((1 + 1 + 1 / 3) / 4, abs=1e-6)), 3: (4, pytest.approx((1 + 1 + 1 / 3) / 4, abs=1e-6))}
    assert social.mean_clustering(edges.drop("day").where("false")).first()["clustering"] is None


def test_frames(spark):
    t = frames.TrajDataFrame(spark.createDataFrame([("2024-01-01 10:00:00", 1.0, 2.0), ("2024-01-01 11:00:00", None, 2.0)], "time string, latitude double, lon double"), sort=True)
    assert dict(t.df.dtypes)["datetime"] == "timestamp_ntz" and [r["geometry"] for r in t.to_geodataframe().orderBy("datetime").collect()] == ["POINT (2.0 1.0)", None]
    assert t.settings_from(frames.TrajDataFrame(t.df, crs="EPSG:3857")).settings["crs"] == "EPSG:3857" and len(t.to_pandas()) == 2
    trips = frames.Trips(spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 2, 1), ("a", 3, 3, 3)], "uid string, trip_id long, origin long, destination long"))
    assert trips.common_part_of_commuters(trips).first()["cpc"] == 1.0 and trips.common_part_of_links(trips).first()["cpl"] == 1.0
    assert trips.generate_tours().first()["journey"] == [1, 2]
    ends = frames.Trips(spark.createDataFrame([(0.0, 0.0, 0.0, 0.1), (0.0, 0.0, 0.0, None)], "origin_lat double, origin_lng double, destination_lat double, destination_lng double"))
    assert ends.common_part_of_commuters_distance(ends).first()["cpc_distance"] == 1.0
    wrapped = frames.Staypoints.coerce(t.df.withColumnRenamed("uid", "who"), uid="who")
    assert "uid" in wrapped.df.columns and frames.Staypoints.coerce(wrapped) is wrapped
    points = line(spark, [("a", 0, 0.0, 0.0), ("a", 1, 0.01, 300.0), ("a", 2, 0.02, 0.02)])
    assert hierarchy.tilers.create("squared", points, metres="2000e0").select("tile_id").distinct().count() == hierarchy.tilers.get("squared", points, metres="2000e0").count()
    with pytest.raises(ValueError, match="no tiler"):
        hierarchy.tilers.create("none")


def test_plans(spark):
    """Contacts meet in quarters of an hour, points in cells; row-level windows are all by user."""
    seen = stays(spark, [("a", 1, 0), ("b", 1, 0)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "q#" in plan(sequence.temporal_contacts(seen)) and "Join Inner" in plan(sequence.temporal_contacts(seen))
    assert [tuple(r) for r in sequence.temporal_contacts(seen).collect()] == [(19723, "a", "b")]
    one = individual.radius_of_gyration(line(spark, [("a", 0, 0.0, 0.0)]))
    assert "Window" not in plan(one)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without the operators, the pipeline and their tests still imports and keeps its queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "trekmill", tmp_path / "trekmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op1_language_id' not in q and len(q) > 140 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
