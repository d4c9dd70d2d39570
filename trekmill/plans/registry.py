"""All queries of the mobility operators, and the SQL that DuckDB holds them against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.portable import SqlOperator
from ..operators import attacks, catalogue, collective, contacts, fitting, hierarchy, individual, kernels, match, models, motion, near, network, next_place, privacy, sequence, social, social_models, transport, visits, walks
from . import oracles
from .views import VIEWS, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Parameters that suit the driver's tables, where fixes of a user are days apart and places few.
SETTINGS = {
    "filter_greedy": {"max_speed_kmh": "0.05e0"},
    "filter_zheng": {"max_speed_kmh": "0.05e0"},
    "segment_observation_gap": {"gap_s": 36000},
    "activity_flag": {"minutes": 60},
    "mean_square_displacement": {"minutes": 14400},
    "graph_from_edges": {"node_count": 20},
    "get_flow": {"origin": 1, "destination": 2},
}


def _query(op: SqlOperator) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*(view(spark, sf_dir, n) for n in op.inputs), **SETTINGS.get(op.__name__, {}))


for module in (individual, collective, sequence, hierarchy, privacy, social):
    for op in vars(module).values():
        if isinstance(op, SqlOperator):
            QUERIES[op.__name__] = _query(op)
            ORACLES[op.__name__] = op.oracle(VIEWS, **SETTINGS.get(op.__name__, {}))


def _kernel(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(view(spark, sf_dir, "fixes"))


def _visits(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(view(spark, sf_dir, "visits"))


def _neighbours(fixes: DataFrame) -> DataFrame:
    """Pairs of users with consecutive ids."""
    ids = fixes.select("uid").distinct()
    return ids.select(F.col("uid").alias("a"), (F.col("uid") + 1).alias("b"))


def _gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = sequence.trajectory_to_od(view(spark, sf_dir, "fixes"))
    return spark.createDataFrame([models.gravity_fit(flows, view(spark, sf_dir, "places"))])


def _agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.epr(view(spark, sf_dir, "places"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15), n_agents=50)


def _diaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    diary = models.MarkovDiary.fit(view(spark, sf_dir, "fixes"))
    return models.ditras(view(spark, sf_dir, "places"), diary, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15), n_agents=50)


def _network(spark: SparkSession, sf_dir: str) -> tuple[network.RoadNetwork, DataFrame]:
    """A network of the trips between places, and the trips as demand."""
    od = sequence.trajectory_to_od(view(spark, sf_dir, "fixes")).selectExpr("origin AS source", "destination AS target", "flow")
    return network.RoadNetwork(od.selectExpr("source", "target", "100.0 * abs(source - target) AS length_m", "double(1 + (source * target) % 7) AS weight")), od


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads, od = _network(spark, sf_dir)
    return roads.distances(od)


def _desire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads, od = _network(spark, sf_dir)
    return roads.desire_lines(od)


def _points(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(view(spark, sf_dir, "fixes"), view(spark, sf_dir, "pois"))


def _streets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes at the places, and two-way edges between places of near ids."""
    nodes = view(spark, sf_dir, "places").select(F.col("location_id").alias("node"), "lat", "lng")
    a, b = (nodes.select(*[F.col(c).alias(f"{c}{s}") for c in nodes.columns]) for s in "12")
    metres = 1000 * haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    edges = a.join(b, (F.abs(F.col("node1") - F.col("node2")) <= 3) & (F.col("node1") != F.col("node2"))).select(F.col("node1").alias("source"), F.col("node2").alias("target"), metres.alias("length_m"), metres.alias("weight"))
    return nodes, edges


def _road_gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _streets(spark, sf_dir)
    return network.RoadNetwork(edges).radius_of_gyration(view(spark, sf_dir, "fixes"), nodes)


def _road_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _streets(spark, sf_dir)
    fixes = view(spark, sf_dir, "fixes")
    at = near.nearest(fixes, nodes.withColumnRenamed("node", "id")).select("lat", "lng", F.col("id").alias("node"))
    straight = individual.jump_lengths(fixes).withColumnRenamed("jump_length", "straight_km").drop("uid")
    rows = fixes.join(at, ["lat", "lng"], "left").join(straight, "event_id", "left").select("uid", "event_id", "datetime", F.coalesce("node", F.lit(-1)).alias("node"), F.coalesce("straight_km", F.lit(0.0)).alias("straight_km"))
    return network.RoadNetwork(edges).jump_lengths(rows, nodes)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _streets(spark, sf_dir)
    return match.match_trajectory(view(spark, sf_dir, "fixes"), nodes, edges, gap_seconds=1e9)


def _volumes_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hierarchy.stvd(view(spark, sf_dir, "visits"), view(spark, sf_dir, "places"))
    early, late = got.where("slot < 72"), got.where("slot >= 72")
    return spark.createDataFrame([(round(transport.stvd_emd(early, late), 3),)], "metres double")


def _fit_row(spark: SparkSession, fit: dict) -> DataFrame:
    return spark.createDataFrame([fit])


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of a hundredth of a degree about every other place as polygons, and the fixes in them."""
    corner = lambda x, y: F.struct((F.col("lng") + x).alias("lng"), (F.col("lat") + y).alias("lat"))
    ring = F.array(*[corner(x, y) for x, y in ((-0.005, -0.005), (0.005, -0.005), (0.005, 0.005), (-0.005, 0.005), (-0.005, -0.005))])
    tiles = view(spark, sf_dir, "catalogue").select(F.col("location_id").alias("tile_id"), F.array(ring).alias("rings"))
    return near.mapping_polygons(view(spark, sf_dir, "other_fixes"), tiles)


QUERIES |= {
    **{f.__name__: _points(f) for f in (near.join_with_pois, near.join_with_pois_by_category, near.mapping_points, near.snap_locations)},
    "next_place_counts": _visits(lambda v: next_place.context_counts(v, order=2).withColumn("context", F.concat_ws(",", F.transform("context", lambda x: x.cast("string"))))),
    "next_place_proba": _visits(lambda v: next_place.predict_proba(v, order=2, top_k=3)),
    "next_place_evaluation": _visits(lambda v: next_place.evaluate(v, order=2, top_k=3, n_holdout=2)),
    "locations_from_tessellation": lambda spark, sf_dir: catalogue.Locations.from_tessellation(view(spark, sf_dir, "pois")).model_input(),
    "locations_faults": lambda spark, sf_dir: catalogue.Locations.of(view(spark, sf_dir, "catalogue"), validate=False).faults(),
    "locations_identify": lambda spark, sf_dir: catalogue.Locations.of(view(spark, sf_dir, "catalogue")).identify(view(spark, sf_dir, "visits")),
    "associate_locations": lambda spark, sf_dir: catalogue.Locations.of(view(spark, sf_dir, "catalogue")).associate(view(spark, sf_dir, "other_fixes").select("event_id", "lat", "lng"), max_distance_m=600.0).select("event_id", "location_id"),
    **{f"assess_risk_{a}": _visits(lambda v, a=a: attacks.assess_risk(v, 2, a)) for a in (*attacks.CONTAINED, *attacks.VALUED)},
    "assess_risk_instances": _visits(lambda v: attacks.assess_risk(v, 1, "unique_location", force_instances=True).withColumn("known", F.concat_ws(",", "known"))),
    "assess_risk_three": _visits(lambda v: attacks.assess_risk(v, 3, "unique_location")),
    "real_entropy": _kernel(walks.real_entropy),
    "compute_profiles": _visits(visits.compute_profiles),
    "daily_motifs_from_staypoints": lambda spark, sf_dir: visits.daily_motifs_from_staypoints(view(spark, sf_dir, "visits"), individual.identify_locations(view(spark, sf_dir, "visits"))),
    "cluster_trajectory_shapes": _kernel(lambda f: motion.cluster_trajectory_shapes(f, epsilon=0.3)),
    "cluster_trajectory_shapes_from_segments": _kernel(lambda f: motion.cluster_trajectory_shapes_from_segments(f.join(sequence.segment_temporal(f, unit="week"), ["uid", "event_id"]), depth=2, epsilon=0.2)),
    "radius_of_gyration_road": _road_gyration,
    "match_trajectory": _matched,
    "geosim": lambda spark, sf_dir: social_models.geosim(view(spark, sf_dir, "places"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8), n_agents=40),
    "sts_epr": lambda spark, sf_dir: social_models.sts_epr(view(spark, sf_dir, "places"), models.MarkovDiary.fit(view(spark, sf_dir, "fixes")), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8), n_agents=40),
    "stvd_emd": _volumes_apart,
    "select_xmin": lambda spark, sf_dir: _fit_row(spark, fitting.select_xmin(individual.jump_lengths(view(spark, sf_dir, "fixes")), "jump_length", "exponential", n_candidates=8)),
    "likelihood_ratio_test": lambda spark, sf_dir: spark.createDataFrame([fitting.likelihood_ratio_test(individual.jump_lengths(view(spark, sf_dir, "fixes")), "jump_length", "exponential", "lognormal")]),
    "distance_fit_summary": lambda spark, sf_dir: fitting.DistributionFit.fit(individual.jump_lengths(view(spark, sf_dir, "fixes")), "jump_length", "exponential").summary(spark),
    "mapping_polygons": _tiles,
    "validate_recast": lambda spark, sf_dir: social.validate_recast(view(spark, sf_dir, "visits"))["distribution"],
    "clustering_by_day": lambda spark, sf_dir: social.validate_recast(view(spark, sf_dir, "visits"))["clustering"],
    "random_daily_graphs": lambda spark, sf_dir: social.random_daily_graphs(sequence.temporal_contacts(view(spark, sf_dir, "visits")), replicates=2),
    "mean_clustering": _visits(social.mean_clustering_of_stays),
    "clustering_coefficients": _visits(social.clustering_of_stays),
    "topological_overlap": _visits(social.overlap_of_stays),
    "origin_indicators": lambda spark, sf_dir: models.origin_indicators(view(spark, sf_dir, "flows"), view(spark, sf_dir, "flows").select(F.col("origin").alias("location_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng")).distinct()).select("origin", "destination", "at"),
    "jump_lengths_road": _road_jumps,
    "gravity_fit": _gravity,
    "epr": _agents,
    "ditras": _diaries,
    "network_distances": _routes,
    "desire_lines": _desire_lines,
    "compare_distance_distributions": lambda spark, sf_dir: fitting.compare_distance_distributions(individual.jump_lengths(view(spark, sf_dir, "fixes")), "jump_length"),
    "filter_speed": _kernel(lambda f: kernels.filter_speed(f, max_speed_kmh=0.05)),
    "compress": _kernel(lambda f: kernels.compress(f, spatial_radius_km=1.0)),
    "simplify_min_distance": _kernel(lambda f: kernels.simplify_min_distance(f, min_distance_km=1.0)),
    "simplify_min_time": _kernel(lambda f: kernels.simplify_min_time(f, min_time_delta_s=36000.0)),
    "filter_hampel": _kernel(walks.filter_hampel),
    "filter_smart_greedy": _kernel(lambda f: walks.filter_smart_greedy(f, max_speed_kmh=0.05)),
    "simplify_douglas_peucker": _kernel(lambda f: walks.simplify_douglas_peucker(f, epsilon_km=1.0)),
    "simplify_top_down_time_ratio": _kernel(lambda f: walks.simplify_top_down_time_ratio(f, epsilon_km=1.0)),
    "simplify_max_distance": _kernel(lambda f: walks.simplify_max_distance(f, epsilon_km=1.0)),
    "stay_locations": _kernel(walks.stay_locations),
    "segment_angle_change": _kernel(walks.segment_angle_change),
    "segment_speed": _kernel(lambda f: walks.segment_speed(f, speed_kmh=0.05)),
    "segment_stop": _kernel(walks.segment_stop),
    "smooth_kalman": _kernel(walks.smooth_kalman),
    "trajectory_predictability": _kernel(walks.trajectory_predictability),
    "filter_loops": _kernel(lambda f: motion.filter_loops(f, max_speed_kmh=5.0, speed_kmh=0.05)),
    **{f"interpolate_{m}": _kernel(lambda f, m=m: motion.interpolate(f, m)) for m in ("cubic", "kinematic", "random_walk")},
    "simplify_chan_chin": _kernel(lambda f: motion.simplify_chan_chin(f, epsilon_km=1.0)),
    "simplify_imai_iri": _kernel(lambda f: motion.simplify_imai_iri(f, epsilon_km=1.0)),
    "triplegs": _kernel(motion.triplegs),
    "cluster": _kernel(motion.cluster),
    "user_locations": _kernel(motion.user_locations),
    "shape_signatures": _kernel(motion.shape_signatures),
    **{f"trajectory_distance_{m}": _kernel(lambda f, m=m: motion.trajectory_distance(f, _neighbours(f), m)) for m in ("dtw", "frechet", "hausdorff", "lcss")},
    "trajectory_entropy": _visits(visits.trajectory_entropy),
    "diversity": _visits(visits.diversity),
    "daily_motifs": _visits(lambda v: visits.daily_motifs(v, home="click")),
    "motif_distribution": _visits(lambda v: visits.motif_distribution(visits.daily_motifs(v, home="click"))),
    "intermittency": _visits(visits.intermittency),
    "exploration_profiles": _visits(visits.exploration_profiles),
    "join_with_events": _kernel(near.nearest_events),
    "temporal_contacts": _visits(contacts.daily_contacts),
    "contact_network": _visits(contacts.contact_counts),
    "recast": lambda spark, sf_dir: social.recast(view(spark, sf_dir, "visits")),
    "tours": lambda spark, sf_dir: walks.tours(sequence.trajectory_to_trips(view(spark, sf_dir, "fixes"))),
}

ORACLES |= {name: oracles.oracle(name) for name in oracles.TEXTS if name in QUERIES}
# Two ways to one answer: combinations of any size, and the SQL of those of two.
ORACLES |= {f"assess_risk_{a}": ORACLES[f"{a}_risk"] for a in (*attacks.CONTAINED, *attacks.VALUED)}
