"""Typed tables whose methods are the operators: a DataFrame, and the operators that take it first.

Each method returns a DataFrame (or a frame where NEXT names one); nothing is changed in place.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import canonical
from .functions.geo import haversine, valid
from .operators import attacks, collective, contacts, hierarchy, individual, kernels, motion, near, next_place, privacy, sequence, visits, walks


class Frame:
    """df, and the operators named in METHODS as methods."""

    METHODS: dict = {}
    NEXT: dict = {}

    def __init__(self, df: DataFrame, **settings: object):
        self.df = df
        #: What is known of the table beside its rows, such as crs.
        self.settings = {"crs": "EPSG:4326", **settings}

    def __getattr__(self, name: str):
        if name not in type(self).METHODS:
            raise AttributeError(name)
        run, wrap = type(self).METHODS[name], type(self).NEXT.get(name, lambda: lambda df: df)()

        def method(*more, **parameters):
            return wrap(run(self.df, *(m.df if isinstance(m, Frame) else m for m in more), **parameters))

        method.__doc__ = run.__doc__
        return method

    def to_pandas(self):
        """The whole table on the driver; only where asked for."""
        return self.df.toPandas()

    def to_polars(self):
        """The whole table on the driver as a polars frame, where polars is installed."""
        try:
            import polars
        except ImportError as e:
            raise RuntimeError("polars is not installed") from e
        return polars.from_arrow(self.df.toArrow())

    def settings_from(self, other: Frame) -> Frame:
        """The same table with the settings (crs, parameters) of another."""
        made = copy(self)
        made.settings = dict(other.settings)
        return made

    def __dir__(self):
        return [*super().__dir__(), *type(self).METHODS]


def _of(module, *names: str) -> dict:
    return {n: getattr(module, n) for n in names}


class FlowDataFrame(Frame):
    """Flows between places: origin, destination, flow."""

    METHODS = _of(collective, "get_flow", "od_metrics_per_area", "common_part_of_commuters", "common_part_of_links", "compare_flow_models", "regression_metrics", "jensen_shannon", "wasserstein") | {"to_matrix": hierarchy.flow_matrix, "compare_to": hierarchy.compare_to}


    def get_geometry(self, tessellation: DataFrame, tile_id, key: str = "tile_id") -> DataFrame:
        """The row of a tile in the tessellation."""
        return tessellation.where(F.col(key) == F.lit(tile_id))


class Trips(Frame):
    """Trips: uid, trip_id, origin, destination (and lat, lng of both ends for distances)."""

    METHODS = {"generate_tours": walks.tours}

    def to_flow_dataframe(self, self_loops: bool = False) -> FlowDataFrame:
        """Trips counted by origin and destination."""
        ends = self.df.where("origin is not null and destination is not null")
        return FlowDataFrame((ends if self_loops else ends.where("origin != destination")).groupBy("origin", "destination").agg(F.count("*").cast("double").alias("flow")))

    def common_part_of_commuters(self, other: Trips) -> DataFrame:
        return collective.common_part_of_commuters(self.to_flow_dataframe().df, other.to_flow_dataframe().df)

    def common_part_of_links(self, other: Trips) -> DataFrame:
        return collective.common_part_of_links(self.to_flow_dataframe().df, other.to_flow_dataframe().df)

    def common_part_of_commuters_distance(self, other: Trips, width_km: float = 2.0) -> DataFrame:
        """Common part of the histograms of km between trips' ends (origin_lat, origin_lng, destination_lat, destination_lng), over the trips of the first."""
        km = haversine(*(F.col(c) for c in ("origin_lat", "origin_lng", "destination_lat", "destination_lng")))
        one, two = (t.df.where(km.isNotNull()).groupBy(F.floor(km / width_km).alias("bin")).agg(F.count("*").alias(n)) for t, n in ((self, "a"), (other, "b")))
        total = one.agg(F.sum("a").alias("all"))
        shared = one.join(two, "bin").agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("shared"))
        return shared.crossJoin(total).select(F.round(F.coalesce(F.try_divide("shared", "all"), F.lit(0.0)), 6).alias("cpc_distance"))


class Triplegs(Frame):
    """Moves: uid, tripleg_id, started_at, finished_at, length_km."""

    METHODS = _of(hierarchy, "predict_transport_mode", "modal_split", "modal_split_per_user")

    def generate_trips(self, staypoints: Frame | DataFrame) -> Trips:
        return Trips(hierarchy.trips(staypoints.df if isinstance(staypoints, Frame) else staypoints, self.df))


class Staypoints(Frame):
    """Visits: uid, location_id, purpose, started_at, finished_at."""

    METHODS = (
        {"validate": hierarchy.staypoints_validate, "create_activity_flag": individual.activity_flag, "generate_daily_motifs": visits.daily_motifs}
        | _of(individual, "regularity", "visit_purpose_distribution", "daily_activity_distribution", "activity_transitions", "identify_locations")
        | _of(collective, "mean_area_volume", "interest_network", "od_matrix", "trips_to_flows", "visits_per_location")
        | {"temporal_contacts": contacts.daily_contacts, "contact_network": contacts.contact_counts}
        | _of(sequence, "validate_locations", "validate_user_locations")
        | _of(visits, "trajectory_entropy", "diversity", "intermittency", "exploration_profiles", "compute_profiles")
        | _of(next_place, "context_counts", "predict_proba", "predict", "evaluate")
        | _of(attacks, "assess_risk")
        | _of(privacy, "location_risk", "unique_location_risk", "location_time_risk", "location_sequence_risk", "location_frequency_risk", "location_probability_risk", "location_proportion_risk", "home_work_risk")
        | {"build_stvd": hierarchy.stvd}
    )
    NEXT = {"trips_to_flows": lambda: FlowDataFrame}

    @classmethod
    def coerce(cls, value: Frame | DataFrame, **columns: str) -> Staypoints:
        """value as stays: itself where it is, else its table with the named columns renamed (name=column)."""
        if isinstance(value, cls) and not columns:
            return value
        df = value.df if isinstance(value, Frame) else value
        return cls(df.withColumnsRenamed({old: new for new, old in columns.items()}))

    def generate_daily_motifs_with(self, locations: DataFrame, home: str = "home") -> DataFrame:
        return visits.daily_motifs_from_staypoints(self.df, locations, home)


class TrajDataFrame(Frame):
    """Fixes: uid, datetime, lat, lng (and event_id as tie-break); columns of the usual other names are renamed."""

    METHODS = (
        _of(individual, "jump_lengths", "waiting_times", "distance_straight_line", "maximum_distance", "radius_of_gyration", "k_radius_of_gyration", "number_of_visits", "number_of_locations", "home_location", "work_location", "max_distance_from_home", "location_frequency", "frequency_rank", "recency_rank", "random_entropy", "uncorrelated_entropy", "individual_mobility_network")
        | _of(collective, "homes_per_location", "random_location_entropy", "uncorrelated_location_entropy", "mean_square_displacement", "visits_per_time_unit", "bounding_box")
        | _of(sequence, "filter_greedy", "filter_zheng", "segment_observation_gap", "segment_value_change", "segment_temporal", "trajectory_to_od", "trajectory_to_trips") | {"join_with_events": near.nearest_events}
        | _of(hierarchy, "timezone_conversion", "sort_by_uid_and_datetime", "to_flowdataframe", "global_locations", "interpolate_at", "interpolate_at_nearest")
        | _of(near, "join_with_pois", "join_with_pois_by_category", "mapping_points", "mapping_polygons", "snap_locations") | {"mapping": near.mapping_points}
        | _of(kernels, "filter_speed", "compress", "simplify_min_distance", "simplify_min_time")
        | _of(walks, "filter_hampel", "filter_smart_greedy", "simplify_douglas_peucker", "simplify_top_down_time_ratio", "simplify_max_distance", "stay_locations", "segment_angle_change", "segment_speed", "segment_stop", "smooth_kalman", "trajectory_predictability", "real_entropy")
        | _of(motion, "filter_loops", "interpolate", "simplify_chan_chin", "simplify_imai_iri", "triplegs", "cluster", "user_locations", "trajectory_distance", "shape_signatures", "cluster_trajectory_shapes")
    )
    NEXT = {"triplegs": lambda: Triplegs, "filter_speed": lambda: TrajDataFrame, "compress": lambda: TrajDataFrame}

    def __init__(self, df: DataFrame, sort: bool = False, crs: str = "EPSG:4326", **columns: str | None):
        """df with its columns under the usual names; a datetime in text is parsed, an epoch read in seconds; sort: in order within each user's rows."""
        named = canonical(df, **columns)
        kind = named.schema["datetime"].dataType.typeName()
        if kind == "string":
            named = named.withColumn("datetime", F.to_timestamp_ntz("datetime"))
        elif kind in ("long", "integer", "double"):
            named = named.withColumn("datetime", F.timestamp_seconds("datetime").cast("timestamp_ntz"))
        if "uid" not in named.columns:
            named = named.withColumn("uid", F.lit(1).cast("long"))
        if sort:
            named = named.repartition("uid").sortWithinPartitions("uid", "datetime")
        super().__init__(named, crs=crs)

    def to_geodataframe(self) -> DataFrame:
        """The table with geometry, each point as well-known text (lng lat)."""
        return self.df.withColumn("geometry", F.when(valid(F.col("lat"), F.col("lng")), F.concat_ws("", F.lit("POINT ("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))))


Positionfixes = TrajDataFrame
