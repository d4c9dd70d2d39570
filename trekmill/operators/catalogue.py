"""Catalogues of places: their scope and scheme, where they come from, and what they are checked for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid
from . import individual, sequence

#: What a catalogue may be.
SCOPES, SCHEMES = ("user", "global"), ("cluster", "h3", "external")
#: Names of the id and the centre that are looked for, in order.
ID_NAMES, LAT_NAMES, LNG_NAMES = ("location_id", "tile_id", "id"), ("lat", "center_lat", "latitude"), ("lng", "center_lng", "longitude", "lon")


class CatalogueError(ValueError):
    pass


@dataclass(frozen=True)
class Locations:
    """Places with location_id, lat and lng (and uid where scope is user)."""

    df: DataFrame
    scope: str = "global"
    scheme: str | None = None

    @classmethod
    def of(cls, df: DataFrame, scope: str | None = None, scheme: str | None = None, validate: bool = True) -> Locations:
        """scope: user where df has a uid, unless given."""
        scope = scope or ("user" if "uid" in df.columns else "global")
        if scope not in SCOPES or (scheme is not None and scheme not in SCHEMES):
            raise CatalogueError(f"scope is one of {SCOPES}, scheme one of {SCHEMES}")
        if "location_id" not in df.columns or (scope == "user" and "uid" not in df.columns):
            raise CatalogueError("no location_id" if "location_id" not in df.columns else "places of users need a uid")
        made = cls(df, scope, scheme)
        if validate and (faults := {k: v for k, v in made.faults().first().asDict().items() if v}):
            raise CatalogueError(f"faults of the catalogue: {faults}")
        return made

    def faults(self) -> DataFrame:
        """One row: null ids, ids that stand twice (by user, in a catalogue of users), and, of a global one, centres that are no coordinates."""
        keys = ["uid", "location_id"] if self.scope == "user" else ["location_id"]
        centre = valid(F.col("lat"), F.col("lng")) if {"lat", "lng"} <= set(self.df.columns) and self.scope == "global" else F.lit(True)
        counted = self.df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(centre, 0).otherwise(1)).alias("bad"))
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        zero = F.lit(0).cast("long")
        return counted.agg(F.coalesce(F.sum(F.when(null, F.col("n"))), zero).alias("null_ids"), F.coalesce(F.sum(F.when((F.col("n") > 1) & ~null, 1)), zero).alias("repeated_ids"), F.coalesce(F.sum("bad"), zero).alias("bad_centres"))

    @classmethod
    def from_tessellation(cls, tiles: DataFrame, scheme: str | None = "external", validate: bool = True) -> Locations:
        """A global catalogue from tiles: their id and centre by the usual names, or the mean of the corners of `rings`."""
        pick = lambda names: next((n for n in names if n in tiles.columns), None)
        key, lat, lng = pick(ID_NAMES), pick(LAT_NAMES), pick(LNG_NAMES)
        if key is None:
            raise CatalogueError(f"no id; tried {ID_NAMES}")
        renamed = tiles.withColumnRenamed(key, "location_id")
        if lat and lng:
            renamed = renamed.withColumnsRenamed({lat: "lat", lng: "lng"})
        elif "rings" in tiles.columns:
            centre = centroid("rings")
            renamed = renamed.withColumn("lat", centre["lat"]).withColumn("lng", centre["lng"])
        else:
            raise CatalogueError(f"no centre; tried {LAT_NAMES}, {LNG_NAMES} and rings")
        return cls.of(renamed, "global", scheme, validate)

    def require_global(self) -> Locations:
        """Itself, if its places are everyone's."""
        if self.scope != "global":
            raise CatalogueError("a global catalogue is needed")
        return self

    def model_input(self) -> DataFrame:
        """location_id, lat, lng and, where there are such columns, relevance and tot_outflow, as the flow models take them."""
        self.require_global()
        return self.df.select("location_id", *[F.col(c).cast("double").alias(c) for c in ("lat", "lng", "relevance", "tot_outflow") if c in self.df.columns])

    def identify(self, staypoints: DataFrame, **parameters) -> DataFrame:
        """home, work or other for each place of each user of staypoints that the catalogue has."""
        keys = ["uid", "location_id"] if self.scope == "user" else ["location_id"]
        return individual.identify_locations(staypoints, **parameters).join(self.df.select(*keys).distinct(), keys, "left_semi")

    def validate_staypoint_assignments(self, staypoints: DataFrame) -> DataFrame:
        """The stays whose place (of the user, in a catalogue of users) the catalogue does not have."""
        return (sequence.validate_user_locations if self.scope == "user" else sequence.validate_locations)(staypoints, self.df)

    def associate(self, staypoints: DataFrame, max_distance_m: float | None = None) -> DataFrame:
        """staypoints(lat, lng, ...) with location_id of the nearest place of a global catalogue (null beyond max_distance_m)."""
        from .near import nearest

        self.require_global()
        found = nearest(staypoints, self.df.select(F.col("location_id").alias("id"), "lat", "lng")).select("lat", "lng", F.col("id").alias("location_id"), "d")
        if max_distance_m is not None:
            found = found.where(F.col("d") * 1000 <= max_distance_m)
        return staypoints.drop("location_id").join(found.drop("d"), ["lat", "lng"], "left")

    def with_frame(self, df: DataFrame) -> Locations:
        return replace(self, df=df)


def centroid(rings: str):
    """Centre of gravity (lat, lng) of a polygon's outer ring, by the shoelace sums; the mean of its corners where it has no area."""
    parts = f"""transform(sequence(1, greatest(1, size({rings}[0]) - 1)), i -> named_struct(
        'c', {rings}[0][i - 1].lng * {rings}[0][i].lat - {rings}[0][i].lng * {rings}[0][i - 1].lat,
        'x', {rings}[0][i - 1].lng + {rings}[0][i].lng, 'y', {rings}[0][i - 1].lat + {rings}[0][i].lat))"""
    area = f"aggregate({parts}, 0D, (s, e) -> s + e.c)"
    one = lambda axis, name: f"coalesce(try_divide(aggregate({parts}, 0D, (s, e) -> s + e.c * e.{axis}), 3 * {area}), aggregate({rings}[0], 0D, (s, e) -> s + e.{name}) / size({rings}[0]))"
    return {"lng": F.expr(one("x", "lng")), "lat": F.expr(one("y", "lat"))}


def get_geom_centroid(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """polygons with lat and lng of their centres."""
    centre = centroid(rings)
    return polygons.withColumn("lat", centre["lat"]).withColumn("lng", centre["lng"])
