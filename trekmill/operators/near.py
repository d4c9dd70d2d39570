"""Nearest points by grid joins: points meet those of the cells about them, in ever coarser grids.

A point is settled in a grid as soon as what it found is nearer than anything beyond the
neighbouring cells can be, so only points far from all others reach the coarse grids.
No join crosses all points with all others but that of the last grid, of four cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine, valid
from .kernels import _km

#: Cell sizes in degrees; each divides 360.
GRIDS = (0.01, 0.05, 0.25, 1.25, 10.0, 90.0)


def _cells(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    return F.floor((lat + 90) / size).cast("long"), F.pmod(F.floor((lng + 180) / size).cast("long"), F.lit(round(360 / size)))


def nearest(points: DataFrame, others: DataFrame, by: str | None = None, planar: bool = False) -> DataFrame:
    """lat, lng, id, d (and by) of the nearest of others(id, lat, lng) to each distinct coordinate of points; ties go to the smaller id.

    by: a column of others; the nearest of each of its values is found. planar: d is the square
    of the distance in degrees and not km; longitudes then do not wrap.
    """
    kinds = others.select(by).distinct() if by else None
    left = points.where(valid(F.col("lat"), F.col("lng"))).select("lat", "lng").distinct()
    if by:
        left = left.crossJoin(F.broadcast(kinds))  # few kinds: one row a category
    known = others.where(valid(F.col("lat"), F.col("lng"))).select(F.col("id"), F.col("lat").alias("olat"), F.col("lng").alias("olng"), *([by] if by else []))
    keys = ["lat", "lng", *([by] if by else [])]
    done = []
    for size in GRIDS:
        row, column = _cells(F.col("olat"), F.col("olng"), size)
        cells = known.withColumn("row", row).withColumn("column", column)
        row, column = _cells(F.col("lat"), F.col("lng"), size)
        n = round(360 / size)
        last = size == GRIDS[-1]
        steps = F.sequence(F.lit(-2 if last else -1), F.lit(2 if last else 1))
        asked = left.withColumn("row", F.explode(F.transform(steps, lambda i: row + i))).withColumn("column", F.explode(F.array_distinct(F.transform(steps, lambda i: F.pmod(column + i, F.lit(n))))))
        d = (F.col("lat") - F.col("olat")) ** 2 + (F.col("lng") - F.col("olng")) ** 2 if planar else haversine(F.col("lat"), F.col("lng"), F.col("olat"), F.col("olng"))
        met = asked.join(cells, ["row", "column", *([by] if by else [])]).withColumn("d", d)
        best = met.groupBy(*keys).agg(F.min(F.struct(F.round("d", 9).alias("r"), "id", "d")).alias("best"))
        # Beyond the neighbouring cells: a cell's size away in latitude, or across a meridian as far.
        beyond = F.lit(size * size) if planar else EARTH_KM * F.least(F.lit(size).cast("double") * 3.141592653589793 / 180, F.asin(F.greatest(F.lit(0.0), F.cos(F.radians("lat"))) * F.sin(F.radians(F.lit(min(size, 89.0))))))
        found = left.join(best, keys, "left").withColumn("settled", F.lit(True) if last else F.coalesce(F.col("best.d") <= beyond - 1e-9, F.lit(False))).persist()
        done.append(found.where("settled and best is not null").select(*keys, F.col("best.id").alias("id"), F.col("best.d").alias("d")))
        left = found.where("not settled").select(*keys)
        if last or left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def join_with_pois(fixes: DataFrame, pois: DataFrame) -> DataFrame:
    """Nearest point of interest of each distinct coordinate (ties: smaller id); join back on the coordinate."""
    return nearest(fixes, pois).select("lat", "lng", F.col("id").alias("poi_id"), F.round("d", 6).alias("dist_poi"))


def join_with_pois_by_category(fixes: DataFrame, pois: DataFrame) -> DataFrame:
    """The same once per category (long form)."""
    return nearest(fixes, pois, by="category").select("lat", "lng", "category", F.col("id").alias("poi_id"), F.round("d", 6).alias("dist_poi"))


def mapping_points(fixes: DataFrame, pois: DataFrame) -> DataFrame:
    """Nearest point of a point tessellation by squared degrees; join back on the coordinate."""
    return nearest(fixes, pois, planar=True).select("lat", "lng", F.col("id").alias("tile_id"))


def snap_locations(fixes: DataFrame, pois: DataFrame, max_distance_m: float = 750.0) -> DataFrame:
    """Nearest node within max_distance_m of each coordinate, else -1."""
    return nearest(fixes, pois).select("lat", "lng", F.when(F.col("d") * 1000 <= max_distance_m, F.col("id")).otherwise(F.lit(-1)).alias("node"))


#: Edges of all rings that a ray to the east of (lat, lng) crosses; odd within a polygon, also one with holes.
_CROSSED = """aggregate(rings, 0, (n, ring) -> n + size(filter(sequence(1, greatest(1, size(ring) - 1)), i -> i < size(ring)
    AND (ring[i - 1].lat > lat) != (ring[i].lat > lat)
    AND lng < (ring[i].lng - ring[i - 1].lng) * try_divide(lat - ring[i - 1].lat, ring[i].lat - ring[i - 1].lat) + ring[i - 1].lng)))"""


def mapping_polygons(fixes: DataFrame, tiles: DataFrame, degrees: float = 0.05) -> DataFrame:
    """lat, lng, tile_id of each distinct coordinate within tiles(tile_id, rings); rings: array<array<struct<lng, lat>>>, the first point again at the end.

    Tiles are listed in the grid cells of their bounding boxes, so a point meets only tiles
    that may hold it. Of tiles that overlap the smaller id stays; points outside all are left out.
    """
    points = F.flatten("rings")
    lngs, lats = F.transform(points, lambda p: p["lng"]), F.transform(points, lambda p: p["lat"])
    box = tiles.select("tile_id", "rings", F.array_min(lngs).alias("x0"), F.array_max(lngs).alias("x1"), F.array_min(lats).alias("y0"), F.array_max(lats).alias("y1"))
    cell = lambda c: F.floor(c / degrees).cast("long")
    listed = box.withColumn("row", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1"))))).withColumn("column", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    asked = fixes.where(valid(F.col("lat"), F.col("lng"))).select("lat", "lng").distinct().withColumn("row", cell(F.col("lat"))).withColumn("column", cell(F.col("lng")))
    met = asked.join(listed, ["row", "column"]).where(F.expr(f"{_CROSSED} % 2 = 1"))
    return met.groupBy("lat", "lng").agg(F.min("tile_id").alias("tile_id"))


def nearest_events(fixes: DataFrame, window_s: int = 900) -> DataFrame:
    """event_id, other_id, dist_event: the rows of sequence.join_with_events, for any number of fixes at one time. event_id is a fix's own.

    A task holds the fixes of a time and its two neighbours, put in order by coordinate and time. The coordinates there are
    asked in order of distance: at each, the earliest fix of another user in the window is found by a search, so fixes that
    share a coordinate are not compared with one another.
    """
    rows = fixes.where(valid(F.col("lat"), F.col("lng")) & F.col("datetime").isNotNull() & F.col("uid").isNotNull())
    rows = rows.select("uid", "event_id", "lat", "lng", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', datetime)").alias("us"))
    own = F.floor(F.col("us") / (window_s * 1e6)).cast("long")
    rows = rows.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("at", own + F.col("step"))
    reach = round(window_s * 1_000_000)

    def run(table: pa.Table) -> pa.Table:
        uid = pc.dictionary_encode(table["uid"].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        event, lat, lng, us, step = (table[c].to_numpy() for c in ("event_id", "lat", "lng", "us", "step"))
        places, place = np.unique(np.column_stack([lat, lng]) + 0.0, axis=0, return_inverse=True)
        place, us = place.ravel(), us - us.min()
        order = np.lexsort((event, us, place))
        uid, event, us, step, place = (c[order] for c in (uid, event, us, step, place))
        span = int(us.max()) + 2 * reach + 2
        line = place * span + us + reach
        run_ends = np.flatnonzero(np.r_[(np.diff(uid) != 0) | (np.diff(place) != 0), True])
        other = run_ends[np.searchsorted(run_ends, np.arange(len(line)))] + 1  # the next fix that is another user's or elsewhere
        first = np.searchsorted(place, np.arange(len(places) + 1))
        found, far = np.full(len(line), -1), np.zeros(len(line))
        for here in range(len(places)):
            asked = first[here] + np.flatnonzero(step[first[here] : first[here + 1]] == 0)
            if not len(asked):
                continue
            km = _km(places[here, 0], places[here, 1], places[:, 0], places[:, 1])
            key = np.round(km, 9)
            near, i = np.argsort(key, kind="stable"), 0
            while len(asked) and i < len(near):
                j = i
                best = np.full(len(asked), -1)
                while j < len(near) and key[near[j]] == key[near[i]]:
                    base = near[j] * span + us[asked] + reach
                    p = np.searchsorted(line, base - reach)
                    p = np.where((p < len(line)) & (uid[np.minimum(p, len(line) - 1)] == uid[asked]) & (place[np.minimum(p, len(line) - 1)] == near[j]), other[np.minimum(p, len(line) - 1)], p)
                    q = np.minimum(p, len(line) - 1)
                    fits = (p < len(line)) & (place[q] == near[j]) & (line[q] <= base + reach)
                    held = np.maximum(best, 0)
                    fits &= (best < 0) | (us[q] < us[held]) | ((us[q] == us[held]) & (event[q] < event[held]))
                    best[fits] = q[fits]
                    far[asked[fits]] = km[near[j]]
                    j += 1
                found[asked] = best
                asked, i = asked[best < 0], j
        met = np.flatnonzero(found >= 0)
        return pa.table({"event_id": pa.array(event[met]), "other_id": pa.array(event[found[met]]), "d": pa.array(far[met])})

    return rows.groupBy("at").applyInArrow(run, "event_id bigint, other_id bigint, d double").select("event_id", "other_id", F.round("d", 6).alias("dist_event"))
