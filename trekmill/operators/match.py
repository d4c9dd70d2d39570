"""Map matching: the likeliest line of road edges behind a user's fixes, by a hidden Markov model.

Candidates come from a grid join of fixes with the cells that edges pass, so no fix meets
all edges. What a user's walk needs (fixes with their candidates, and routed distances
between candidates that follow one another) is gathered by joins; only the walk itself,
one pass over a user's candidates, runs in a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .network import RoadNetwork

_METRES = 111_194.9266


def _candidates(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float = 75.0, most: int = 8) -> DataFrame:
    """lat, lng of fixes with edges (source, target) within radius_m: distance_m and the share of the edge before the nearest point; at most `most` a coordinate, the nearest."""
    cell = 2 * radius_m / _METRES
    a, b = (nodes.select(F.col("node").alias(e), F.col("lat").alias(f"lat_{p}"), F.col("lng").alias(f"lng_{p}")) for e, p in (("source", "a"), ("target", "b")))
    # Cells are wider in longitude where meridians are close, so that a cell's neighbours hold the radius.
    column = lambda lng, lat: F.floor(lng * F.cos(F.radians(F.round(lat))) / cell).cast("long")
    line = edges.select("source", "target").distinct().join(a, "source").join(b, "target")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat_b") - F.col("lat_a")), F.abs(F.col("lng_b") - F.col("lng_a"))) / cell)).cast("int")
    steps = line.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    lat, lng = (F.col(f"{c}_a") + (F.col(f"{c}_b") - F.col(f"{c}_a")) * F.col("i") / F.col("n") for c in ("lat", "lng"))
    passed = steps.withColumn("plat", lat).withColumn("plng", lng).select("source", "target", "lat_a", "lng_a", "lat_b", "lng_b", F.floor(F.col("plat") / cell).cast("long").alias("row"), F.round("plat").alias("band"), F.floor(F.col("plng") / cell).cast("long").alias("column")).drop("band").distinct()
    around = F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)])
    wide = F.ceil(2 / F.greatest(F.cos(F.radians("lat")), F.lit(0.05))).cast("long")
    # A coordinate is asked once, however many fixes are at it.
    asked = fixes.select("lat", "lng").distinct().withColumn("row", F.explode(F.transform(around, lambda i: F.floor(F.col("lat") / cell).cast("long") + i))).withColumn("column", F.explode(F.sequence(F.floor(F.col("lng") / cell).cast("long") - wide, F.floor(F.col("lng") / cell).cast("long") + wide)))
    met = asked.join(passed, ["row", "column"]).drop("row", "column").distinct()
    scale = F.cos(F.radians("lat"))
    dx, dy = (F.col("lng_b") - F.col("lng_a")) * scale, F.col("lat_b") - F.col("lat_a")
    px, py = (F.col("lng") - F.col("lng_a")) * scale, F.col("lat") - F.col("lat_a")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    far = met.withColumn("share", share).withColumn("distance_m", F.sqrt((px - F.col("share") * dx) ** 2 + (py - F.col("share") * dy) ** 2) * _METRES).where(F.col("distance_m") <= radius_m)
    nearest = Window.partitionBy("lat", "lng").orderBy("distance_m", "source", "target")
    return far.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= most).select("lat", "lng", "source", "target", "distance_m", "share")


def candidates(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float = 75.0, most: int = 8) -> DataFrame:
    """The same for each fix (uid, event_id)."""
    return fixes.select("uid", "event_id", "lat", "lng").join(_candidates(fixes, nodes, edges, radius_m, most), ["lat", "lng"]).select("uid", "event_id", "source", "target", "distance_m", "share")


def match_trajectory(fixes: DataFrame, nodes: DataFrame, edges: DataFrame, candidate_radius_m: float = 75.0, max_candidates: int = 8, gps_sigma_m: float = 20.0, gap_seconds: float = 1800.0, max_transition_speed_kmh: float = 180.0) -> DataFrame:
    """uid, event_id, source, target (the edge), distance_m, part and confidence of each fix that has an edge within reach.

    Emission is -(d / sigma)**2 / 2 and transition minus the routed kilometres; steps faster than the
    bound are out, and a part ends at a gap, or where no step is possible. confidence: the share of the
    chosen edge among the fix's candidates by forward score. nodes(node, lat, lng), edges(source, target,
    length_m, weight); a network is bounded as RoadNetwork says.
    """
    # Only tables of different coordinates, and of different steps between sets of nodes, are joined with the fixes: no join
    # has two sides that grow with repeated fixes, so none of these is taken for small, packed as it is, and sent to the driver.
    long = edges.groupBy("source", "target").agg(F.min("length_m").alias("length_m"))
    found = _candidates(fixes, nodes, edges, candidate_radius_m, max_candidates).join(long, ["source", "target"])
    found = found.groupBy("lat", "lng").agg(F.sort_array(F.collect_list(F.struct("source", "target", "distance_m", "share", "length_m"))).alias("c"))
    us = F.unix_micros(F.col("datetime").cast("timestamp")) if dict(fixes.dtypes)["datetime"] == "timestamp" else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', datetime)")
    line = Window.partitionBy("uid").orderBy("us", "event_id")
    here = fixes.select("uid", "event_id", "lat", "lng", us.alias("us")).join(found, ["lat", "lng"]).drop("lat", "lng").withColumn("k", F.row_number().over(line)).withColumn("before", F.lag("c").over(line))
    here = here.withColumn("s", F.array_sort(F.array_distinct(F.transform("before", lambda e: e["target"])))).withColumn("t", F.array_sort(F.array_distinct(F.transform("c", lambda e: e["source"])))).drop("before")
    steps = here.where("s is not null").select(F.col("s").alias("ss"), F.col("t").alias("ts")).distinct()
    every = steps.withColumn("s", F.explode("ss")).withColumn("t", F.explode("ts")).where("s != t")
    routed = RoadNetwork(edges).distances(every.select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()).where("reachable").select(F.col("source").alias("s"), F.col("target").alias("t"), "metres")
    ways = every.join(routed, ["s", "t"]).groupBy("ss", "ts").agg(F.collect_list(F.struct("s", "t", "metres")).alias("ways")).withColumnsRenamed({"ss": "s", "ts": "t"})
    rows = here.join(ways, ["s", "t"], "left").select("uid", "k", "event_id", "us", "c", "ways")
    kind, node = fixes.schema["uid"].dataType.simpleString(), edges.schema["source"].dataType.simpleString()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        out, line, number = [], [], 0

        def close():
            """Goes back from the best last candidate of a part."""
            at = int(np.argmax(line[-1][1])) if line else -1
            for event, score, back, c in reversed(line):
                e = c[at]
                p = np.exp(score - score[np.isfinite(score)].max())
                out.append((part["uid"].iloc[0], event, e["source"], e["target"], float(e["distance_m"]), number, float(p[at] / p.sum())))
                at = int(back[at])

        last = None
        for event, us, c, ways in zip(part["event_id"], part["us"], part["c"], part["ways"], strict=True):
            emission = np.array([-0.5 * (e["distance_m"] / gps_sigma_m) ** 2 for e in c])
            score, back = emission, np.zeros(len(c), int)
            if last is not None and (us - last) / 1e6 <= gap_seconds:
                metres = {(w["s"], w["t"]): w["metres"] for w in (ways if ways is not None else [])}
                seconds, prior = (us - last) / 1e6, line[-1]
                move = np.full((len(prior[3]), len(c)), -np.inf)
                for i, x in enumerate(prior[3]):
                    for j, y in enumerate(c):
                        if (x["source"], x["target"]) == (y["source"], y["target"]) and y["share"] >= x["share"]:
                            m = (y["share"] - x["share"]) * y["length_m"]
                        else:
                            between = 0.0 if x["target"] == y["source"] else metres.get((x["target"], y["source"]))
                            if between is None or between != between:
                                continue
                            m = (1 - x["share"]) * x["length_m"] + between + y["share"] * y["length_m"]
                        if m <= max_transition_speed_kmh / 3.6 * max(seconds, 1e-9):
                            move[i, j] = -m / 1000
                total = prior[1][:, None] + move
                if np.isfinite(total.max()):
                    back = total.argmax(0)
                    score = total.max(0) + emission
                else:
                    close()
                    line, number = [], number + 1
            elif line:
                close()
                line, number = [], number + 1
            line.append((event, score, back, c))
            last = us
        close()
        return pd.DataFrame(out, columns=["uid", "event_id", "source", "target", "distance_m", "part", "confidence"])

    return rows.groupBy("uid").applyInPandas(walk, f"uid {kind}, event_id bigint, source {node}, target {node}, distance_m double, part int, confidence double")
