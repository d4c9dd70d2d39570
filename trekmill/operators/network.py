"""Least-time routes on a road or rail network, run beside the data on a network of bounded size."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, valid
from .near import nearest

#: Bound of the edges a network may have: they reach every task.
MAX_EDGES = 5_000_000


class RoadNetwork:
    """Edges(source, target, length_m, weight): of repeated edges the lightest stays (then the shortest), self loops go."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        best = edges.where("source != target and weight >= 0").groupBy("source", "target").agg(F.min(F.struct("weight", "length_m")).alias("e")).select("source", "target", "e.weight", "e.length_m")
        if best.limit(MAX_EDGES + 1).count() > MAX_EDGES:
            raise ValueError(f"more than {MAX_EDGES} edges; split the network by region")
        rows = best.toPandas().sort_values(["source", "target"])
        names, codes = np.unique(np.r_[rows["source"].to_numpy(), rows["target"].to_numpy()], return_inverse=True)
        s, t = np.split(codes, 2) if len(rows) else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(s, kind="stable")
        starts = np.searchsorted(s[order], np.arange(len(names) + 1))
        self._shared = self.spark.sparkContext.broadcast((names, starts, t[order], rows["weight"].to_numpy(float)[order], rows["length_m"].to_numpy(float)[order]))

    def _run(self, pairs: DataFrame, columns, row, schema: str) -> DataFrame:
        shared = self._shared

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            names, starts, target, weight, length = shared.value
            at = {x: i for i, x in enumerate(names.tolist())}
            source, ends = at.get(p["source"].iloc[0]), {at[x] for x in p["target"] if x in at}
            cost, before = ({source: (0.0, 0.0)}, {}) if source is not None else ({}, {})
            heap, done = [(0.0, 0.0, source)] if source is not None else [], set()
            while heap and not ends <= done:
                c, m, i = heapq.heappop(heap)
                if i in done:
                    continue
                done.add(i)
                for e in range(starts[i], starts[i + 1]):
                    j, new = int(target[e]), (c + weight[e], m + length[e])
                    if j not in cost or new < cost[j]:
                        cost[j], before[j] = new, i
                        heapq.heappush(heap, (*new, j))
            out = []
            for x in p["target"]:
                j = at.get(x)
                out.append((p["source"].iloc[0], x, *row(names, cost, before, j if j in done else None)))
            return pd.DataFrame(out, columns=["source", "target", *columns])

        return pairs.select("source", "target").distinct().groupBy("source").applyInPandas(solve, schema)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """Metres along the least-time path of each distinct pair (source, target); 0 and not reachable where there is none."""
        kind = pairs.schema["source"].dataType.simpleString()
        return self._run(pairs, ["metres", "reachable"], lambda names, cost, before, j: (cost[j][1], True) if j is not None else (0.0, False), f"source {kind}, target {kind}, metres double, reachable boolean")

    def routes(self, pairs: DataFrame) -> DataFrame:
        """The nodes of those paths and the weight up to each; empty where there is none."""
        kind = pairs.schema["source"].dataType.simpleString()

        def row(names, cost, before, j):
            line = []
            while j is not None:
                line.append(j)
                j = before.get(j)
            return names[line[::-1]].tolist(), [cost[k][0] for k in line[::-1]]

        return self._run(pairs, ["nodes", "weights"], row, f"source {kind}, target {kind}, nodes array<{kind}>, weights array<double>")

    def desire_lines(self, flows: DataFrame) -> DataFrame:
        """Sum of flow(source, target, flow) over each edge of its path."""
        total = flows.groupBy("source", "target").agg(F.sum("flow").alias("flow"))
        paths = total.join(self.routes(flows), ["source", "target"])
        steps = paths.where("size(nodes) > 1").select("flow", F.explode(F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] AS a, nodes[i] AS b))")).alias("e"))
        return steps.groupBy(F.col("e.a").alias("source"), F.col("e.b").alias("target")).agg(F.sum("flow").alias("flow"))

    def jump_lengths(self, fixes: DataFrame, nodes: DataFrame) -> DataFrame:
        """km on the network between consecutive fixes of a user: fixes(uid, event_id, datetime, node, straight_km); straight where a node is missing or out of reach."""
        line = Window.partitionBy("uid").orderBy("datetime", "event_id")
        jumps = fixes.withColumn("source", F.lag("node").over(line)).withColumn("k", F.row_number().over(line)).where("k > 1")
        known = jumps.where("source >= 0 and node >= 0").select("source", F.col("node").alias("target"))
        far = self.distances(known.join(nodes.select(F.col("node").alias("source")), "source", "left_semi")).where("reachable").withColumnRenamed("target", "node")
        return jumps.join(far, ["source", "node"], "left").select("uid", "event_id", F.round(F.coalesce(F.col("metres") / 1000, F.col("straight_km")), 6).alias("jump_length"))

    def radius_of_gyration(self, fixes: DataFrame, nodes: DataFrame, snap_max_distance_m: float = 750.0) -> DataFrame:
        """km: root mean square of the distances on the network from the node nearest to a user's mean coordinate to the nodes
        nearest to the fixes; straight where a point is farther than snap_max_distance_m from a node, or out of reach.

        fixes(uid, lat, lng), nodes(node, lat, lng)."""
        rows = fixes.where(valid(F.col("lat"), F.col("lng"))).groupBy("uid", "lat", "lng").agg(F.count("*").alias("n"))
        centre = rows.groupBy("uid").agg((F.sum(F.col("n") * F.col("lat")) / F.sum("n")).alias("clat"), (F.sum(F.col("n") * F.col("lng")) / F.sum("n")).alias("clng"))
        points = nodes.select(F.col("node").alias("id"), "lat", "lng")

        def snapped(coordinates: DataFrame, name: str) -> DataFrame:
            return nearest(coordinates, points).where(F.col("d") * 1000 <= snap_max_distance_m).select("lat", "lng", F.col("id").alias(name))

        at = snapped(rows.select("lat", "lng"), "target")
        middle = snapped(centre.select(F.col("clat").alias("lat"), F.col("clng").alias("lng")), "source").withColumnsRenamed({"lat": "clat", "lng": "clng"})
        both = rows.join(centre, "uid").join(at, ["lat", "lng"], "left").join(middle, ["clat", "clng"], "left").persist()
        far = self.distances(both.where("source is not null and target is not null").select("source", "target")).where("reachable").select("source", "target", "metres")
        straight = haversine(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng"))
        km = both.join(far, ["source", "target"], "left").withColumn("km", F.coalesce(F.col("metres") / 1000, straight))
        return km.groupBy("uid").agg(F.round(F.sqrt(F.sum(F.col("n") * F.col("km") ** 2) / F.sum("n")), 6).alias("radius_of_gyration"))
