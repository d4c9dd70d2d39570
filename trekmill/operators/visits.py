"""Walks over one user's visits: entropy and diversity of the sequence, daily motifs, exploring and returning."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .walks import _kontoyiannis, _uid

_COLUMNS = ("uid", "location_id", "purpose", "started_at", "finished_at")


def _per_visitor(visits: DataFrame, walk, schema: str) -> DataFrame:
    """walk(part) for each user's visits with a place and a start, in order of (start, place)."""
    rows = visits.where("location_id is not null and started_at is not null").select(*_COLUMNS)
    return rows.groupBy("uid").applyInPandas(lambda p: walk(p.sort_values(["started_at", "location_id"], kind="stable").reset_index(drop=True)), f"{_uid(visits)}, {schema}")


def trajectory_entropy(visits: DataFrame) -> DataFrame:
    """Entropy of the sequence of places by the lengths of its matches, and that over log2 of the places, 0 to 1."""

    def walk(p):
        codes = pd.factorize(p["location_id"])[0]
        h, n = _kontoyiannis(codes), int(codes.max()) + 1
        return pd.DataFrame({"uid": p["uid"].iloc[:1], "entropy": [round(h, 9)], "normalized_entropy": [round(min(max(h / np.log2(n), 0.0), 1.0), 9) if n > 1 else 0.0]})

    return _per_visitor(visits, walk, "entropy double, normalized_entropy double")


def distinct_runs(s) -> int:
    """Distinct contiguous parts of a sequence, by its suffix automaton."""
    step, link, length, last, total = [{}], [-1], [0], 0, 0
    for c in s:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] > length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
        last = now
        total += length[now] - length[link[now]]
    return total


def diversity(visits: DataFrame) -> DataFrame:
    """Distinct contiguous parts of a user's sequence of places over the most there could be; 0 for one visit."""

    def walk(p):
        n = len(p)
        return pd.DataFrame({"uid": p["uid"].iloc[:1], "diversity": [round(distinct_runs(p["location_id"].tolist()) / (n * (n + 1) / 2), 9) if n > 1 else 0.0]})

    return _per_visitor(visits, walk, "diversity double")


def motif_id(days_nodes: list) -> int:
    """(nodes << 36) | the largest adjacency matrix, row by row from the top bit, over orders that keep the first node; -1 above six nodes."""
    names = list(dict.fromkeys(days_nodes))
    n = len(names)
    if n > 6:
        return -1
    at = {x: i for i, x in enumerate(names)}
    edges = {(at[a], at[b]) for a, b in zip(days_nodes, days_nodes[1:], strict=False) if a != b}
    best = max(sum(1 << (n * n - 1 - ((0, *o)[a] * n + (0, *o)[b])) for a, b in edges) for o in permutations(range(1, n)))
    return (n << 36) | best


def daily_motifs(visits: DataFrame, home: str = "HOME") -> DataFrame:
    """The motif of each of a user's days, anchored at the home that has most night minutes (else most visits); ties: smaller place.

    Days start at that home, or at the day before's last node where that is home too late at night; days end at a home.
    """

    def walk(p):
        node = list(zip(p["location_id"].tolist(), p["purpose"].tolist(), strict=True))
        hour, minutes = p["started_at"].dt.hour.to_numpy(), ((p["finished_at"] - p["started_at"]).dt.total_seconds() / 60).fillna(0).to_numpy()
        homes, counts = {}, {}
        for x, h, m in zip(node, hour, minutes, strict=True):
            if x[1] == home:
                counts[x] = counts.get(x, 0) + 1
                if h >= 22 or h < 6:
                    homes[x] = homes.get(x, 0) + m
        if not counts:
            return pd.DataFrame({"uid": p["uid"].iloc[:0], "day": [], "motif_id": []})
        table = homes or counts
        main = min(table, key=lambda x: (-table[x], x[0]))
        day = p["started_at"].dt.date.to_numpy()
        first = np.flatnonzero(np.r_[True, day[1:] != day[:-1]])
        out, before = [], None
        for k, i in enumerate(first):
            j = first[k + 1] if k + 1 < len(first) else len(p)
            end = p["finished_at"].iloc[i - 1].hour if i else None
            start = before if before == main and end is not None and (end < 3 or end == 23) else main
            line = [start, *node[i:j]]
            if line[-1][1] != home:
                line.append(node[j] if j < len(p) and hour[j] < 3 and node[j][1] == home else main)
            out.append((p["uid"].iloc[0], day[i], motif_id(line)))
            before = node[j - 1]
        return pd.DataFrame(out, columns=["uid", "day", "motif_id"])

    return _per_visitor(visits, walk, "day date, motif_id bigint")


def daily_motifs_from_staypoints(staypoints: DataFrame, locations: DataFrame, home: str = "home") -> DataFrame:
    """daily_motifs of stays whose purposes are those of each user's places: locations(uid, location_id, purpose). Places without one have none."""
    named = staypoints.drop("purpose").join(locations.select("uid", "location_id", "purpose"), ["uid", "location_id"], "left")
    return daily_motifs(named, home)


def motif_distribution(daily: DataFrame) -> DataFrame:
    """Days and per cent of each motif."""
    n = daily.groupBy("motif_id").agg(F.count("*").alias("days"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("days").alias("all")))).select("motif_id", "days", F.round(100 * F.col("days") / F.col("all"), 6).alias("per_cent"))


def intermittency(visits: DataFrame, level: float = 0.8, slot_s: int = 300) -> DataFrame:
    """Mean lengths, in slots, of a user's runs among known and among new places; intermittency is their sum, degree of return atan2(known, new).

    Slots go from the rounded-up start to the rounded-down end of a visit; the first visit in time takes a slot. A place is
    known once it was seen, or where its visits reach level times the mean of the user's places.
    """
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', started_at)"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', finished_at)")
    rows = visits.where("location_id is not null and started_at is not null and finished_at is not null").select("uid", "location_id", us[0].alias("s"), us[1].alias("e"))
    rows = rows.select("uid", "location_id", "s", F.ceil(F.col("s") / (slot_s * 1e6)).cast("long").alias("a"), F.floor(F.col("e") / (slot_s * 1e6)).cast("long").alias("b")).where("b >= a").repartition("uid")  # all that follows is by user
    often = rows.groupBy("uid", "location_id").agg(F.count("*").alias("n")).withColumn("often", F.col("n") >= level * F.avg("n").over(Window.partitionBy("uid"))).drop("n")
    slots = rows.select("uid", "location_id", "s", F.explode(F.sequence("a", "b")).alias("slot")).groupBy("uid", "slot").agg(F.min_by("location_id", F.struct("s", "location_id")).alias("location_id"))
    line = Window.partitionBy("uid").orderBy("slot")
    seen = slots.withColumn("first", F.row_number().over(Window.partitionBy("uid", "location_id").orderBy("slot")) == 1).join(often, ["uid", "location_id"])
    known = seen.withColumn("known", F.col("often") | ~F.col("first"))
    runs = known.withColumn("new", F.when(F.lag("known").over(line).eqNullSafe(F.col("known")), 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    runs = runs.groupBy("uid", "run", "known").agg(F.count("*").alias("n"))
    got = runs.groupBy("uid").agg(F.coalesce(F.avg(F.when(F.col("known"), F.col("n"))), F.lit(0.0)).alias("returning"), F.coalesce(F.avg(F.when(~F.col("known"), F.col("n"))), F.lit(0.0)).alias("exploring"))
    return got.select("uid", F.round("exploring", 6).alias("exploring"), F.round("returning", 6).alias("returning"), F.round(F.col("exploring") + F.col("returning"), 6).alias("intermittency"), F.round(F.atan2("returning", "exploring"), 6).alias("degree_of_return"))


def exploration_profiles(visits: DataFrame, seed: int = 42, iterations: int = 300) -> DataFrame:
    """Users as scouters, regulars and routiners: three k-means clusters of the degree of return, by rising centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    degrees = intermittency(visits).select("uid", "degree_of_return").withColumn("features", array_to_vector(F.array("degree_of_return"))).persist()  # a row a user, read by the fit and after it
    model = KMeans(k=3, seed=seed, maxIter=iterations).fit(degrees)
    order = np.argsort([c[0] for c in model.clusterCenters()]).tolist()
    names = F.create_map(*[F.lit(x) for k, name in zip(order, ("scouter", "regular", "routiner"), strict=False) for x in (k, name)])
    return model.transform(degrees).select("uid", "degree_of_return", names[F.col("prediction")].alias("profile"))


#: Names of three clusters, by rising degree of return.
PROFILES = ("scouters", "regulars", "routiners")


def compute_profiles(visits: DataFrame, n_clusters: int = 3, seed: int = 0, iterations: int = 300) -> DataFrame:
    """Per user: intermittency, degree_of_return, regularity, diversity, entropy (of the sequence, over its largest), stationarity, and a profile.

    Stationarity is the mean share of a visit to its user's most visited place. Profiles are k-means clusters of the
    standardised intermittency and degree of return, named by rising degree of return where there are at most three.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    from .individual import regularity

    most = visits.where("location_id is not null").groupBy("uid", "location_id").agg(F.count("*").alias("n")).groupBy("uid").agg(F.round(F.max("n") / F.sum("n"), 6).alias("stationarity"))
    entropy = trajectory_entropy(visits).select("uid", F.round("normalized_entropy", 6).alias("entropy"))
    purposes = visits if "purpose" in visits.columns else visits.withColumn("purpose", F.lit(None).cast("string"))
    table = intermittency(visits).select("uid", "intermittency", "degree_of_return").join(regularity(purposes), "uid").join(diversity(visits).select("uid", F.round("diversity", 6).alias("diversity")), "uid").join(entropy, "uid").join(most, "uid")
    table = table.persist()
    if table.count() < n_clusters:
        raise ValueError(f"fewer than {n_clusters} users")
    raw = table.withColumn("raw", array_to_vector(F.array("intermittency", "degree_of_return")))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    model = KMeans(k=n_clusters, seed=seed, maxIter=iterations).fit(scaled)
    order = np.argsort([c[1] for c in model.clusterCenters()]).tolist()
    names = [PROFILES[i] if n_clusters <= 3 else f"cluster_{i}" for i in range(len(order))]
    named = F.create_map(*[F.lit(x) for k, n in zip(order, names, strict=True) for x in (k, n)])
    return model.transform(scaled).withColumn("profile", named[F.col("prediction")]).select(*table.columns, "profile")
